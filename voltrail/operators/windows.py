"""Per-station history features, safe for a station that holds a large share of all rows.

The time windows ``[t-7d, t)`` and ``[t-30d, t)`` are running totals: a session adds its value at its
start and a marker takes it away when it leaves the window. A running total is linear in the rows;
a sliding frame would re-read the whole window for every row. Totals are decimals of ``SCALE`` places, so what
leaves a window cancels exactly; infinite values are counted apart and leave with their session.

Events are cut in slices of about ``SLICE_ROWS`` by a range shuffle on station, time and row number, whatever the sizes of
stations, days or instants. Every slice is ordered on its own; the sums of earlier slices, one small row for each station
and slice, are carried forward. Where one instant spans slices, the total before it comes from the slice it starts in.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.functions.scalar import epoch_micros
from voltrail.schema import MINUTES, ROW_ID, START, STATION
from voltrail.session import stored

DAY_MICROS = 86_400_000_000
WEEK_MINUTES = 7 * 24 * 60

# Events in a slice, about.
SLICE_ROWS = 500_000
# Places after the point that are summed exactly; larger values than the type holds count as infinite.
SCALE = 9
EXACT, LARGEST = f"decimal(24,{SCALE})", 1e15

SESSION, LEAVES_WEEK, LEAVES_MONTH = 0, 1, 2


@dataclass(frozen=True)
class Frame:
    """Names of the columns that the windows read."""

    key: str = STATION
    ts: str = START
    order: str = ROW_ID
    minutes: str = MINUTES
    temperature: str = "temperature_degc"


def sliced(events: DataFrame, rows: int, frame: Frame, slice_rows: int) -> DataFrame:
    """Stored events with the number of their slice; slices follow each other in station, time, kind and row order.

    ``rows`` is the number of events, about. The bounds of a slice are sampled, so its size is near ``slice_rows``.
    """
    number = max(1, -(-rows // slice_rows))
    laid_out = events.repartitionByRange(number, frame.key, "_t", "_kind", "_o").withColumn("_slice", F.spark_partition_id())
    return stored(laid_out, "slices")


def _session(minutes: str) -> Column:
    return F.struct(F.col("_t").alias("t"), F.col(minutes).alias("minutes"))


# --- previous session -----------------------------------------------------------------------------

def previous_session(df: DataFrame, frame: Frame = Frame(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds minutes since the previous session of the station, and that session's duration.

    Rows with a null station are dropped.
    """
    df = df.filter(F.col(frame.key).isNotNull())
    events = df.withColumns({"_t": epoch_micros(frame.ts), "_kind": F.lit(SESSION), "_o": F.col(frame.order)})
    cut = sliced(events, df.count(), frame, slice_rows)
    here = _session(frame.minutes)
    last = cut.groupBy(frame.key, "_slice").agg(F.max_by(here, F.struct("_t", "_o")).alias("_last"))
    carried = last.select(
        F.col(frame.key).alias("_key"), F.col("_slice").alias("_s"),
        F.lag("_last").over(Window.partitionBy(frame.key).orderBy("_slice")).alias("_carried"),
    )
    joined = cut.join(carried, (F.col(frame.key) == F.col("_key")) & (F.col("_slice") == F.col("_s")))
    order = Window.partitionBy("_slice", frame.key).orderBy("_t", "_o")
    before = F.coalesce(F.lag(here).over(order), F.col("_carried"))
    return joined.withColumn("_before", before).select(
        *df.columns,
        ((F.col("_t") - F.col("_before.t")) / 60_000_000.0).alias("minutes_since_prev_session"),
        F.col("_before.minutes").alias("prev_session_duration"),
    )


# --- all station context features -----------------------------------------------------------------

# Totals of the windows: sessions, known temperatures, sums of both measures, and their infinite values by sign.
RUNNING = ["_n7", "_m7", "_up7", "_down7", "_n30", "_t30", "_up30", "_down30"]
# Totals over all earlier sessions.
PAST = {"_past_n": "_minutes", "_past_m": "_exact", "_past_up": "_up7", "_past_down": "_down7"}


def _exact(value: Column) -> Column:
    return F.when(F.abs(value) < LARGEST, value).cast(EXACT)


def _events(df: DataFrame, frame: Frame) -> DataFrame:
    """One row per session plus two narrow markers for when it leaves the windows.

    The session's own columns travel in ``_row`` on the session row only. The three rows come from one
    read of the input.
    """
    t = epoch_micros(frame.ts)

    def known(column: str) -> Column:
        value = F.col(column).cast("double")
        return F.when(~F.isnan(value), value)

    minutes, temperature = known(frame.minutes), known(frame.temperature)
    whole = F.struct(*[F.col(c) for c in df.columns])
    none = F.lit(0).cast("bigint")
    zero = F.lit(0).cast(EXACT)

    def parts(value: Column) -> list[Column]:
        return [F.coalesce(_exact(value), zero), F.coalesce((value >= LARGEST).cast("bigint"), none),
                F.coalesce((value <= -LARGEST).cast("bigint"), none)]

    week = [F.lit(1).cast("bigint"), *parts(minutes)]
    month = [temperature.isNotNull().cast("bigint"), *parts(temperature)]
    nothing = [none, zero, none, none]

    def event(kind: int, at: Column, totals: list[Column]) -> Column:
        is_session = kind == SESSION
        return F.struct(
            F.lit(kind).alias("_kind"), at.alias("_t"), F.col(frame.order).alias("_o"),
            *[c.cast(EXACT if n in ("_m7", "_t30") else "bigint").alias(n) for n, c in zip(RUNNING, totals)],
            (minutes if is_session else F.lit(None).cast("double")).alias("_minutes"),
            (_exact(minutes) if is_session else F.lit(None).cast(EXACT)).alias("_exact"),
            (whole if is_session else F.lit(None).cast(df.schema)).alias("_row"),
        )

    return df.select(F.col(frame.key), F.inline(F.array(
        event(SESSION, t, [*week, *month]),
        event(LEAVES_WEEK, t + F.lit(7 * DAY_MICROS), [*[-c for c in week], *nothing]),
        event(LEAVES_MONTH, t + F.lit(30 * DAY_MICROS), [*nothing, *[-c for c in month]]),
    )))


def _within_slices(cut: DataFrame, frame: Frame) -> DataFrame:
    """Totals of each event over the earlier events of its station in its slice, and the last session among them."""
    is_session = F.col("_kind") == SESSION
    group = Window.partitionBy("_slice", frame.key)
    in_order = group.orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, -1)
    earlier = group.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    past = {name: F.count(F.when(is_session, F.col(c))) if name == "_past_n" else F.sum(F.when(is_session, F.col(c)))
            for name, c in PAST.items()}
    return cut.withColumns({
        "_before": F.last(F.when(is_session, _session("_minutes")), ignorenulls=True).over(in_order),
        **{name: total.over(in_order) for name, total in past.items()},
        **{c + "_w": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in RUNNING},
    })


def _carried(ordered: DataFrame, frame: Frame) -> DataFrame:
    """One row for each station and slice: what the earlier slices of the station add up to.

    ``_tie`` is set where the slice begins in the middle of an instant: the totals before that instant.
    """
    is_session = F.col("_kind") == SESSION
    last_total = F.max_by(F.struct(*[F.col(c + "_w").alias(c) for c in RUNNING]), "_t")
    slices = ordered.groupBy(F.col(frame.key).alias("_key"), F.col("_slice").alias("_s")).agg(
        *[F.sum(c).alias(c) for c in RUNNING],
        *[(F.count if name == "_past_n" else F.sum)(F.when(is_session, F.col(c))).alias(name) for name, c in PAST.items()],
        F.max_by(F.when(is_session, _session("_minutes")), F.when(is_session, F.struct("_t", "_o"))).alias("_last"),
        F.min("_t").alias("_first_t"), F.max("_t").alias("_last_t"), last_total.alias("_at_last"),
    )
    order = Window.partitionBy("_key").orderBy("_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = slices.select(
        "_key", "_s", "_first_t", "_last_t", "_at_last",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("_c" + c) for c in [*RUNNING, *PAST]],
        F.last("_last", ignorenulls=True).over(before).alias("_c_last"),
    )
    starts = stored(sums.withColumn("_tie", F.struct(*[(F.col("_c" + c) + F.col(f"_at_last.{c}")).alias(c) for c in RUNNING])), "carried")
    # of the slices that end at an instant, the first is where it starts
    ties = starts.groupBy(F.col("_key").alias("_tie_key"), F.col("_last_t").alias("_tie_t")).agg(
        F.min("_s").alias("_tie_s"), F.min_by("_tie", "_s").alias("_tie"))
    found = starts.drop("_tie", "_at_last", "_last_t").join(
        ties, (F.col("_key") == F.col("_tie_key")) & (F.col("_first_t") == F.col("_tie_t")) & (F.col("_tie_s") < F.col("_s")), "left")
    return found.drop("_tie_key", "_tie_t", "_tie_s")


def _with_infinite(finite: Column, up: Column, down: Column) -> Column:
    return F.when((up > 0) & (down > 0), F.lit(float("nan"))).when(up > 0, F.lit(float("inf"))) \
        .when(down > 0, F.lit(float("-inf"))).otherwise(finite)


def station_context(df: DataFrame, frame: Frame = Frame(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds the six history features of each session; rows with a null station are dropped.

    A marker at the same instant as a session still counts for it: the running total takes strictly
    earlier events, which gives exactly ``[t-7d, t)``. A measure that is NaN counts as absent.
    """
    df = df.filter(F.col(frame.key).isNotNull())
    ordered = stored(_within_slices(sliced(_events(df, frame), 3 * df.count(), frame, slice_rows), frame), "ordered")
    carried = _carried(ordered, frame)
    sessions = ordered.filter(F.col("_kind") == SESSION).join(
        carried, (F.col(frame.key) == F.col("_key")) & (F.col("_slice") == F.col("_s")))
    in_tie = F.col("_tie").isNotNull() & (F.col("_t") == F.col("_first_t"))
    totals = sessions.withColumns({
        "_before": F.coalesce("_before", "_c_last"),
        **{c: F.coalesce(F.col(c), F.lit(0)) + F.col("_c" + c) for c in PAST},
        **{c + "_w": F.when(in_tie, F.col(f"_tie.{c}")).otherwise(F.col(c + "_w") + F.col("_c" + c)) for c in RUNNING},
    })
    n7, n30 = F.col("_n7_w"), F.col("_n30_w")
    m7 = _with_infinite(F.col("_m7_w").cast("double"), F.col("_up7_w"), F.col("_down7_w"))
    t30 = _with_infinite(F.col("_t30_w").cast("double"), F.col("_up30_w"), F.col("_down30_w"))
    past_m = _with_infinite(F.col("_past_m").cast("double"), F.col("_past_up"), F.col("_past_down"))
    mean7 = F.when(n7 > 0, F.nullif(m7 / n7, F.lit(0.0)))
    past_mean = F.when(F.col("_past_n") > 0, past_m / F.col("_past_n"))
    month_mean = F.when(n30 > 0, t30 / n30)
    return totals.select(
        "_row.*",
        ((F.col("_t") - F.col("_before.t")) / 60_000_000.0).alias("minutes_since_prev_session"),
        F.col("_before.minutes").alias("prev_session_duration"),
        n7.cast("double").alias("station_session_load_7d"),
        F.when(n7 > 0, m7 / WEEK_MINUTES).otherwise(0.0).alias("station_utilization_ratio_7d"),
        F.coalesce(mean7, past_mean).alias("station_avg_duration_7d"),
        F.coalesce(F.col(f"_row.{frame.temperature}") - month_mean, F.lit(0.0)).alias("temperature_station_anomaly"),
    )


# --- daily series windows -------------------------------------------------------------------------
# A series has at most one row per calendar day, so a window over it is bounded by the calendar.

def rolling14(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of the last 14 rows (at least 7), with whole-series deviation as fallback."""
    order = Window.partitionBy(*keys).orderBy("ds")
    last14 = order.rowsBetween(-13, 0)
    whole = Window.partitionBy(*keys)
    enough = F.count("y").over(last14) >= 7
    return series.withColumns({
        "rolling_mean": F.when(enough, F.avg("y").over(last14)),
        "rolling_std": F.coalesce(F.when(enough, F.stddev_samp("y").over(last14)), F.stddev_samp("y").over(whole)),
    })


def holdout_split(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks the last min(7, n div 3) days of a series of 14 or more days as test."""
    whole = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(whole)
    from_end = F.row_number().over(whole.orderBy(F.desc("ds")))
    size = F.when(n >= 14, F.least(F.lit(7), F.floor(n / 3))).otherwise(0)
    return series.withColumn("is_test", (from_end <= size).cast("int")).withColumn("series_days", n)
