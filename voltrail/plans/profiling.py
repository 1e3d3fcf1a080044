"""Column profiles."""

from __future__ import annotations

from itertools import combinations

from voltrail.operators import profile as P
from voltrail.plans.registry import query
from voltrail.schema import CLEAN_NUMERIC_COLUMNS, TEXT_COLUMNS
from voltrail.sources.mapping import sessions

COLUMNS = [c for c in dict.fromkeys([*CLEAN_NUMERIC_COLUMNS, *TEXT_COLUMNS])]


def _union(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


MISSING = _union("SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
                 "count(*) FILTER (WHERE {c} IS NULL) * 1e2 / count(*) AS missing_pct FROM sessions", COLUMNS)


@query("missing_report", MISSING, ("missing_pct",))
def _(spark, sf_dir):
    return P.missing_report(sessions(spark, sf_dir), COLUMNS)


@query("missing_report_short", "SELECT \"column\", missing_count, round_even(missing_pct, 2) AS missing_pct FROM missing "
       "WHERE missing_count > 0", ("missing_pct",), extra={"missing": MISSING})
def _(spark, sf_dir):
    return P.missing_report_short(sessions(spark, sf_dir), COLUMNS)


DESCRIBED = ("mean", "std", "min", "p25", "p50", "p75", "max")


@query("describe_numeric", _union(
    "SELECT '{c}' AS column, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    "CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 25e-2) AS p25, "
    "quantile_cont(CAST({c} AS DOUBLE), 5e-1) AS p50, quantile_cont(CAST({c} AS DOUBLE), 75e-2) AS p75, "
    "CAST(max({c}) AS DOUBLE) AS max FROM sessions", CLEAN_NUMERIC_COLUMNS), DESCRIBED)
def _(spark, sf_dir):
    return P.describe_numeric(sessions(spark, sf_dir), CLEAN_NUMERIC_COLUMNS)


VALUE_COUNTS = {"value_counts": _union(
    "SELECT '{c}' AS column, {c} AS value, count(*) AS n FROM sessions WHERE {c} IS NOT NULL GROUP BY 2", TEXT_COLUMNS)}


@query("describe_categorical", "SELECT \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, "
       "max(CASE WHEN place = 1 THEN value END) AS top, max(n) AS freq FROM (SELECT *, row_number() OVER "
       "(PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM value_counts) GROUP BY 1", extra=VALUE_COUNTS)
def _(spark, sf_dir):
    return P.describe_categorical(sessions(spark, sf_dir), TEXT_COLUMNS)


@query("category_top_values", "SELECT \"column\", count(*) OVER (PARTITION BY \"column\") AS unique_values, "
       "row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place, value, n AS value_count "
       "FROM value_counts QUALIFY place <= 10", extra=VALUE_COUNTS)
def _(spark, sf_dir):
    return P.category_top_values(sessions(spark, sf_dir), TEXT_COLUMNS)


def _bins(source: str, column: str, bins: int) -> str:
    return (
        f"SELECT bin, low + (high - low) * bin / {bins} AS bin_start, n FROM (SELECT CAST(least(floor(({column} - low) "
        f"/ (high - low) * {bins}), {bins - 1}) AS INT) AS bin, max(low) AS low, max(high) AS high, count(*) AS n FROM "
        f"(SELECT CAST({column} AS DOUBLE) AS {column} FROM {source}), (SELECT CAST(min({column}) AS DOUBLE) AS low, "
        f"CAST(max({column}) AS DOUBLE) AS high FROM {source}) GROUP BY 1)"
    )


@query("histogram", _bins("sessions", "charging_duration_minutes", 50), ("bin_start",))
def _(spark, sf_dir):
    return P.duration_histogram(sessions(spark, sf_dir))


@query("histogram_energy", _bins("sessions", "energy_consumed_kwh", 50), ("bin_start",))
def _(spark, sf_dir):
    return P.histogram(sessions(spark, sf_dir), "energy_consumed_kwh", 50)


@query("histogram_charger", _bins("(SELECT * FROM sessions WHERE charger_type = 'Level 2')",
                                  "charging_duration_minutes", 40), ("bin_start",))
def _(spark, sf_dir):
    return P.duration_histogram(sessions(spark, sf_dir), "Level 2", 40)


@query("sessions_per_station_hist", _bins("per_station", "sessions", 30), ("bin_start",), extra={
    "per_station": "SELECT charging_station_id, count(*) AS sessions FROM ev GROUP BY 1",
    "ev": "SELECT charging_station_id FROM sessions"})
def _(spark, sf_dir):
    return P.sessions_per_station_hist(sessions(spark, sf_dir))


PAIRS = [(c, c) for c in CLEAN_NUMERIC_COLUMNS] + list(combinations(CLEAN_NUMERIC_COLUMNS, 2))
CORRELATIONS = {"correlations": "SELECT " + ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(PAIRS))
                + " FROM sessions"}


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{x}' AS column_x, '{y}' AS column_y, r{i} AS corr FROM correlations"
    for i, (a, b) in enumerate(PAIRS) for x, y in sorted({(a, b), (b, a)})), ("corr",), extra=CORRELATIONS)
def _(spark, sf_dir):
    return P.correlation_matrix(sessions(spark, sf_dir), CLEAN_NUMERIC_COLUMNS)
