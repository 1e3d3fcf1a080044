"""Header normalisation, typing, derived time fields and row filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from voltrail.operators.joins import keep_members
from voltrail.schema import NUMERIC_COLUMNS, REQUIRED_COLUMNS, ROW_ID, START, STATION, TIME_COLUMNS

# The renaming rule, applied in this order.
HEADER_RULE = [(" ", "_"), ("(", ""), (")", ""), ("%", "pct"), ("°", "deg"), ("/", "_per_")]

# A membership list longer than this is joined as a table and not inlined in the filter.
INLINE_MEMBERS = 200


def standard_name(header: str) -> str:
    name = header.strip().lower()
    for old, new in HEADER_RULE:
        name = name.replace(old, new)
    return name


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[standard_name(c) for c in df.columns])


def parse_times(df: DataFrame, columns: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    """Text to a wall-clock timestamp; text that is no timestamp fails the job (ANSI cast)."""
    return df.withColumns({
        c: F.col(c).cast("timestamp_ntz")
        for c in columns
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)
    })


# A decimal number as text, or an infinity; the cast alone would also take Java's suffixes (12d, 12f).
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def coerce_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Known numeric columns to double; text that is no number becomes null."""
    changed = {}
    for c in columns:
        if c not in df.columns:
            continue
        kind = df.schema[c].dataType
        if isinstance(kind, T.DoubleType):
            number = F.col(c)
        else:
            number = F.when(F.col(c).rlike(NUMBER), F.col(c)).try_cast("double") if isinstance(kind, T.StringType) else F.col(c).cast("double")
        changed[c] = F.when(~F.isnan(number), number)
    return df.withColumns(changed)


def time_features(df: DataFrame) -> DataFrame:
    new = {}
    if START in df.columns:
        new["start_hour"] = F.hour(START)
        new["day_of_week"] = F.date_format(START, "EEEE")
    if "charging_duration_hours" in df.columns:
        new["charging_duration_minutes"] = F.col("charging_duration_hours") * 60
    return df.withColumns(new)


def drop_required(df: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.na.drop(subset=present) if present else df


def prepare_dataset(df: DataFrame) -> DataFrame:
    return df.transform(coerce_numeric).transform(drop_required).transform(time_features)


def session_date(ts: str = START) -> Column:
    return F.to_date(ts)


def date_range_filter(df: DataFrame, first: dt.date, last: dt.date, ts: str = START) -> DataFrame:
    """Calendar days ``first``..``last`` inclusive, as a half-open range on the raw column.

    The bound stays a plain comparison on the stored column, so it reaches the Parquet scan.
    """
    kind = df.schema[ts].dataType.simpleString()
    low = F.lit(first.isoformat()).cast(kind)
    high = F.lit((last + dt.timedelta(days=1)).isoformat()).cast(kind)
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def station_filter(df: DataFrame, stations: Sequence[str] | None) -> DataFrame:
    """Rows of the chosen stations; no choice, or a choice that holds ``All``, keeps every row."""
    if not stations or "All" in stations:
        return df
    if len(stations) <= INLINE_MEMBERS:
        return df.filter(F.col(STATION).isin(list(stations)))
    chosen = df.sparkSession.createDataFrame([(s,) for s in sorted(set(stations))], f"{STATION} string")
    return keep_members(df, chosen, STATION)


def sample_head(df: DataFrame, n: int, order: str = ROW_ID) -> DataFrame:
    return df.orderBy(order).limit(n)


def require_columns(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features and target in a fixed order; every absent column is named in the error."""
    missing = [c for c in [*features, target] if c not in df.columns]
    if missing:
        raise ValueError(f"Missing expected columns: {missing}")
    return df.select(*features, target)


def restore_order(df: DataFrame, order: str = ROW_ID) -> DataFrame:
    """Global order by the carried row number (a range shuffle, never a single task)."""
    return df.orderBy(order)


def distinct_stations(df: DataFrame, column: str = STATION) -> DataFrame:
    return df.select(column).na.drop().distinct()
