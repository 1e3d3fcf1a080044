"""Session and daily-table readers."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voltrail.operators.cleaning import parse_times, prepare_dataset, session_date, standardize_columns
from voltrail.schema import DAILY_SCHEMA, ROW_ID, START, STATION, text_schema
from voltrail.session import stored

# Text that stands for a missing cell in a raw file.
MISSING_MARKS = ["", "NA", "N/A", "n/a", "NaN", "nan", "-nan", "-NaN", "null", "NULL", "None", "<NA>", "#N/A", "#NA"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches; works for every file system Spark can read."""
    try:
        spark.read.format("binaryFile").load(path)  # resolves the path, reads nothing
        return True
    except AnalysisException as problem:
        # No permission or a store that cannot be reached is not an absent file.
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


# Standard quoting: a quote inside a quoted cell is doubled.
CSV = {"header": True, "quote": '"', "escape": '"'}


def _header_groups(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line of the files, with the files that have it (one extra pass over the text, first lines kept)."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files"))
    return {r.header: list(r.files) for r in groups.orderBy("header").collect()}


def _read_text(spark: SparkSession, path: str | list[str], headers: Sequence[str] | None, by_name: bool = False,
               multi_line: bool = False, places: bool = False) -> DataFrame:
    """All columns as text, named by the header row; nothing is inferred from the data.

    Every file must have the same header row, that of ``headers`` if given; another one fails the job. With ``by_name``, files
    are grouped by their header and matched by column name, and a column that a file lacks is null.
    ``multi_line`` allows line breaks in quoted cells; such files are not split between tasks. ``places`` adds where a row was read.
    """
    if by_name:
        parts = [_read_text(spark, files, None, False, multi_line, places) for files in _header_groups(spark, path).values()]
        table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return table if headers is None else table.select(*[F.col(f"`{h}`") for h in headers], *(PLACE if places else []))
    reader = spark.read.options(**CSV, multiLine=multi_line, enforceSchema=False)
    table = (reader if headers is None else reader.schema(text_schema(list(headers)))).csv(path)
    if not places:
        return table
    file, block, place = PLACE
    return table.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block),
                        F.monotonically_increasing_id().alias(place))


# File, start of the block of the file that one task reads, and a number that grows within the block.
PLACE = ["_file", "_block", "_place"]


def number_rows(table: DataFrame) -> DataFrame:
    """Replaces the places of a raw table by ``row_id``: 0, 1, ... in the order of file name and place in the file.

    The table is stored first, so the number is made once. The window below holds one row for each block of a file.
    """
    file, block, place = PLACE
    kept = stored(table, "raw-rows")
    blocks = kept.groupBy(file, block).agg(F.min(place).alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return kept.join(starts, [file, block]).withColumn(ROW_ID, F.col("_start") + F.col(place) - F.col("_least")) \
        .drop(*PLACE, "_start", "_least")


def _marks_as_null(raw: DataFrame) -> DataFrame:
    return raw.withColumns({c: F.when(~F.col(f"`{c}`").isin(MISSING_MARKS), F.col(f"`{c}`")) for c in raw.columns if c not in PLACE})


def load_raw(spark: SparkSession, path: str, headers: Sequence[str] | None = None, by_name: bool = False, multi_line: bool = False,
             places: bool = False) -> DataFrame:
    """Raw CSV with header, every column as text and missing marks as null. A missing file fails at once.

    Pass ``RAW_HEADERS`` to insist on the usual columns, ``by_name`` for files with columns of their own order.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Missing file: {path}")
    return _marks_as_null(_read_text(spark, path, headers, by_name, multi_line, places))


def load_dataset(spark: SparkSession, path: str, headers: Sequence[str] | None = None, by_name: bool = False,
                 multi_line: bool = False, places: bool = False) -> DataFrame:
    """Raw CSV with normalised headers and typed time columns."""
    return load_raw(spark, path, headers, by_name, multi_line, places).transform(standardize_columns).transform(parse_times)


def load_clean(spark: SparkSession, path: str, headers: Sequence[str] | None = None, by_name: bool = False,
               multi_line: bool = False) -> DataFrame:
    """The cleaned sessions of raw files, ready for the feature table. Rows of files without a row number get one."""
    typed = load_dataset(spark, path, headers, by_name, multi_line, places=True)
    if ROW_ID in typed.columns:
        numbered = typed.drop(*PLACE).withColumn(ROW_ID, F.col(ROW_ID).cast("bigint"))
    else:
        numbered = number_rows(typed)
    return prepare_dataset(numbered)


def read_daily(spark: SparkSession, path: str, parse_dates: bool = True) -> DataFrame:
    """Stored daily aggregate (CSV); the date column typed, or left as text."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Missing daily aggregate file: {path}")
    text = _read_text(spark, path, None)
    kinds = {f.name: f.dataType for f in DAILY_SCHEMA.fields if f.name in text.columns}
    if not parse_dates:
        kinds.pop("session_date", None)
    return text.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def read_pruned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, renamed; the rest is never read from a columnar source."""
    return df.select(*[F.col(c).alias(new) for c, new in columns.items()])


def daily_or_rebuild(spark: SparkSession, daily_path: str, sessions: DataFrame) -> DataFrame:
    """The stored daily table if there is one, else sessions per station and day."""
    if path_exists(spark, daily_path):
        stored = spark.read.parquet(daily_path)
        return stored.select(STATION, "session_date", "total_sessions")
    keyed = sessions.withColumn("session_date", session_date(START))
    keyed = keyed.filter(F.col(STATION).isNotNull() & F.col("session_date").isNotNull())
    return keyed.groupBy(STATION, "session_date").agg(F.count(F.lit(1)).alias("total_sessions"))
