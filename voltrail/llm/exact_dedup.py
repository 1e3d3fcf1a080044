"""Exact duplicates by heavy-hitter split.

Rows are reduced to a SHA-256 digest of their text without ASCII white space. A Misra-Gries summary
(``approx_top_k``) over the digests names the few that may be frequent; their exact sizes and winners are computed with
map-side aggregation and broadcast, so that the copies of a frequent text never meet in a task. All other digests
occur at most ``1 / HEAVY_SHARE`` of the rows and are grouped by an ordinary shuffle of digests.
Everything runs in DataFrame functions.

Defined results: a null text is an empty text, and empty texts are copies of each other. A null id comes after
all others. Rows that are alike in id and text are copies of each other and exactly one row of a group stays.
An empty table gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.llm.common import SPACES, cut, fresh, store, text_of

#: A digest is frequent when it has more than one row in so many. At most as many digests can be frequent.
HEAVY_SHARE = 2000
#: Counters of the summary: it misses no digest that has more than one row in so many (it may track others too).
TRACKED = 10000


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, SPACES + "+", "").cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n, digest) per document; n is the length in code points."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("n"), digest_of(text).alias("digest"))


def _rank() -> Column:
    """The least value stays: longest text, then smallest id, then the first stored row."""
    return F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))


def frequent(rows: DataFrame) -> DataFrame:
    """The winners of frequent digests, verified by exact counts: at most ``HEAVY_SHARE`` rows."""
    summary = rows.select(F.xxhash64("digest").alias("key")).agg(
        F.expr(f"approx_top_k(key, {TRACKED}, {TRACKED})").alias("top"), F.count("*").alias("rows"))
    likely = summary.select(F.explode("top").alias("t"), "rows").where(F.col("t.count") * HEAVY_SHARE > F.col("rows")) \
        .select(F.col("t.item").alias("key"), "rows")
    exact = rows.withColumn("key", F.xxhash64("digest")).join(F.broadcast(likely), "key") \
        .groupBy("digest").agg(F.count("*").alias("group_size"), F.min(_rank()).alias("best"), F.max("rows").alias("rows"))
    return cut(exact.where(F.col("group_size") * HEAVY_SHARE > F.col("rows"))
               .select("digest", F.col("group_size").alias("heavy_size"), F.col("best.id").alias("heavy_id"),
                       F.col("best.row").alias("heavy_row")))


def label_digests(rows: DataFrame) -> DataFrame:
    """``rows``: stored (id, n, digest, row). Adds keep_id, group_size and kept."""
    split = rows.join(F.broadcast(frequent(rows)), "digest", "left")
    heavy = split.where(F.col("heavy_size").isNotNull()).select(
        "id", "n", "digest", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"),
        (F.col("row") == F.col("heavy_row")).alias("kept"))
    group = Window.partitionBy("digest")
    light = split.where(F.col("heavy_size").isNull()) \
        .withColumn("best", F.min(_rank()).over(group)).withColumn("group_size", F.count("*").over(group)) \
        .select("id", "n", "digest", F.col("best.id").alias("keep_id"), "group_size",
                (F.col("row") == F.col("best.row")).alias("kept"))
    return heavy.unionByName(light)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = store(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    return label_digests(rows).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                                      F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are matched to the labels by id, digest and length. Where ids repeat, one row of each match stays.
    """
    key, text = fresh(docs, "key"), text_of(text_col)

    def key_of(row_id: Column, n: Column, digest: Column) -> Column:
        return F.struct(row_id.isNull().alias("no_id"), row_id.alias("id"), n.alias("n"), digest.alias("digest")).alias(key)

    rows = store(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    kept = label_digests(rows).where("kept").select(key_of(F.col("id"), F.col("n"), F.col("digest")))
    held = docs.withColumn(key, key_of(F.col(id_col), F.char_length(text), digest_of(text))).join(kept, key, "left_semi")
    unique = rows.groupBy("id").count().where("count > 1").isEmpty()
    return (held if unique else held.dropDuplicates([key])).select(*[F.col(f"`{c}`") for c in docs.columns])
