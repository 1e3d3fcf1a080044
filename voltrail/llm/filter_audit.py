"""What a chain of filters removes in every order, counted by incremental retraction streaming.

All files of the table are processed as micro-batches until none is left. Four filters depend on a text alone and are a mask of
bits; the fifth fails a text that a smaller id has too, which a later file can change. So each text has a state: its smallest
id so far and what was counted for it. A smaller id takes the place of the old one, whose counts are retracted and counted
again as repeated. Texts share a state's page by hash, about ``PAGE`` to a page whatever the size of the table. The stream's result is a table of changes (part, mask, good, toxic, n) that add up to exact counters, at
most 32 masks of a part. All orders, steps and shares then follow from these counters without another look at the texts.

Equal texts are summed in every task before they are shuffled to their state, so a text of very many rows costs
one row for each task, part and label; the state of a text is its smallest id and one count for each part and label there. The changes are
summed in every task before they are written. The stream's checkpoint and its sink lie in the shared folder; a file sink
with its log keeps each batch's changes exactly once, whichever task or driver is lost. For corpora whose states
exceed the executors' memory set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.

Defined results: a null text is empty; the empty text has no words, so A fails it and B, C and D do not. A null language, or an
empty one, is the part ''. Rows with equal ids have no smaller one among each other. A null id is larger than any other, and rows
without ids are equal. A document has a label if any of its rows in the labels has it; repeated rows of labels change nothing.
Very long texts are whole. An empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltrail.llm.common import SPACES, ship_code, store, table, text_of
from voltrail.session import scratch_path

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Files of a micro-batch.
FILES = 64
#: Distinct texts that a task sums before it hands them on.
HELD = 50000
#: Texts of a page on average; a call of the state's function serves one page.
PAGE = 64
NO_ID = (1 << 63) - 1
CHANGES = "part string, mask int, good boolean, toxic boolean, n long"


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone: A, B, C, D."""
    words = F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(text_key, id, part, mask, good, toxic), one row for each document, batch or stream."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")) \
        .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # the text is cut down to its key and mask before the join
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")) \
        .select(F.unhex(F.sha2("text", 256)).alias("text_key"), "id", "part", text_mask(F.col("text")).alias("mask"))
    return rows.join(store(marks, "marks"), "id", "left") \
        .select("text_key", F.coalesce("id", F.lit(NO_ID)).alias("id"), "part", "mask",
                F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def summed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task summed by text, part and label: those at the text's smallest id there, and the others as repeats (n < 0)."""
    held: dict[tuple, list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*key, row[0], row[1], *kind, sign * n) for key, row in held.items()
                for sign, counts in ((1, row[2]), (-1, row[3])) for kind, n in counts.items()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()))],
                               ["page", "text_key", "id", "mask", "part", "good", "toxic", "n"])

    for batch in batches:
        for page, text, own, part, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            row = held.get((page, text))
            if row is None:
                held[page, text] = [own, mask, Counter({(part, good, toxic): 1}), Counter()]
            elif own == row[0]:
                row[2][part, good, toxic] += 1
            elif own > row[0]:
                row[3][part, good, toxic] += 1
            else:
                row[3].update(row[2])
                row[0], row[2] = own, Counter({(part, good, toxic): 1})
        if len(held) >= HELD:
            yield flush()
            held.clear()
    if held:
        yield flush()


def update_page(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by new rows of a page's texts. State: the texts, their smallest ids, and their counts there."""
    texts: dict[bytes, list] = {}  # smallest id, counts there
    if state.exists:
        texts = {bytes(text): [own, Counter({tuple(k[:3]): k[3] for k in json.loads(counts)})] for text, own, counts in zip(*state.get)}
    changes: Counter = Counter()
    for frame in frames:
        for text, own, mask, part, good, toxic, n in zip(*(frame[c].tolist() for c in ("text_key", "id", "mask", "part", "good", "toxic", "n"))):
            if n < 0:
                changes[part, mask | REPEATED, good, toxic] -= n
                continue
            known = texts.get(text)
            if known is not None and own > known[0]:
                changes[part, mask | REPEATED, good, toxic] += n
                continue
            if known is None:
                known = texts[text] = [own, Counter()]
            elif own < known[0]:  # what was counted at the old id is retracted and counted as repeated
                for kind, m in known[1].items():
                    changes[kind[0], mask, *kind[1:]] -= m
                    changes[kind[0], mask | REPEATED, *kind[1:]] += m
                known[:] = own, Counter()
            known[1][part, good, toxic] += n
            changes[part, mask, good, toxic] += n
    state.update((list(texts), [t[0] for t in texts.values()], [json.dumps([(*kind, n) for kind, n in t[1].items()]) for t in texts.values()]))
    yield pd.DataFrame([(*kind, n) for kind, n in changes.items() if n], columns=["part", "mask", "good", "toxic", "n"])


def summed_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for *key, n in zip(*(c.to_pylist() for c in batch.columns)):
            total[tuple(key)] += n
    rows = [(*key, n) for key, n in total.items() if n]
    if rows:
        part, mask, good, toxic, n = zip(*rows)
        yield pa.record_batch([pa.array(part, pa.string()), pa.array(mask, pa.int32()), pa.array(good), pa.array(toxic), pa.array(n, pa.int64())],
                              ["part", "mask", "good", "toxic", "n"])


def stream_changes(docs: DataFrame, labels: DataFrame, pages: int, **columns: str) -> DataFrame:
    """The changes of the counters from a stream of documents."""
    ship_code(docs.sparkSession)
    paged = judged(docs, labels, **columns).select(F.pmod(F.xxhash64("text_key"), F.lit(pages)).alias("page"), "*")
    texts = paged.mapInArrow(summed_texts, f"page long, text_key binary, id long, {CHANGES.replace('part string, mask int', 'mask int, part string')}")
    changes = texts.groupBy("page").applyInPandasWithState(
        update_page, CHANGES, "texts array<binary>, ids array<long>, counts array<string>", "append", GroupStateTimeout.NoTimeout)
    return changes.mapInArrow(summed_changes, CHANGES)


def any_file(path: str) -> str:
    """A pattern that only ``path`` fits: the file source takes a folder, or a pattern of folders and files."""
    return f"{path[:-1]}[{path[-1]}]"


def counters(spark: SparkSession, path: str, labels: DataFrame, files: int = FILES, **columns: str) -> DataFrame:
    """(part, mask, good, toxic, n) over all Parquet files below ``path``, each file read once by a stream."""
    whole = spark.read.parquet(path)
    pages = max(1, whole.count() // PAGE)
    docs = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files).parquet(any_file(path))
    place = scratch_path(spark, "filter-audit")
    stream = stream_changes(docs, labels, pages, **columns).writeStream.format("parquet").outputMode("append") \
        .option("path", f"{place}/changes").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    found = spark.read.schema(CHANGES).parquet(f"{place}/changes")
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0")


def interactions(found: DataFrame) -> DataFrame:
    """All orders and steps from the counters. A filter's share is that of the orders in which it comes first of those that fail."""
    masks = found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"))
    orders = ["".join(o) for o in permutations(FILTERS)]
    rows = masks.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))) \
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = [F.instr("filter_order", name) for name in FILTERS]
    bit = sum((F.when(place == F.col("step"), 1 << i).otherwise(0) for i, place in enumerate(at)), F.lit(0))
    before = sum((F.when(place < F.col("step"), 1 << i).otherwise(0) for i, place in enumerate(at)), F.lit(0))
    rows = rows.withColumns({"bit": bit, "before": before})
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(F.lit(0))).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~earlier & ~fails).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr(f"{len(orders)} div bit_count(mask)")).otherwise(F.lit(0))).cast("long").alias("shapley"))


def audit(spark: SparkSession, sf_dir: str, files: int = FILES) -> DataFrame:
    """One row per part, order and step over ``documents`` with the marks of ``labels``."""
    return interactions(store(counters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"), files), "counters"))
