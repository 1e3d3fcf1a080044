"""Language identification by nearest centroid.

A text becomes a vector of its letter n-grams (orders 1 to 3 of the lower-cased UTF-8 bytes, everything that is no letter
being a blank), hashed to ``DIMS`` places, weighted by TF-IDF and scaled to length one. Each language has several
centroids, found by spherical k-means on a bounded sample of its training texts (``SAMPLE`` for each language, chosen by
hash); document frequencies are counted over all training texts. A text gets the language of the centroid with the largest
cosine. ``rejected`` marks texts that lie further from it than nearly all of the centroid's own.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not rejected. Rows with null text or
language are not learned from. Equal cosines go to the first language in code point order. Without training
rows every text is ``und``. Repeated rows are judged each; very long texts are read whole. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.llm.common import arrow_map, cut, store
from voltrail.operators.joins import size_checked

DIMS = 4096
CENTROIDS = 4
#: Training texts of each language from which its centroids are clustered.
SAMPLE = 2000
ROUNDS = 12
#: A text is rejected when its cosine is below this quantile of the centroid's own texts, less the slack.
REJECT_QUANTILE, REJECT_SLACK = 0.005, 0.1

_LETTER = regex.compile(r"\p{L}").search
_BLANKS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def counts_of(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams, or None for a text without a letter."""
    if not text or not _LETTER(text):
        return None
    clean = b" " + b" ".join(text.lower().encode().translate(_BLANKS).split()) + b" "
    data = np.frombuffer(clean, np.uint8).astype(np.uint32)
    two = data[:-1] << 8 | data[1:]
    three = two[:-1] << 8 | data[2:]
    places = [(grams * np.uint32(2654435761) + np.uint32(order * 40503 * 65537 % (1 << 32))) >> np.uint32(20)
              for order, grams in ((1, data[1:-1]), (2, two), (3, three))]
    return np.bincount(np.concatenate(places), minlength=DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts.astype(np.float32)) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    nearest: np.ndarray  # least cosine that is not rejected

    def predict(self, counts: np.ndarray) -> list[tuple[str, float, bool]]:
        if not self.languages:
            return [("und", 0.0, False)] * len(counts)
        cosines = vectors(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        return [(self.languages[b], float(min(1.0, max(0.0, row[b]))), bool(row[b] < self.nearest[b]))
                for b, row in zip(best, cosines)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each place occurs, over all rows, and their number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = counts_of(text.as_py())
                if counts is not None:
                    seen += counts > 0
                    n += 1
        if n:
            places = np.flatnonzero(seen)
            yield pa.record_batch([pa.array(np.append(places, -1)), pa.array(np.append(seen[places], n))], ["place", "n"])

    total = np.zeros(DIMS, np.int64)
    docs = 0
    for row in arrow_map(rows.select("text"), count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        if row.place < 0:
            docs = row.n
        else:
            total[row.place] = row.n
    return total, docs


def _cluster(idf: np.ndarray, centroids: int, rounds: int):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "text"], kind="stable")
        counts = [c for c in map(counts_of, group["text"]) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "centroid": [], "nearest": []}, dtype=object)
        rows = vectors(np.array(counts, np.float32), idf)
        # start: texts that are far from those already chosen
        chosen = [0]
        far = 1 - rows @ rows[0]
        while len(chosen) < min(centroids, len(rows)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 1 - rows @ rows[chosen[-1]])
        centres = rows[chosen]
        for _ in range(rounds):
            own = (rows @ centres.T).argmax(axis=1)
            sums = np.array([rows[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        cosines = rows @ centres.T
        own, best = cosines.argmax(axis=1), cosines.max(axis=1)
        least = [float(np.quantile(best[own == k], REJECT_QUANTILE)) - REJECT_SLACK if (own == k).any() else 0.0
                 for k in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.astype(float).tolist() for c in centres], "nearest": least})
    return fit


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from the rows with text and language. The model has ``centroids`` vectors for each language."""
    rows = training.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                           F.col(text_col).cast("string").alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    seen, docs = _frequencies(rows)
    idf = (np.log((1 + docs) / (1 + seen)) + 1).astype(np.float32)
    # about twice the sample passes the hash limit of its language, so few rows are ranked
    # the filter runs in the scan: a row for each language is broadcast where these are counted to be few
    sizes = size_checked(cut(rows.groupBy("lang").agg((2.0 * sample / F.count("*")).alias("share"))))
    placed = rows.select("lang", "id", F.xxhash64("id").alias("place")).join(sizes, "lang") \
        .where(F.pmod("place", F.lit(1 << 32)) < F.col("share") * (1 << 32))
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 32)), "place", "id")
    keys = store(placed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
                 .select("lang", "id", "place").distinct(), "sample")
    # an id that repeats may bring more texts than were counted, so the limit holds again
    picked = rows.join(keys, ["lang", "id"]) \
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("n") <= sample) \
        .select("lang", "text", "place")
    found = picked.groupBy("lang").applyInPandas(_cluster(idf, centroids, ROUNDS), "lang string, centroid array<double>, nearest double").collect()
    found.sort(key=lambda r: r.lang.encode())
    return Model(idf, [r.lang for r in found], np.array([r.centroid for r in found], np.float32).reshape(-1, DIMS),
                 np.array([r.nearest for r in found]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected. The model is broadcast; its size is fixed by the languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts = [counts_of(t.as_py()) for t in part.column(1)]
                lettered = [c for c in counts if c is not None]
                answers = iter(shared.value.predict(np.array(lettered, np.float32)) if lettered else [])
                rows = [("und", 0.0, False) if c is None else next(answers) for c in counts]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.record_batch([part.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()),
                                       pa.array(columns[2], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(texts, run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Learn from the documents that are not held out and predict all. Adds ``held_out``."""
    model = fit(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col, sample)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
