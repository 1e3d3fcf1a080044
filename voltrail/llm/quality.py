"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on the look of a text (pairs of neighbouring character classes, repeated and capital words) gives each
document its evidence of being bad. How common bad documents are is learned for each host and each path of a host:
the known labels and, for all other documents, the classifier's probabilities are summed by (host, path), the rates of
hosts are shrunk to the rate of all documents and the rates of paths to their host's, with beta-binomial priors whose
strength comes from the spread of the rates. A document's posterior is the classifier's evidence under its path's rate, so
a sparse site is judged by its text alone.

The classifier is fitted on at most ``FIT_ROWS`` labelled documents, chosen by hash; everything else covers all documents.

Defined results: a null text is an empty text. A null host or path is a value of its own. Without labels of both kinds the
classifier says nothing, and documents are judged by the rates alone. Repeated ids are judged each by its own text, and a
document with contradicting labels counts as bad. Very long texts are read whole. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from voltrail.llm.common import arrow_map, fresh, give_back, ship_code, store, text_of
from voltrail.llm.empirical_bayes import overall_rate, shrunk

#: Labelled documents to fit the classifier on.
FIT_ROWS = 20000
#: A document is rejected from this posterior probability on.
REJECT = 0.5
#: Stands for a null host or path.
NO_NAME = "\x00"

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", *".,!?|*$%&#-_@=",
           "\"'`", ":;", "()[]{}", "<>", "/\\", "+~^"]
CLASSES = len(_GROUPS) + 2  # and bytes of other letters, and the rest


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 1, np.uint16)
    table[0x80:] = CLASSES - 2
    for number, members in enumerate(_GROUPS):
        table[list(members.encode())] = number
    return table


_CLASS = _class_table()
EXTRA = 6
FEATURES = CLASSES * CLASSES + EXTRA


def features(text: str) -> np.ndarray:
    """Square roots of the shares of class pairs, then shares of words: repeated, distinct, capital, with a mark at the end; length."""
    row = np.zeros(FEATURES, np.float32)
    kinds = _CLASS[np.frombuffer(text.encode(), np.uint8)]
    if len(kinds) > 1:
        row[:CLASSES * CLASSES] = np.sqrt(np.bincount(kinds[:-1] * np.uint16(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES) / (len(kinds) - 1))
    words = text.split()
    if words:
        n = len(words)
        distinct = set(words)
        row[-EXTRA:] = (sum(map(operator.eq, words, words[1:])) / n, len(distinct) / n,
                        sum(map(str.isupper, words)) / n, sum(not w[-1].isalnum() for w in distinct) / len(distinct),
                        np.log1p(n), len(text) / n / 20)
    return row


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    base: float  # log odds of bad among the documents it was fitted on

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Log likelihood ratio of bad to good."""
        if not texts:
            return np.zeros(0)
        return np.stack([features(t) for t in texts]).astype(np.float64) @ self.weights + self.intercept - self.base


def labels_of(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """(id, bad): one row for each labelled document."""
    return labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg((1 - F.min(quality_col)).cast("int").alias("bad"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """``labels``: (id, bad) from ``labels_of``."""
    chosen = labels.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # bounded, so it can be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = np.stack([features(t.as_py()) for t in part.column(1)])
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32), pa.array(rows.ravel()))],
                                      ["label", "values"])

    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id") \
        .select(F.col("bad").cast("double").alias("label"), "text")
    rows = store(arrow_map(texts, run, "label double, values array<float>"), "quality")
    n, bad = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or bad in (0, n):
        return Model(np.zeros(FEATURES), 0.0, 0.0)
    data = rows.select("label", array_to_vector(F.col("values").cast("array<double>")).alias("features"))
    found = LogisticRegression(maxIter=60, regParam=1e-4).fit(data)
    return Model(found.coefficients.toArray(), float(found.intercept), float(np.log(bad / (n - bad))))


def evidence(model: Model, text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.evidence(list(texts.iloc[i:i + 512])) for i in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        give_back()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NO_NAME))


def log_odds(rate: Column) -> Column:
    inside = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(inside / (1 - inside))


def probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def site_rates(scored: DataFrame) -> DataFrame:
    """``scored``: (host, path, bad), bad from 0 to 1. One row for each path: host, path, n, host_rate, rate."""
    paths = store(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = shrunk(hosts.crossJoin(F.broadcast(hosts.agg(overall_rate().alias("all_rate")))), "all_rate", "host_rate").select("host", "host_rate")
    return store(shrunk(paths.join(hosts, "host"), "host_rate", "rate").select("host", "path", "n", "host_rate", "rate"), "rates")


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, fit_rows: int) -> tuple[Model, DataFrame, DataFrame]:
    ship_code(docs.sparkSession)
    known = labels_of(labels)
    model = fit(docs, known, id_col, text_col, fit_rows)
    scored = store(docs.select(F.col(id_col).alias("id"), named(host_col).alias("host"), named(path_col).alias("path"),
                               evidence(model, text_of(text_col)).alias("evidence")), "evidence")
    alone = probability(F.col("evidence") + F.lit(model.base))
    rates = site_rates(scored.join(known, "id", "left").select("host", "path", F.coalesce(F.col("bad").cast("double"), alone).alias("bad")))
    return model, scored, rates


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
             path_col: str = "lang", fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, site_rate, p_bad, keep."""
    _, scored, rates = _learned(docs, labels, id_col, text_col, host_col, path_col, fit_rows)
    nameless = lambda c: F.when(F.col(c) != NO_NAME, F.col(c)).alias(c)
    return scored.join(rates, ["host", "path"]) \
        .withColumn("p_bad", probability(F.col("evidence") + log_odds(F.col("rate")))) \
        .select(F.col("id").alias("doc_id"), nameless("host"), nameless("path"), "evidence", F.col("rate").alias("site_rate"),
                "p_bad", (F.col("p_bad") < reject).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
              path_col: str = "lang", fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model, _, rates = _learned(docs, labels, id_col, text_col, host_col, path_col, fit_rows)
    host, path, rate = (fresh(docs, c) for c in ("site_host", "site_path", "site_rate"))
    sites = rates.select(F.col("host").alias(host), F.col("path").alias(path), F.col("rate").alias(rate))
    bad = probability(evidence(model, text_of(text_col)) + log_odds(F.col(rate)))
    return docs.withColumns({host: named(host_col), path: named(path_col)}).join(sites, [host, path]) \
        .where(bad < reject).select(*[F.col(f"`{c}`") for c in docs.columns])
