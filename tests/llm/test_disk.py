"""What the near-copy join leaves on the machines' disks."""

import glob
import os
import random
import time
import zlib

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import functions as F

from voltrail.llm import jaccard as J
from voltrail.llm.common import store
from voltrail.llm.components import components


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for folder in manager.localDirsString() for f in glob.glob(f"{folder}/*/shuffle_*")}


def left_by(spark, run):
    """Shuffle files that outlive ``run``."""
    before, result = shuffle_files(spark), run()
    for _ in range(20):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    return left, result


def test_components_leave_no_shuffles(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(chain)
    edges = store(spark.createDataFrame(chain, "a long, b long"), "t")
    left, found = left_by(spark, lambda: components(edges))
    assert not left
    expected = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert {r.node: r.component for r in found.collect()} == expected and found.count() == len(expected)


def test_a_join_leaves_no_shuffles(spark, documents):
    text = lambda name, last: " ".join([f"{name}{i}" for i in range(60)] + [last])
    docs = store(documents([(i, text("ab"[i % 2], f"x{i}")) for i in range(20)]), "t")
    left, found = left_by(spark, lambda: J.jaccard_join(docs))
    assert not left
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 2 for i in range(20)}


def test_filters_are_as_large_as_their_values_need(spark):
    values = spark.range(100).select(J._bit("id"))
    name = J._wanted(values)
    assert os.path.getsize(SparkFiles.get(name)) < 2 * 100 * J.SPARSE // 8  # a power of two
    assert len(J._passing(name, values.toArrow().column(0).combine_chunks())) == 100
    others = spark.range(1000, 11000).select(J._bit("id")).toArrow().column(0).combine_chunks()
    assert len(J._passing(name, others)) < 10000 * 3 / J.SPARSE
    full = J._wanted(spark.range(J.FILTER_BITS // 8).select(F.pmod(F.xxhash64("id"), F.lit(J.FILTER_BITS)).alias("bit")))
    assert os.path.getsize(SparkFiles.get(full)) == J.FILTER_BITS // 8


def test_levels_are_as_many_as_their_tokens_need(spark, documents):
    docs = documents([(i, " ".join(f"w{i}_{j}" for j in range(50))) for i in range(20)])
    levels, common = J.publish_levels(J.described(docs.select(F.col("doc_id").alias("id"), "text")))
    data = np.fromfile(SparkFiles.get(levels), np.uint8)
    assert len(data) <= 8 * 20 * 46 and np.count_nonzero(data) and common > data.max()


def test_counters_are_packed():
    counters = np.random.default_rng(1).poisson(0.2, 1 << 16).astype(np.uint8)
    counters[5] = 255
    assert (J.unpacked(J.packed(counters), len(counters)) == counters).all()
    assert len(J.packed(counters)) < 0.75 * len(zlib.compress(counters.tobytes(), 1))
    for same in (0, 1, 255):
        assert (J.unpacked(J.packed(np.full(64, same, np.uint8)), 64) == same).all()


def test_shared_entries_are_dealt_once(spark, documents, monkeypatch):
    """An exchange by token for the lists, and none to drop what two tasks give."""
    plans = []
    kept = J.store
    monkeypatch.setattr(J, "store", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
    J.jaccard_join(kept(documents([(i, f"a b c d e f g h {i}") for i in range(40)]).repartition(3), "t"))
    (plan,) = [p for name, p in plans if name == "shared"]
    assert plan.count("Exchange") == 1
