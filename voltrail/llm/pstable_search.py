"""Nearest vectors by multiprobe p-stable hashing, with exact inner products of all that is found.

Largest inner products become smallest distances: vectors are scaled by the largest length of their band and get one more axis that fills
their length up to 1, queries are scaled to 1. A band holds the lengths between two powers of two, so that one very long
vector does not press all others together. In every table ``M`` random projections, cut in steps of equal width, name the
bucket of a vector; M grows with the logarithm of the band's vectors, so that buckets stay about as large.

A query knows how likely a neighbour lies in each bucket: its projections differ from the query's by a normal deviate times the
distance. It visits buckets in the order of this estimate, the home bucket's neighbours mixed as they come, until the estimates of a table
reach ``GOAL`` of all tables together. There is no limit of buckets, candidates or results. The distance is learned from
``SAMPLE`` queries compared with all vectors (linear work), the steps' width from ``SPREAD`` vectors. What the tables
find is merged and ranked by the exact inner product, in double precision, summed in the order of the axes.

Equal vectors are one class with the few smallest ids that can be in a result, so that a very common vector is one entry of the index
and its queries are one search. Buckets are dealt to groups; a group with too many vectors is cut in parts, all of which its queries visit.
A query that finds fewer neighbours than there are is compared with all vectors of its length, in the same blocks.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components takes no part, and vectors of different
length are no candidates of each other. A query is a row whose id is divisible by ``step``; a null id is none. Repeated ids are vectors
of their own, and a query leaves out its own row alone. Ties go to the smaller id, then the row stored first, null ids last. Fewer
candidates than ``k`` are all returned. An empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from voltrail.llm.common import arrow_map, store
from voltrail.llm.shingles import mixed

TABLES = 4
#: Probability, by the estimate, that a neighbour lies in a visited bucket of some table.
GOAL = 0.93
#: Vectors in a bucket on average, and the bits that a projection tells of them.
BUCKET, BITS = 64, 1.25
#: Width of a step, in typical distances of a vector from the mean.
STEP = 3.0
#: Bounded samples: queries from which the distance of neighbours is learned, vectors from which the spread is.
SAMPLE, SPREAD = 64, 1024
#: Vectors of a group, and queries that a task compares with a group at once.
GROUP, BLOCK = 4096, 256
NO_ID = (1 << 63) - 1
SEED = 20240504


@dataclass
class Index:
    """The tables over the vectors of one length and one band of norms."""

    number: int
    width: int
    band: int
    top: float  # logarithm of the largest norm
    functions: int
    step: float
    distance: float
    groups: int

    @property
    def tables(self) -> int:
        return TABLES if self.functions else 1

    def first_group(self, table: int) -> int:
        return (self.number * TABLES + table) << 40

    def random(self, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Directions, shifts, and a factor for the step of each function in a bucket's number."""
        rng = np.random.default_rng([SEED, self.width, self.functions, table])
        return rng.standard_normal((self.width + 1, self.functions)), rng.uniform(0, self.step, self.functions), \
            rng.integers(0, 1 << 63, self.functions, np.uint64) * np.uint64(2) + np.uint64(1)

    def group_of(self, table: int, buckets: np.ndarray) -> np.ndarray:
        return self.first_group(table) + (buckets % np.uint64(self.groups)).astype(np.int64)

    def buckets(self, points: np.ndarray, table: int) -> np.ndarray:
        a, shift, factor = self.random(table)
        steps = np.floor((points @ a + shift) / self.step).astype(np.int64).view(np.uint64)
        return mixed((steps * factor).sum(axis=1, dtype=np.uint64))

    def probes(self, query: np.ndarray, table: int) -> np.ndarray:
        """Buckets to visit, the likeliest first."""
        a, shift, factor = self.random(table)
        if not self.functions:
            return self.buckets(query[None], table)
        y = query @ a + shift
        reach = int(np.ceil(5 * self.distance / self.step)) + 1
        steps = np.floor(y / self.step)[:, None] + np.arange(-reach, reach + 1)
        low = (steps * self.step - y[:, None]) / self.distance
        likely = normal(low + self.step / self.distance) - normal(low)
        codes = steps.astype(np.int64).view(np.uint64) * factor[:, None]
        return mixed(best_products(likely, codes, 1 - (1 - GOAL) ** (1 / self.tables)))


def normal(z: np.ndarray) -> np.ndarray:
    """Distribution function of the normal deviate, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, 1 - tail, tail)


def best_products(likely: np.ndarray, codes: np.ndarray, goal: float) -> np.ndarray:
    """Sums of one code a row, in falling order of the product of their probabilities, until these add up to ``goal``.

    Only products above a floor are multiplied out; the floor sinks until they suffice.
    """
    order = np.argsort(-likely, axis=1, kind="stable")
    likely, codes = np.take_along_axis(likely, order, 1), np.take_along_axis(codes, order, 1)
    rest = np.append(np.cumprod(likely[::-1, 0])[::-1][1:], 1.0)
    floor = likely[:, 0].prod() / 4
    while True:
        p, c = np.ones(1), np.zeros(1, np.uint64)
        for i in range(len(likely)):
            own = likely[i][likely[i] > 0]
            product = (p[:, None] * own).ravel()
            keep = product * rest[i] >= floor
            p, c = product[keep], (c[:, None] + codes[i, :len(own)]).ravel()[keep]
        if p.sum() >= goal or floor < 1e-12:
            break
        floor /= 4
    order = np.argsort(-p, kind="stable")
    return c[order[:int(np.searchsorted(np.cumsum(p[order]), goal)) + 1]]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # huge or tiny components keep a finite length
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def points(rows: np.ndarray, lognorm: np.ndarray, top: float) -> np.ndarray:
    """Vectors on the unit sphere with one more axis."""
    part = np.exp2(lognorm - top)[:, None]
    return np.append(units(rows) * part, np.sqrt(np.maximum(0, 1 - part * part)), axis=1)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the axes: equal whatever else is in a task."""
    total = np.zeros(len(rows))
    for x, y in zip(queries.T, rows.T):
        total += x * y
    return total


def by_width(batch: pa.RecordBatch, name: str = "v") -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one vector length at a time."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        part = batch.filter(pa.array(widths == width))
        yield width, part, matrix(part.column(name), width)


def classes_of(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (row, id, h1, h2), and classes of equal vectors (h1, h2, cls, least, members, v, width, lognorm, band).

    ``members`` are the k + 1 smallest; more cannot be in a result.
    """
    kind = vectors.schema[vector_col].dataType
    exact = kind if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else T.ArrayType(T.DoubleType())
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = store(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(exact).alias("v")).where(whole)
                 .withColumns({"row": F.monotonically_increasing_id(), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.col("v"))}), "vectors")
    first = Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last(), "row")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("largest")) * (x / F.col("largest")))
    classes = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("h1", "h2") \
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("least"), "row", "id"))).alias("members"), F.first("v").alias("v")) \
        .withColumns({"cls": F.col("members")[0]["row"], "least": F.col("members")[0]["least"], "width": F.size("v"), "largest": largest}) \
        .withColumn("lognorm", F.log2("largest") + F.log2(squares) / 2).withColumn("band", F.floor("lognorm").cast("int"))
    return rows.select("row", "id", "h1", "h2"), store(classes.drop("largest"), "classes")


def nearest_of_sample(classes: DataFrame, sample: list, k: int, top: float) -> dict[int, list[float]]:
    """For each vector length the k-th largest products of the sample, with all vectors, in parts of the longest norm."""
    by = {}
    for row in sample:
        by.setdefault(len(row.v), []).append(row)
    of = {w: (units(np.array([r.v for r in rows], np.float64)), np.array([r.cls for r in rows])) for w, rows in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {w: np.full((len(q), k), -1.0) for w, (q, _) in of.items()}
        for batch in batches:
            for width, part, rows in by_width(batch):
                if width in of:
                    q, own = of[width]
                    value = q @ (units(rows) * np.exp2(part.column("lognorm").to_numpy() - top)[:, None]).T
                    value[own[:, None] == part.column("cls").to_numpy()[None, :]] = -1.0
                    both = np.append(best[width], value, axis=1)
                    best[width] = -np.partition(-both, k - 1, axis=1)[:, :k]
        for width, found in best.items():
            yield pa.record_batch([pa.array([width] * len(found)), pa.array(of[width][1]), pa.array(list(found), pa.list_(pa.float64()))], ["width", "cls", "best"])

    found = arrow_map(classes.select("cls", "width", "lognorm", "v"), run, "width long, cls long, best array<double>") \
        .groupBy("width", "cls").agg(F.sort_array(F.flatten(F.collect_list("best")), False)[k - 1].alias("kth"))
    out: dict[int, list[float]] = {}
    for row in found.collect():  # one row for each query of the sample
        out.setdefault(row.width, []).append(row.kth)
    return out


def plan(classes: DataFrame, queries: DataFrame, k: int) -> list[Index]:
    """An index for each length and band, with the width of its steps and the distance of neighbours."""
    sizes = classes.groupBy("width", "band").agg(F.count("*").alias("n"), F.max("lognorm").alias("top")).orderBy("width", "band").collect()
    if not sizes:
        return []
    sample = queries.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("cls", "v").collect()
    spread = classes.orderBy(F.xxhash64("cls"), "cls").limit(SPREAD).select("width", "band", "lognorm", "v").collect()
    longest = max(s.top for s in sizes)
    kth = nearest_of_sample(classes, sample, k, longest)
    out = []
    for s in sizes:
        scale = 2.0 ** min(1000.0, longest - s.top)
        reached = kth.get(s.width, [-1.0])
        if min(reached) * scale > 1:  # no vector of the band reaches any k-th neighbour
            distance = 0.05
        else:
            distance = math.sqrt(max(2 - 2 * min(1.0, max(-1.0, float(np.mean(reached)) * scale)), 0.0025))
        own = [r for r in spread if (r.width, r.band) == (s.width, s.band)]
        typical = 1.0
        if len(own) > 1:
            x = points(np.array([r.v for r in own], np.float64), np.array([r.lognorm for r in own]), s.top)
            typical = max(float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())), 0.05)
        functions = max(0, round(math.log2(max(1.0, s.n / BUCKET)) / BITS))
        out.append(Index(len(out), s.width, s.band, s.top, functions, STEP * typical, distance, max(1, -(-s.n // GROUP))))
    return out


def indexed(classes: DataFrame, indexes: list[Index]) -> DataFrame:
    """(grp, bucket, cls, least, v): each vector once for every table."""
    by = {(i.width, i.band): i for i in indexes}
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part, rows in by_width(batch):
                bands = part.column("band").to_numpy()
                for band in np.unique(bands).tolist():
                    index, here = by[width, band], np.flatnonzero(bands == band)
                    some = part.take(pa.array(here))
                    x = points(rows[here], some.column("lognorm").to_numpy(), index.top)
                    for table in range(index.tables):
                        buckets = index.buckets(x, table)
                        yield pa.record_batch([pa.array(index.group_of(table, buckets)), pa.array(buckets.view(np.int64)), some.column("cls"), some.column("least"),
                                               some.column("width"), some.column("v")], ["grp", "bucket", "cls", "least", "width", "v"])

    return arrow_map(classes.select("cls", "least", "width", "lognorm", "band", "v"), run, f"grp long, bucket long, cls long, least long, width int, v {kind}")


def probed(queries: DataFrame, indexes: list[Index]) -> DataFrame:
    """(grp, query, width, v, buckets): the groups a query visits, and the buckets there."""
    kind = queries.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part, rows in by_width(batch):
                x = np.append(units(rows), np.zeros((len(rows), 1)), axis=1)
                for i in range(len(x)):
                    groups, lists = [], []
                    for index in (index for index in indexes if index.width == width):
                        for table in range(index.tables):
                            buckets = index.probes(x[i], table)
                            group = index.group_of(table, buckets)
                            order = np.argsort(group, kind="stable")
                            edges = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
                            groups += group[order][edges].tolist()
                            lists += np.split(buckets[order].view(np.int64), edges[1:])
                    n = len(groups)
                    yield pa.record_batch([pa.array(groups, pa.int64()), pa.array([part.column("cls")[i].as_py()] * n, pa.int64()), pa.array([width] * n, pa.int32()),
                                           part.column("v").take(pa.array([i] * n, pa.int64())), pa.array(lists, pa.list_(pa.int64()))],
                                          ["grp", "query", "width", "v", "buckets"])

    return arrow_map(queries.select("cls", "width", "v"), run, f"grp long, query long, width int, v {kind}, buckets array<long>")


def everywhere(queries: DataFrame, indexes: list[Index]) -> DataFrame:
    """Like ``probed``: all groups of one table, with all their buckets."""
    groups = F.lit(None).cast("array<long>")
    for i in indexes:
        groups = F.when((F.col("width") == i.width), F.concat(F.coalesce(groups, F.array().cast("array<long>")),
                        F.sequence(F.lit(i.first_group(0)), F.lit(i.first_group(0) + i.groups - 1)))).otherwise(groups)
    return queries.select(F.explode(groups).alias("grp"), F.col("cls").alias("query"), "width", "v", F.lit(None).cast("array<long>").alias("buckets"))


def compared(vectors: DataFrame, visits: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(query, found: array of (lower, least, cls)): the best of each query in each group it visits. ``lower`` is the negative product."""
    dealt = vectors.join(parts, "grp", "left").withColumn("part", F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1)))) \
        .select("grp", "part", F.lit(False).alias("asks"), "cls", "least", "bucket", "width", "v", F.lit(None).cast("array<long>").alias("buckets"))
    asked = visits.join(parts, "grp", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))) \
        .select("grp", "part", F.lit(True).alias("asks"), F.col("query").alias("cls"), F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("bucket"), "width", "v", "buckets")
    both = dealt.unionByName(asked).repartition("grp", "part").sortWithinPartitions("grp", "part", "asks")

    def answers(q: np.ndarray, keys: list[int], visits: list, held: dict, most: int) -> Iterator[tuple]:
        """The best of each query among the held vectors; all within rounding of the last one are multiplied again and ranked."""
        x, bucket, least, cls = held["x"], held["bucket"], held["least"], held["cls"]
        value = q @ x.T
        for i, buckets in enumerate(visits):
            here = np.arange(len(x)) if buckets is None else np.flatnonzero(held["in"](buckets))
            if not len(here):
                continue
            own = value[i, here]
            if len(here) > most:
                last = -np.partition(-own, most - 1)[most - 1]
                slack = 1e-9 * (np.abs(q[i]) @ held["reach"])
                here = here[~(own < last - slack)]
            exact = products(np.broadcast_to(q[i], (len(here), q.shape[1])), x[here])
            order = np.lexsort((cls[here], least[here], -exact))[:most]
            yield keys[i], [{"lower": -s, "least": m, "cls": c} for s, m, c in zip(exact[order].tolist(), least[here][order].tolist(), cls[here][order].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.list_(pa.struct([("lower", pa.float64()), ("least", pa.int64()), ("cls", pa.int64())]))
        at, held, parts = None, None, []

        def closed(width: int) -> dict | None:
            if not parts:
                return None
            x, bucket, least, cls = (np.concatenate(c) for c in zip(*parts))
            names, place = np.unique(bucket, return_inverse=True)

            def inside(buckets: np.ndarray) -> np.ndarray:
                marked = np.zeros(len(names) + 1, bool)
                spot = np.searchsorted(names, buckets)
                hit = names[np.minimum(spot, len(names) - 1)] == buckets
                marked[spot[hit]] = True
                return marked[place]

            return {"x": x, "bucket": bucket, "least": least, "cls": cls, "in": inside, "reach": np.abs(x).max(axis=0)}

        for batch in batches:
            group, part, asks = batch.column("grp").to_numpy(), batch.column("part").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            new = np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]))
            for low, high in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), batch.num_rows]):
                if at != (group[low], part[low]):
                    at, held, parts = (group[low], part[low]), None, []
                for start in range(low, high, BLOCK if asks[low] else GROUP):
                    some = batch.slice(start, min(high, start + (BLOCK if asks[low] else GROUP)) - start)
                    x = matrix(some.column("v"), some.column("width")[0].as_py())  # a group has vectors of one length
                    if not asks[low]:
                        parts.append((x, *(some.column(c).to_numpy() for c in ("bucket", "least", "cls"))))
                        continue
                    held = held or closed(x.shape[1])
                    if held is None:
                        continue
                    lists = [None if b.as_py() is None else b.values.to_numpy() for b in some.column("buckets")]
                    out = list(answers(x, some.column("cls").to_pylist(), lists, held, k + 1))
                    yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], found)], ["query", "found"])

    return arrow_map(both, run, "query long, found array<struct<lower: double, least: long, cls: long>>")


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query, found): the k + 1 best classes of each query, once each."""
    every = found.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("all"))
    once = F.filter("all", lambda x, i: (i == 0) | (x["cls"] != F.get(F.col("all"), i - 1)["cls"]))
    return every.select("query", F.slice(once, 1, k + 1).alias("found"))


def neighbours(found: DataFrame, classes: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(id, row, cls, near: the k best rows) of each query row, from the best classes. ``asking``: (id, row, cls)."""
    best = found.select("query", F.explode("found").alias("f")).select("query", "f.lower", "f.cls")
    near = best.join(classes.select("cls", "members"), "cls") \
        .select("query", F.transform("members", lambda m: F.struct(F.col("lower").alias("lower"), m["least"].alias("least"), m["row"].alias("row"), m["id"].alias("id"))).alias("rows")) \
        .groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"))
    return asking.join(near, F.col("cls") == F.col("query"), "left") \
        .select("id", "row", "cls", F.slice(F.filter(F.coalesce("rows", F.array()), lambda x: x["row"] != F.col("row")), 1, k).alias("near"))


def search(vectors: DataFrame, k: int = 20, step: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``step``: query_id, rank, vec_id, score."""
    rows, classes = classes_of(vectors, k, id_col, vector_col)
    asking = store(rows.where(F.pmod("id", F.lit(step)) == 0).join(classes.select("h1", "h2", "cls", "width"), ["h1", "h2"]).select("id", "row", "cls", "width"), "queries")
    queries = store(classes.join(asking.select("cls").distinct(), "cls", "left_semi").select("cls", "width", "v"), "asked")
    indexes = plan(classes, queries, k)
    if not indexes:
        return asking.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    table = store(indexed(classes, indexes), "index")
    parts = store(table.groupBy("grp").agg(F.ceil(F.count("*") / (2 * GROUP)).alias("parts")).where("parts > 1"), "parts")
    found = store(merged(compared(table, probed(queries, indexes), parts, k), k), "found")
    near = store(neighbours(found, classes, asking.select("id", "row", "cls"), k), "near")
    # what found too little is compared with everything of its length
    counts = rows.join(classes.select("h1", "h2", "width"), ["h1", "h2"]).groupBy("width").agg((F.count("*") - 1).alias("others"))
    few = asking.join(near.select("row", F.size("near").alias("n")), "row").join(counts, "width").where("n < least(others, {})".format(int(k))).select("id", "row", "cls")
    few = store(few, "few")
    if few.limit(1).count():
        again = queries.join(few.select("cls").distinct(), "cls", "left_semi")
        exact = merged(compared(table, everywhere(again, indexes), parts, k), k)
        near = near.join(few.select("row"), "row", "left_anti").unionByName(neighbours(exact, classes, few, k))
    return near.select(F.col("id").alias("query_id"), F.posexplode("near").alias("place", "n")) \
        .select("query_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.lower")).alias("score"))
