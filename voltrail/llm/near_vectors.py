"""Near-duplicate vectors by cross-polytope hashing, with every found pair verified.

Each table turns the vectors by two random rotations (three rounds of random signs and a fast Hadamard transform) and takes
for each the axis the vector lies closest to, with its sign; the two axes are the bucket. A vector lives in its home bucket of
every table and visits the buckets of its next best axes. Vectors that meet (home with home, or visitor with home) are
compared in double precision, and a pair counts in the first meeting only, which both can tell from their codes.

Very common vectors: a bucket of the first table with more than ``CORE_ROWS`` vectors has a pivot, and the vectors within half
the linking angle of it are its core. Any two of a core link by the triangle inequality, so they are counted and never
compared. What is left of a large bucket is compared in blocks of at most ``BLOCK`` by ``BLOCK`` vectors; only link counts
and the edges of a spanning forest leave a task, never all pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, and vectors of
different length never link. Repeated ids are vectors of their own. A null id comes after all others. An empty table gives
no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltrail.llm.cells import cells_of
from voltrail.llm.common import arrow_map, store
from voltrail.llm.components import components

TABLES, VISITS = 6, 3
CORE_ROWS = 256
BLOCK = 512
#: Groups up to this size are compared by shifted rows, larger ones by a matrix product.
SHORT = 24
SEED = 20240501


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; their length is a power of two."""
    n, out, step = rows.shape[1], rows, 1
    while step < n:
        pairs = out.reshape(len(out), n // (2 * step), 2, step)
        out = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(len(out), n)
        step *= 2
    return out / np.sqrt(n)


def hash_codes(vectors: np.ndarray, tables: int = TABLES, visits: int = VISITS) -> np.ndarray:
    """(rows, tables, 1 + visits): the home bucket and the buckets to visit, nearest first."""
    size = 1 << max(2, (vectors.shape[1] - 1).bit_length())  # fewer axes have fewer buckets than are visited
    padded = np.zeros((len(vectors), size))
    padded[:, :vectors.shape[1]] = vectors
    random = np.random.default_rng(SEED + size)
    codes = np.empty((len(vectors), tables, 1 + visits), np.int32)
    for table in range(tables):
        axes, lost = [], []
        for _ in range(2):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * random.choice((-1.0, 1.0), size))
            order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :1 + visits]
            picked = np.take_along_axis(turned, order, 1)
            axes.append(order * 2 + (picked < 0))
            lost.append(np.abs(picked[:, :1]) - np.abs(picked))
        # all ways to leave the nearest axis of one rotation, the least loss first
        ways = [(lost[0][:, i], axes[0][:, i], axes[1][:, 0]) for i in range(1, lost[0].shape[1])] \
            + [(lost[1][:, i], axes[0][:, 0], axes[1][:, i]) for i in range(1, lost[1].shape[1])]
        loss = np.stack([w[0] for w in ways], 1)
        first, second = np.stack([w[1] for w in ways], 1), np.stack([w[2] for w in ways], 1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :visits]
        codes[:, table, 0] = axes[0][:, 0] * (2 * size) + axes[1][:, 0]
        codes[:, table, 1:] = np.take_along_axis(first, best, 1) * (2 * size) + np.take_along_axis(second, best, 1)
    return codes


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def hashed(vectors: DataFrame) -> DataFrame:
    """``vectors``: (row, v) of finite non-zero arrays. Adds unit vectors u and codes, flat by table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for width in np.unique(lengths):
                part = batch.filter(pa.array(lengths == width))
                data = _doubles(part.column(1), width)
                data = data / np.abs(data).max(axis=1, keepdims=True)  # huge or tiny components keep a finite length
                unit = data / np.linalg.norm(data, axis=1, keepdims=True)
                codes = hash_codes(unit)
                yield pa.record_batch([part.column(0),
                                       pa.ListArray.from_arrays(np.arange(0, unit.size + 1, width, dtype=np.int32), pa.array(unit.ravel())),
                                       pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes[0].size, dtype=np.int32), pa.array(codes.ravel()))],
                                      ["row", "u", "codes"])

    return arrow_map(vectors.select("row", "v"), run, "row long, u array<double>, codes array<int>")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _compare(threshold: float, tables: int, visits: int):
    """Links within the cells of sorted rows (cell..., table, row, core, visitor, side, u, codes): (row, other, links)."""
    per = 1 + visits

    def counted(codes: np.ndarray, rows: np.ndarray, table: np.ndarray, visitor: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether this is the first meeting of each pair (i, j)."""
        keep = np.empty(len(i), bool)
        for start in range(0, len(i), 50000):
            a, b = i[start:start + 50000], j[start:start + 50000]
            ca, cb = codes[a], codes[b]
            home_home = ca[:, :, 0] == cb[:, :, 0]
            a_visits = (ca[:, :, 1:] == cb[:, :, :1]).any(axis=2)
            b_visits = (cb[:, :, 1:] == ca[:, :, :1]).any(axis=2)
            meets = home_home | a_visits | b_visits
            first = meets.argmax(axis=1)
            at = np.arange(len(a))
            # in one table: home with home, else the visit of the smaller row
            smaller_visits = np.where(rows[a] < rows[b], a_visits[at, first], b_visits[at, first])
            kind = np.where(home_home[at, first], 0, np.where(smaller_visits, 1, 2))
            here_visitor = np.where(visitor[a], rows[a], np.where(visitor[b], rows[b], -1))
            here = np.where(here_visitor < 0, 0, np.where(here_visitor == np.minimum(rows[a], rows[b]), 1, 2))
            keep[start:start + 50000] = (first == table[a]) & (kind == here)
        return keep

    def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        """Smallest member of each member's component."""
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def group(data: dict, low: int, high: int):
        u, side = data["u"][low:high], data["side"][low:high]
        core, visitor = data["core"][low:high], data["visitor"][low:high]
        if high - low <= 1:
            return
        linked = np.triu(u @ u.T >= threshold, 1)
        linked &= ~(visitor[:, None] & visitor[None, :])
        linked &= ~((core[:, None] == core[None, :]) & (core[:, None] >= 0))
        linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
        i, j = np.nonzero(linked)
        rows = data["row"][low:high]
        differ = rows[i] != rows[j]
        yield i[differ] + low, j[differ] + low

    def flush(data: dict, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(starts)
        n = len(data["row"])
        cell = np.repeat(np.arange(len(sizes)), sizes)
        pairs = []
        short = np.repeat(sizes <= SHORT, sizes)
        for shift in range(1, min(SHORT, n)):
            a = np.flatnonzero(short[:-shift] & (cell[:-shift] == cell[shift:]))
            if not len(a):
                break
            b = a + shift
            ok = ~(data["visitor"][a] & data["visitor"][b]) & ((data["core"][a] != data["core"][b]) | (data["core"][a] < 0)) \
                & ((data["side"][a] != data["side"][b]) | (data["side"][a] == 2)) & (data["row"][a] != data["row"][b])
            a, b = a[ok], b[ok]
            near = np.einsum("ij,ij->i", data["u"][a], data["u"][b]) >= threshold
            pairs.append((a[near], b[near], np.zeros(near.sum(), bool)))
        for k in np.flatnonzero(sizes > SHORT):
            for a, b in group(data, starts[k], starts[k + 1]):
                pairs.append((a, b, np.ones(len(a), bool)))
        if not pairs:
            return
        a, b, long = (np.concatenate(x) for x in zip(*pairs))
        if not len(a):
            return
        first = counted(data["codes"], data["row"], data["table"], data["visitor"], a, b)
        a, b, long = a[first], b[first], long[first]
        links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        seen = np.flatnonzero(links)
        top = forest(a[long], b[long], n)
        hung = np.flatnonzero(top != np.arange(n))
        rows = data["row"]
        row = np.concatenate((rows[seen], rows[a[~long]], rows[hung]))
        other = np.concatenate((rows[seen], rows[b[~long]], rows[top[hung]]))
        count = np.concatenate((links[seen], np.zeros(len(row) - len(seen), np.int64)))
        yield pa.record_batch([pa.array(row), pa.array(other), pa.array(count)], ["row", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(last: bool):
            nonlocal held
            whole = pa.Table.from_batches(held).combine_chunks()
            if not whole.num_rows:
                held = []
                return
            key = whole.column("cell").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            end = len(key) if last else edges[-2]
            if end == 0:
                held = whole.to_batches()
                return
            done = whole.slice(0, end)
            held = whole.slice(end).to_batches()
            lengths = np.diff(done.column("u").chunk(0).offsets.to_numpy()) if done.num_rows else np.zeros(0, int)
            for width in np.unique(lengths):  # a cell has vectors of one length
                part = done.filter(pa.array(lengths == width)).combine_chunks()
                keys = part.column("cell").to_numpy()
                starts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
                column = {c: part.column(c).to_numpy() for c in ("row", "core", "side", "table")}
                column["visitor"] = part.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
                column["u"] = _doubles(part.column("u").combine_chunks(), width)
                column["codes"] = part.column("codes").combine_chunks().flatten().to_numpy().reshape(len(keys), tables, per)
                yield from flush(column, starts)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4096:
                yield from work(False)
        if held:
            yield from work(True)

    return run


def links(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``vectors``: (row, v). Returns counts (row, n_links) and edges (a, b) that connect what links."""
    per = 1 + VISITS
    rows = store(hashed(vectors), "hashed")
    first = rows.withColumn("home", F.element_at("codes", 1)).withColumn("width", F.size("u"))
    pivots = first.groupBy("width", "home").agg(F.count("*").alias("n"), F.min_by("u", "row").alias("pivot"), F.min("row").alias("core")) \
        .where(F.col("n") > CORE_ROWS).drop("n")
    half = float(np.sqrt((1 + threshold) / 2)) + 1e-7
    cored = store(first.join(pivots, ["width", "home"], "left")
                  .withColumn("core", F.when(F.when(F.col("pivot").isNotNull(), _dot("u", "pivot")) >= half, F.col("core")).otherwise(-1))
                  .select("row", "u", "codes", "core", "width"), "cored")

    spots = F.array(*[F.struct(F.lit(t).alias("table"), F.element_at("codes", t * per + k + 1).alias("bucket"), F.lit(k > 0).alias("visitor"))
                      for t in range(TABLES) for k in range(per)])
    places = cored.select("row", "core", "width", F.explode(spots).alias("s")).select("row", "core", "width", "s.*")
    unit = F.when(F.col("core") >= 0, F.col("core")).otherwise(-1 - F.col("row"))
    key = ["width", "table", "bucket"]
    buckets = places.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(~F.col("visitor")).alias("homes"), F.min(unit).alias("u0"), F.max(unit).alias("u1"),
        F.count_if(F.col("core") >= 0).alias("in_core"), F.min(F.when(F.col("core") >= 0, F.col("core"))).alias("c0"),
        F.max("core").alias("c1")) \
        .where("homes > 0 and n > 1 and u0 != u1") \
        .withColumn("one_core", (F.col("in_core") > 0) & (F.col("c0") == F.col("c1")) & (F.col("n") > BLOCK)) \
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.when(F.col("one_core"), F.col("n") - F.col("in_core")).otherwise(F.col("n")) / BLOCK)).cast("int")) \
        .withColumn("core_parts", F.when(F.col("one_core"), F.ceil(F.col("in_core") / BLOCK).cast("int")).otherwise(0)) \
        .select(*key, "one_core", "parts", "core_parts")
    cells = cells_of("row", F.col("one_core") & (F.col("core") >= 0))
    dealt = places.join(buckets, key).withColumn("c", F.explode(cells)) \
        .select("row", "table", "visitor", F.col("c.side").alias("side"), F.xxhash64(*key, "c.x", "c.y").alias("cell"))
    # the vectors travel once for each cell, and only to cells with something to compare
    loaded = dealt.join(cored.select("row", "u", "codes", "core"), "row")
    spread = loaded.repartition("cell").sortWithinPartitions("cell") \
        .select("cell", "table", "row", "core", "visitor", "side", "u", "codes")
    found = store(arrow_map(spread, _compare(threshold, TABLES, VISITS), "row long, other long, links long"), "links")
    in_cores = cored.where("core >= 0")
    alike = in_cores.groupBy("core").agg((F.count("*") - 1).alias("links"))
    counts = found.where("links > 0").select("row", "links") \
        .unionByName(in_cores.join(alike, "core").select("row", "links")) \
        .groupBy("row").agg(F.sum("links").alias("n_links"))
    edges = found.where("row != other").select(F.col("row").alias("a"), F.col("other").alias("b")) \
        .unionByName(in_cores.where("row != core").select(F.col("row").alias("a"), F.col("core").alias("b")))
    return counts, edges


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = store(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
                 .withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts, edges = links(rows.where(whole).select("row", "v"), threshold)
    joined = rows.select("vec_id", "row").join(components(edges).withColumnRenamed("node", "row"), "row", "left") \
        .withColumn("component", F.coalesce("component", "row"))
    least = joined.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return joined.join(least, "component").join(counts, "row", "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id",
                F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
