"""Forests and leaf-wise boosting on binned features, grown in Spark tasks from a bounded sample of labelled rows.

A feature is binned once: a number by at most ``BINS`` quantiles of the sample, a text by its one-hot slot, where a split is one
value against all others. A fit takes at most ``fitRows`` labelled rows, chosen by a hash, so what a task holds is bounded; any
number of rows is scored.

Forest: the trees of a block grow together, level by level. Rows are drawn with replacement by the tree's number. A tree without limits
holds those of every smaller depth and larger least split in it, and a forest those of fewer trees, so a search
grows one forest for each least leaf (``nested_errors``).

Boosting: each round splits the leaf of the largest gain first, until there are ``maxLeafNodes``; gains and values are shrunk by ``l2``. A
leaf's sums by bin are counted for its smaller child and subtracted for the other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltrail.models.preprocess import feature_names
from voltrail.schema import NUMERIC_FEATURES

BINS = 255
#: Bound on the labelled rows of a fit.
FIT_ROWS = 50_000
#: Trees that a task grows together.
BLOCK = 25
#: Rows that are scored together.
SCORED = 500
SEED = 42
NODE_FIELDS = {"tree": np.int32, "feature": np.int32, "at": np.int32, "left": np.int32, "right": np.int32, "value": np.float64, "rows": np.int32,
               "depth": np.int32, "gain": np.float64}


@dataclass
class Binning:
    """Slots of the feature vector by feature: a number's slot and edges, or the slots of a text's values."""

    low: list[int]
    high: list[int]
    edges: list[np.ndarray | None]
    size: int

    @property
    def widths(self) -> np.ndarray:
        return np.array([h - l + 1 if e is None else len(e) + 1 for l, h, e in zip(self.low, self.high, self.edges)])

    @property
    def one_value(self) -> np.ndarray:
        return np.array([e is None for e in self.edges])

    def codes(self, dense: np.ndarray) -> np.ndarray:
        out = np.empty((len(dense), len(self.low)), np.int32)
        for f, (low, high, edges) in enumerate(zip(self.low, self.high, self.edges)):
            if edges is not None:
                out[:, f] = np.searchsorted(edges, dense[:, low], side="left")
            else:
                part = dense[:, low:high]
                out[:, f] = np.where(part.any(axis=1), part.argmax(axis=1), high - low)
        return out


def learn_bins(names: Sequence[str], dense_numbers: np.ndarray) -> Binning:
    """``names``: feature of each slot; ``dense_numbers``: the sample's values of the numeric slots, in their order."""
    low, high, edges, at, number = [], [], [], 0, 0
    while at < len(names):
        end = at + 1
        if names[at] in NUMERIC_FEATURES:
            values = np.unique(dense_numbers[:, number])
            middle = (values[1:] + values[:-1]) / 2
            if len(values) > BINS:
                middle = np.unique(np.quantile(dense_numbers[:, number], np.arange(1, BINS) / BINS))
            edges.append(middle)
            number += 1
        else:
            while end < len(names) and names[end] == names[at]:
                end += 1
            edges.append(None)
        low.append(at)
        high.append(end)
        at = end
    return Binning(low, high, edges, len(names))


def dense_rows(vectors: pa.StructArray, size: int) -> np.ndarray:
    """Rows of unwrapped feature vectors, sparse or dense."""
    out = np.zeros((len(vectors), size))
    values = vectors.field("values")
    lengths = values.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), lengths)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sparse = np.repeat(vectors.field("type").to_numpy(zero_copy_only=False) == 0, lengths)
    slot[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)  # a dense vector has none
    out[row, slot] = values.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class Sample:
    """Binned rows on the driver: bounded by ``fitRows``."""

    binning: Binning
    codes: np.ndarray
    label: np.ndarray


def bounded(rows: DataFrame, fit_rows: int) -> DataFrame:
    """All rows, or about ``fit_rows`` of them chosen by a hash of their values."""
    n = rows.count()
    if n <= fit_rows:
        return rows
    key = F.pmod(F.xxhash64("label", F.col("features").cast("string")), F.lit(1 << 20))
    return rows.where(key < int(fit_rows / n * (1 << 20)))


def take(rows: DataFrame, fit_rows: int = FIT_ROWS, binning: Binning | None = None) -> Sample:
    """The sample of a table with ``features`` and ``label``, with bins of its own unless they are given."""
    names = feature_names(rows)
    table = bounded(rows, fit_rows).select(F.unwrap_udt("features").alias("v"), F.col("label").cast("double").alias("label")).toArrow()
    parts = [dense_rows(chunk.slice(i, 2000), len(names)) for chunk in table.column("v").chunks for i in range(0, len(chunk), 2000)]
    if binning is None:
        numbers = [i for i, n in enumerate(names) if n in NUMERIC_FEATURES]
        binning = learn_bins(names, np.concatenate([p[:, numbers] for p in parts]) if parts else np.zeros((0, len(numbers))))
    codes = np.concatenate([binning.codes(p) for p in parts]) if parts else np.zeros((0, len(binning.low)), np.int32)
    return Sample(binning, codes, table.column("label").to_numpy())


# --- forests --------------------------------------------------------------------------------------

def grow_forest(codes: np.ndarray, widths: np.ndarray, one_value: np.ndarray, y: np.ndarray, trees: Sequence[int],
                max_depth: int, min_leaf: int, min_split: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """Nodes of the trees of these numbers, which come first. Rows count once in ``rows`` however often a tree has drawn them."""
    n, drawn = len(y), []
    for tree in trees:
        weight = np.bincount(np.random.default_rng([seed, tree]).integers(0, n, n), minlength=n)
        row = np.flatnonzero(weight)
        drawn.append((row, weight[row].astype(np.float64)))
    row = np.concatenate([r for r, _ in drawn])
    weight = np.concatenate([w for _, w in drawn])
    node = np.repeat(np.arange(len(trees)), [len(r) for r, _ in drawn])
    total = weight * y[row]
    levels: list[dict[str, np.ndarray]] = []
    tree_of, made, depth = np.array(trees), len(trees), 0
    while True:
        m = len(tree_of)
        local = node - (made - m)
        rows, w, s = np.bincount(local, minlength=m), np.bincount(local, weight, m), np.bincount(local, total, m)
        level = {"tree": tree_of, "feature": np.full(m, -1), "at": np.zeros(m), "left": np.full(m, -1), "right": np.full(m, -1), "value": s / np.maximum(w, 1),
                 "rows": rows, "depth": np.full(m, depth), "gain": np.zeros(m)}
        levels.append(level)
        squares = np.bincount(local, weight * y[row] ** 2, m)
        spread = squares - s * s / np.maximum(w, 1)
        may = (rows >= max(min_split, 2 * min_leaf, 2)) & (spread > 1e-9 * np.maximum(squares, 1e-12))
        if depth >= max_depth or not may.any():
            break
        keep = may[local]
        row, weight, total, local = row[keep], weight[keep], total[keep], local[keep]
        # places of the nodes' entries once they are sorted by node
        rows, w, s = np.where(may, rows, 0), np.where(may, w, 0), np.where(may, s, 0)
        before, w0, s0 = (np.append(0, np.cumsum(x))[:-1] for x in (rows, w, s))
        whole = s * s / np.maximum(w, 1)
        close = 1e-9 * (spread + whole)  # gains as near as this are equal: the first feature and the lowest cut are taken
        best, chosen, at = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        for f, width in enumerate(widths.tolist()):
            key = local * width + codes[row, f]
            order = np.argsort(key)
            key = key[order]
            end = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
            of = key[end] // width
            sw, ss = np.cumsum(weight[order])[end], np.cumsum(total[order])[end]
            if one_value[f]:
                count, lw, ls = np.diff(end, prepend=-1), np.diff(sw, prepend=0), np.diff(ss, prepend=0)
            else:
                count, lw, ls = end + 1 - before[of], sw - w0[of], ss - s0[of]
            rw, rs = w[of] - lw, s[of] - ls
            ok = (count >= min_leaf) & (rows[of] - count >= min_leaf)
            end, of, lw, ls, rw, rs = end[ok], of[ok], lw[ok], ls[ok], rw[ok], rs[ok]
            if not len(of):
                continue
            gain = ls * ls / lw + rs * rs / rw - whole[of]
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            top = np.maximum.reduceat(gain, start)
            place = np.flatnonzero(gain >= np.repeat(top - close[of[start]], np.diff(np.append(start, len(of)))))
            _, one = np.unique(of[place], return_index=True)
            place = place[one]
            better = top > best[of[start]] + close[of[start]]
            nodes, place = of[start][better], place[better]
            best[nodes], chosen[nodes], at[nodes] = top[better], f, key[end[place]] % width
        split = chosen >= 0
        if not split.any():
            break
        child = np.full(m, -1)
        child[split] = made + 2 * np.arange(int(split.sum()))
        level["feature"], level["at"], level["gain"] = chosen, at, best
        level["left"], level["right"] = child, np.where(split, child + 1, -1)
        keep = split[local]
        row, weight, total, local = row[keep], weight[keep], total[keep], local[keep]
        code, f = codes[row, chosen[local]], chosen[local]
        left = np.where(one_value[f], code == at[local], code <= at[local])
        node = child[local] + ~left
        tree_of = np.repeat(tree_of[split], 2)
        made, depth = made + len(tree_of), depth + 1
    return {k: np.concatenate([x[k] for x in levels]).astype(t) for k, t in NODE_FIELDS.items()}


class Walk:
    """Nodes laid out for many rows that go down many trees; lesser depths and larger least splits end them earlier.

    A row goes left where its code lies in the ``span`` from ``low``. A closed node leads to itself.
    """

    def __init__(self, nodes: dict[str, np.ndarray], one_value: np.ndarray, max_depth: int = 1 << 30, min_split: int = 0):
        self.open = (nodes["feature"] >= 0) & (nodes["depth"] < max_depth) & (nodes["rows"] >= min_split)
        feature = np.where(self.open, nodes["feature"], 0)
        single = np.append(one_value, False)[feature]
        self.feature = feature.astype(np.intp)
        self.low = np.where(single, nodes["at"], 0).astype(np.int32)
        self.span = np.where(single, 0, nodes["at"]).astype(np.uint32)
        here = np.arange(len(feature))
        self.child = np.stack([np.where(self.open, nodes[side], here) for side in ("left", "right")], 1).ravel().astype(np.intp)

    def ends(self, roots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(rows, trees): the node where each row ends. Rows that have ended are set aside once they are the most."""
        n = len(codes)
        flat = np.ascontiguousarray(codes.T, np.int32).ravel()
        ends, row, place = np.repeat(roots, n), np.tile(np.arange(n), len(roots)), np.arange(n * len(roots))
        at = ends
        while True:
            going = self.open.take(at)
            left = np.count_nonzero(going)
            if 2 * left < len(at) or not left:
                ends[place] = at
                if not left:
                    return ends.reshape(len(roots), n).T
                keep = np.flatnonzero(going)
                at, row, place = at.take(keep), row.take(keep), place.take(keep)
            code = flat.take(self.feature.take(at) * n + row)
            right = (code - self.low.take(at)).view(np.uint32) > self.span.take(at)
            at = self.child.take(2 * at + right)


def leaves(nodes: dict[str, np.ndarray], roots: np.ndarray, codes: np.ndarray, one_value: np.ndarray, max_depth: int = 1 << 30, min_split: int = 0) -> np.ndarray:
    """(rows, trees): the node where each row ends; lesser depths and larger least splits end it earlier."""
    return Walk(nodes, one_value, max_depth, min_split).ends(roots, codes)


# --- boosting -------------------------------------------------------------------------------------

def grow_boosted(codes: np.ndarray, widths: np.ndarray, one_value: np.ndarray, y: np.ndarray, rounds: int, rate: float,
                 max_leaves: int, max_depth: int, min_leaf: int, l2: float) -> tuple[float, dict[str, np.ndarray]]:
    """The mean, and the nodes of all rounds' trees; the root of each comes first of its nodes."""
    offset = np.append(0, np.cumsum(widths))
    flat, bins = codes + offset[:-1], int(offset[-1])
    feature = np.repeat(np.arange(len(widths)), widths)
    single = one_value[feature]
    start = offset[:-1][feature]
    base = float(y.mean()) if len(y) else 0.0
    predicted = np.full(len(y), base)
    found: list[list] = []

    def sums(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = flat[rows].ravel()
        return np.bincount(at, minlength=bins), np.bincount(at, np.repeat(gradient[rows], len(widths)), bins)

    def best(count: np.ndarray, total: np.ndarray, n: int, s: float) -> tuple[float, int]:
        """The largest gain and its bin."""
        c, t = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(total))
        nl, sl = np.where(single, count, c[1:] - c[start]), np.where(single, total, t[1:] - t[start])
        nr, sr = n - nl, s - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sl * sl / (nl + l2) + sr * sr / (nr + l2) - s * s / (n + l2)
        gain = np.where((nl >= min_leaf) & (nr >= min_leaf), gain, -np.inf)
        place = int(gain.argmax())
        return float(gain[place]), place

    for tree in range(rounds):
        gradient = y - predicted
        queue: list[tuple] = []

        def leaf(rows: np.ndarray, depth: int, hist: tuple[np.ndarray, np.ndarray]) -> int:
            s = float(gradient[rows].sum())
            found.append([tree, -1, 0, -1, -1, rate * s / (len(rows) + l2) if len(rows) + l2 else 0.0, len(rows), depth, 0.0])
            number = len(found) - 1
            if depth < max_depth and len(rows) >= 2 * min_leaf:
                gain, place = best(*hist, len(rows), s)
                if gain > 1e-12 * max(1.0, s * s):
                    heapq.heappush(queue, (-gain, number, place, rows, hist))
            return number

        everything = np.arange(len(y))
        ends = {leaf(everything, 0, sums(everything)): everything}
        while queue and len(ends) < max_leaves:
            gain, number, place, rows, hist = heapq.heappop(queue)
            f, cut = int(feature[place]), int(place - start[place])
            go = codes[rows, f] == cut if one_value[f] else codes[rows, f] <= cut
            left, right = rows[go], rows[~go]
            small = sums(left if len(left) <= len(right) else right)
            other = (hist[0] - small[0], hist[1] - small[1])
            depth = found[number][7] + 1
            found[number][1:3], found[number][8] = [f, cut], -gain
            del ends[number]
            for side, part in ((3, left), (4, right)):
                own = small if (part is left) == (len(left) <= len(right)) else other
                found[number][side] = leaf(part, depth, own)
                ends[found[number][side]] = part
        for number, rows in ends.items():
            predicted[rows] += found[number][5]
    columns = list(zip(*found)) if found else [[]] * len(NODE_FIELDS)
    return base, {k: np.array(c, t) for (k, t), c in zip(NODE_FIELDS.items(), columns)}


# --- estimators and their model -------------------------------------------------------------------

class TreesModel(Model, MLReadable, MLWritable):
    """Trees over the ``features`` vector. The prediction is ``base`` plus the sum of the trees' values, or their mean."""

    def __init__(self, binning: Binning | None = None, nodes: dict[str, np.ndarray] | None = None, base: float = 0.0, mean: bool = True):
        super().__init__()
        self.binning, self.nodes, self.base, self.mean = binning, nodes, base, mean

    @property
    def featureImportances(self) -> SparseVector:
        """Share of each feature in the gains of all splits, at the feature's first slot."""
        used = self.nodes["feature"] >= 0
        gains = np.bincount(self.nodes["feature"][used], self.nodes["gain"][used], len(self.binning.low))
        share = gains / gains.sum() if gains.sum() else np.full(len(gains), 1 / max(1, len(gains)))
        return Vectors.sparse(self.binning.size, self.binning.low, share.tolist())

    @property
    def roots(self) -> np.ndarray:
        return np.flatnonzero(self.nodes["depth"] == 0)

    @cached_property
    def walk(self) -> Walk:
        return Walk(self.nodes, self.binning.one_value)

    @cached_property
    def reads(self) -> np.ndarray:
        """(trees, features): whether a tree splits by a feature."""
        out = np.zeros((len(self.roots), len(self.binning.low)), bool)
        tree = np.searchsorted(self.nodes["tree"][self.roots], self.nodes["tree"])
        used = self.nodes["feature"] >= 0
        out[tree[used], self.nodes["feature"][used]] = True
        return out

    def values(self, codes: np.ndarray) -> np.ndarray:
        return self.mixed_values(codes, codes, [])[:, 0]

    def mixed_values(self, codes: np.ndarray, lent: np.ndarray, groups: Sequence[Sequence[int]]) -> np.ndarray:
        """(rows, 1 + groups): the prediction, and for each group of features that with these taken from ``lent``.

        A mixed row goes down those trees alone that split by the group, if its codes change at all; it ends where it did in the others.
        """
        total = np.full((len(codes), 1 + len(groups)), self.base)
        roots = self.roots
        for i in range(0, len(roots), 100):
            some = roots[i:i + 100]
            own = self.nodes["value"].take(self.walk.ends(some, codes))
            sums = own.sum(axis=1)
            total[:, 0] += sums
            for k, group in enumerate(groups, 1):
                trees = np.flatnonzero(self.reads[i:i + 100, group].any(axis=1))
                rows = np.flatnonzero((codes[:, group] != lent[:, group]).any(axis=1))
                changed = sums.copy()
                if len(trees) and len(rows):
                    mixed = codes[rows]
                    mixed[:, group] = lent[np.ix_(rows, group)]
                    values = own[rows]
                    values[:, trees] = self.nodes["value"].take(self.walk.ends(some[trees], mixed))
                    changed[rows] = values.sum(axis=1)
                total[:, k] += changed
        return total / len(roots) if self.mean and len(roots) else total

    def _shared(self, dataset: DataFrame):
        return dataset.sparkSession.sparkContext.broadcast((self.binning, self.nodes, self.base, self.mean))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = self._shared(dataset)

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = TreesModel(*shared.value)
            for vectors in batches:
                parts = [model.values(model.binning.codes(dense_rows(vectors.slice(i, SCORED), model.binning.size))) for i in range(0, len(vectors), SCORED)]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

        # annotations as text would hide from Spark that the function takes an iterator
        score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return dataset.withColumn("prediction", F.arrow_udf(score, "double")(F.unwrap_udt("features")))

    def transform_mixed(self, dataset: DataFrame, lent: str, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
        """Adds ``predictions``: that of ``features``, and for each column that with the column's slots taken from the vector ``lent``.

        ``names``: source column of each slot. Both vectors of a row are read once, whatever the number of columns.
        """
        shared = self._shared(dataset)
        groups = [[f for f, slot in enumerate(self.binning.low) if names[slot] == c] for c in columns]

        def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = TreesModel(*shared.value)
            for both in batches:
                parts = [np.zeros(0)]
                for i in range(0, len(both[0]), SCORED):
                    own, other = (model.binning.codes(dense_rows(v.slice(i, SCORED), model.binning.size)) for v in both)
                    parts.append(model.mixed_values(own, other, groups).ravel())
                ends = np.arange(len(both[0]) + 1, dtype=np.int32) * (1 + len(groups))
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))

        score.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        return dataset.withColumn("predictions", F.arrow_udf(score, "array<double>")(F.unwrap_udt("features"), F.unwrap_udt(lent)))

    def write(self) -> MLWriter:
        return TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return TreesReader(cls)


class TreesWriter(MLWriter):
    """Nodes and bins as Parquet beside the stage's metadata."""

    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(model, path, spark.sparkContext, extraMetadata={"base": model.base, "mean": model.mean, "size": model.binning.size})
        spark.createDataFrame(pa.table({"place": np.arange(len(model.nodes["tree"])), **model.nodes})).write.parquet(f"{path}/nodes")
        bins = pa.table({"place": list(range(len(model.binning.low))), "low": model.binning.low, "high": model.binning.high,
                         "edges": pa.array([None if e is None else e.tolist() for e in model.binning.edges], pa.list_(pa.float64()))})
        spark.createDataFrame(bins).write.parquet(f"{path}/bins")


class TreesReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreesModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession.sparkContext)
        nodes = self.sparkSession.read.parquet(f"{path}/nodes").orderBy("place").toArrow()
        bins = self.sparkSession.read.parquet(f"{path}/bins").orderBy("place").collect()  # a row for each feature
        binning = Binning([b.low for b in bins], [b.high for b in bins], [None if b.edges is None else np.array(b.edges) for b in bins], about["size"])
        model = self.cls(binning, {k: nodes.column(k).to_numpy().astype(t) for k, t in NODE_FIELDS.items()}, about["base"], about["mean"])
        model._resetUid(about["uid"])
        return model


def joined_nodes(parts: Sequence[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Nodes of several blocks as one table."""
    shifts = np.cumsum([0, *(len(p["tree"]) for p in parts)])
    out = {k: np.concatenate([p[k] for p in parts]) for k in NODE_FIELDS}
    for side in ("left", "right"):
        out[side] = np.concatenate([np.where(p[side] < 0, -1, p[side] + shift) for p, shift in zip(parts, shifts)]).astype(np.int32)
    return out


def blocks(spark: SparkSession, jobs: Sequence[tuple], run, schema: str) -> DataFrame:
    """One task for each job: ``run(job)`` yields record batches."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from run(jobs[i])

    return spark.range(len(jobs), numPartitions=max(1, len(jobs))).mapInArrow(work, schema)


@dataclass
class Forest:
    """Defaults are the library's; a depth of None has no limit."""

    numTrees: int = 200
    maxDepth: int | None = 10
    minInstancesPerNode: int = 2
    minSamplesSplit: int = 2
    seed: int = SEED
    fitRows: int = FIT_ROWS

    def fit(self, rows: DataFrame) -> TreesModel:
        sample = take(rows.select("features", "label"), self.fitRows)
        data, depth = (sample.codes, sample.binning.widths, sample.binning.one_value, sample.label), 1 << 30 if self.maxDepth is None else self.maxDepth
        settings = (depth, self.minInstancesPerNode, self.minSamplesSplit, self.seed)
        jobs = [tuple(range(i, min(self.numTrees, i + BLOCK))) for i in range(0, self.numTrees, BLOCK)]

        def run(trees: tuple) -> Iterator[pa.RecordBatch]:
            nodes = grow_forest(*data, trees, *settings)
            yield pa.record_batch([pa.array([trees[0]] * len(nodes["tree"])), pa.array(np.arange(len(nodes["tree"]))), *map(pa.array, nodes.values())], ["block", "place", *nodes])

        kinds = {np.int32: "int", np.float64: "double"}
        schema = "block long, place long, " + ", ".join(f"{k} {kinds[t]}" for k, t in NODE_FIELDS.items())
        # bounded by trees and rows of the fit; ordered here, as Spark would grow all trees once more to sample their order
        found = blocks(rows.sparkSession, jobs, run, schema).toArrow().sort_by([("block", "ascending"), ("place", "ascending")])
        block = found.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        parts = [{k: found.column(k).to_numpy()[a:b] for k in NODE_FIELDS} for a, b in zip(edges, edges[1:])]
        return TreesModel(sample.binning, joined_nodes(parts))


@dataclass
class Boosting:
    """Least squares. ``maxLeafNodes`` of None has no limit, nor has a depth of None."""

    maxIter: int = 100
    stepSize: float = 0.03
    maxDepth: int | None = 6
    maxLeafNodes: int | None = 31
    minInstancesPerNode: int = 20
    l2: float = 0.0
    seed: int = SEED
    fitRows: int = FIT_ROWS

    def grow(self, sample: Sample) -> TreesModel:
        none = 1 << 30
        base, nodes = grow_boosted(sample.codes, sample.binning.widths, sample.binning.one_value, sample.label, self.maxIter, self.stepSize,
                                   self.maxLeafNodes or none, none if self.maxDepth is None else self.maxDepth, self.minInstancesPerNode, self.l2)
        return TreesModel(sample.binning, nodes, base, mean=False)

    def fit(self, rows: DataFrame) -> TreesModel:
        return self.grow(take(rows.select("features", "label"), self.fitRows))


def nested_errors(spark: SparkSession, settings: Sequence[dict], parts: Sequence[tuple[Sample, Sample]], seed: int = SEED) -> list[float]:
    """Mean absolute error of each setting of a forest, over (train, test) samples: one forest for each least leaf and sample."""
    forests = [Forest(**s) for s in settings]
    limit = lambda depth: 1 << 30 if depth is None else depth
    jobs = []
    for leaf in sorted({f.minInstancesPerNode for f in forests}):
        mine = [f for f in forests if f.minInstancesPerNode == leaf]
        for part in range(len(parts)):
            for i in range(0, max(f.numTrees for f in mine), BLOCK):
                jobs.append((leaf, part, i))

    def run(job: tuple) -> Iterator[pa.RecordBatch]:
        leaf, part, low = job
        train, test = parts[part]
        wanted = [(i, f) for i, f in enumerate(forests) if f.minInstancesPerNode == leaf and f.numTrees > low]
        trees = range(low, min(low + BLOCK, max(f.numTrees for _, f in wanted)))
        nodes = grow_forest(train.codes, train.binning.widths, train.binning.one_value, train.label, trees, max(limit(f.maxDepth) for _, f in wanted), leaf,
                            min(f.minSamplesSplit for _, f in wanted), seed)
        for i, f in wanted:
            roots = np.arange(min(len(trees), f.numTrees - low))
            ends = leaves(nodes, roots, test.codes, test.binning.one_value, limit(f.maxDepth), f.minSamplesSplit)
            n = len(test.label)
            yield pa.record_batch([pa.array(np.full(n, i)), pa.array(np.full(n, part)), pa.array(np.arange(n)), pa.array(nodes["value"][ends].sum(axis=1) / f.numTrees),
                                   pa.array(test.label)], ["setting", "part", "row", "predicted", "label"])

    scored = blocks(spark, jobs, run, "setting long, part long, row long, predicted double, label double") \
        .groupBy("setting", "part", "row").agg(F.sum("predicted").alias("predicted"), F.first("label").alias("label")) \
        .groupBy("setting", "part").agg(F.avg(F.abs(F.col("label") - F.col("predicted"))).alias("mae")) \
        .groupBy("setting").agg(F.avg("mae").alias("mae")).collect()
    errors = {r.setting: r.mae for r in scored}
    return [errors[i] for i in range(len(settings))]


def boosting_errors(spark: SparkSession, settings: Sequence[dict], parts: Sequence[tuple[Sample, Sample]]) -> list[float]:
    """Mean absolute error of each setting of boosting, over (train, test) samples: one task for each setting and sample."""
    jobs = [(i, k) for i in range(len(settings)) for k in range(len(parts))]

    def run(job: tuple) -> Iterator[pa.RecordBatch]:
        train, test = parts[job[1]]
        error = np.abs(test.label - Boosting(**settings[job[0]]).grow(train).values(test.codes)).mean()
        yield pa.record_batch([pa.array([job[0]]), pa.array([float(error)])], ["setting", "mae"])

    found = {r.setting: r.mae for r in blocks(spark, jobs, run, "setting long, mae double").groupBy("setting").agg(F.avg("mae").alias("mae")).collect()}
    return [found[i] for i in range(len(settings))]
