"""Exact Jaccard join of word-shingle sets, by T-occurrence search with divided lists.

Two sets of at least ``t`` Jaccard similarity share T tokens, so one of them lies in the inverted lists of the other's
tokens at least T times. The lists are divided: the short ones, those of a set's rarest tokens (all but T - 1), are
merged, and each set met there is a candidate if its place in them still allows T common tokens. The long lists are never
merged: a candidate's other tokens are probed by binary search in its sorted set, and it is kept when it reaches T.

In Spark: sets with equal tokens are one class from the start. A first pass counts tokens in ``BUCKETS`` counters by hash,
and tokens are ordered by their counter, the rarest first. The order only has to be
the same for all sets, so the counters need not be exact. Before the merge, sets that share a minimum hash are compared with
one of them, and what links is joined to components. The short lists are then shuffled by token; lists that one
class or one component fills are dropped, each of the others is compared with its most typical set and joined to components
once more, long lists are dealt out in cells, and no pair within a component is
looked at again. Candidates are judged in groups around one set: first by bitmaps, which bound the common tokens from above,
then by the sets themselves.

Tokens and classes are 64-bit hashes; two different classes get one key with a probability below n^2 / 2^64.

Defined results: a null or empty text, or one without words, has the empty set, links with nothing and is its own component.
Repeated ids are documents of their own; a component is named by its smallest id, nulls left out. Very long texts are read whole. An empty table
gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.llm.cells import cells_of
from voltrail.llm.common import arrow_map, fresh, publish, shuffles_go, store, text_of
from voltrail.llm.components import stars_of
from voltrail.llm.shingles import forget_words, shingle_set

#: Jaccard similarity in hundredths.
PERCENT = 80
#: Counters of tokens by hash: one byte each in a task and, at most, in the file all tasks share, sent in so many blocks.
BUCKETS, BLOCKS = 1 << 24, 256
#: A token is common when its counter has this, and so many times the mean.
COMMON, COMMON_TIMES = 1000, 16
#: Minimum hashes by which sets are compared first.
STARS = 3
#: Largest part of a list, and most sets that are verified around one set in a task.
PART = 256
#: Most bits of the filter that picks the documents whose sets are needed, of which a value gets ``SPARSE`` while they last; an exact join follows it.
FILTER_BITS, SPARSE = 1 << 24, 256

_TURNS = np.random.default_rng(20240503).integers(0, 1 << 64, STARS, np.uint64) | np.uint64(1)


def key_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def bitmap_of(tokens: np.ndarray) -> bytes:
    """A bit for each token, in a power of two of at least eight bits a token; folds to any smaller power by OR."""
    bits = np.zeros(1 << max(6, int(8 * len(tokens) - 1).bit_length()), np.uint8)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_reach(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens with these bitmaps may reach the similarity: a bit that one lacks is a token it lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return (100 + percent) * most >= percent * (n + m)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))


def packed(counters: np.ndarray) -> bytes:
    """Most counters of a task are zero: a bit for each, and the others' bytes."""
    on = counters > 0
    return zlib.compress(np.packbits(on).tobytes() + counters[on].tobytes(), 1)


def unpacked(data: bytes, n: int) -> np.ndarray:
    data, counters = np.frombuffer(zlib.decompress(data), np.uint8), np.zeros(n, np.uint8)
    counters[np.unpackbits(data[:n // 8]).view(bool)] = data[n // 8:]
    return counters


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """``docs``: (id, text). Rows (id, key, n, m: minimum hashes, b: bitmap), and rows (block, data) of a task's counters with n = -1.

    A task gives the bitmap of a class once.
    """
    names = ["id", "key", "n", "m", "b", "block", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held, size = np.zeros(BUCKETS, np.uint8), [], 0
        kind, done = None, set()

        def count() -> None:
            at, seen = np.unique(np.concatenate(held), return_counts=True)
            counters[at] = np.minimum(255, counters[at] + seen)

        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys, sizes, least, maps = [], [], [], []
                for text in part.column(1):
                    tokens = shingle_set(text.as_py().encode())
                    keys.append(key_of(tokens))
                    sizes.append(len(tokens))
                    maps.append(bitmap_of(tokens) if keys[-1] not in done and len(tokens) else None)
                    done.add(keys[-1])
                    least.append([int((tokens * turn).min()) - (1 << 63) for turn in _TURNS] if len(tokens) else [])
                    held.append(_bucket(tokens))
                    size += len(tokens)
                    if size > 1 << 18:
                        count()
                        held, size = [], 0
                n = part.num_rows
                yield pa.record_batch([part.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()),
                                       pa.array(least, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if held:
            count()
        forget_words()
        blocks = counters.reshape(BLOCKS, -1)
        used = np.flatnonzero(blocks.any(axis=1)).tolist()
        if kind is not None and used:
            n = len(used)
            yield pa.record_batch([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.list_(pa.int64())),
                                   pa.nulls(n, pa.binary()), pa.array(used, pa.int32()),
                                   pa.array([packed(blocks[i]) for i in used], pa.binary())], names)

    kind = docs.schema["id"].dataType.simpleString()
    return arrow_map(docs, run, f"id {kind}, key long, n int, m array<long>, b binary, block int, data binary")


def _level(count: float) -> int:
    return min(255, int(4 * np.log2(count + 1)))


def publish_levels(found: DataFrame) -> tuple[str, int]:
    """The file of levels, one byte for each counter that grows with its logarithm, and the least level of a common token.

    Every machine keeps a copy of the file, so neighbouring counters share a byte while few are in use.
    """
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None

        def row() -> pa.RecordBatch:
            levels = np.minimum(255, 4 * np.log2(own + 1)).astype(np.uint8)
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary()), pa.array([int(own.sum())], pa.int64())],
                                   ["block", "levels", "total"])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != at:
                    if at is not None:
                        yield row()
                    at, own = block, np.zeros(BUCKETS // BLOCKS, np.int64)
                own += unpacked(data.as_py(), len(own))
        if at is not None:
            yield row()

    blocks = found.where("n < 0").select("block", "data").repartition("block").sortWithinPartitions("block")
    levels, tokens = np.zeros((BLOCKS, BUCKETS // BLOCKS), np.uint8), 0
    with shuffles_go(found.sparkSession):
        for row in arrow_map(blocks, total, "block int, levels binary, total long").collect():  # BUCKETS bytes at most
            levels[row.block] = np.frombuffer(zlib.decompress(row.levels), np.uint8)
            tokens += row.total
    levels = levels.reshape(-1)
    used = np.count_nonzero(levels)
    while len(levels) // 2 >= max(2 * used, BLOCKS):
        levels = levels.reshape(-1, 2).max(axis=1)
    return publish(found.sparkSession, levels.tobytes(), "levels.bin"), _level(COMMON + COMMON_TIMES * tokens / len(levels))


def postings(docs: DataFrame, levels: str, common: int, percent: int) -> DataFrame:
    """(token, key, place, n, common): the short lists' entries of each set; a task gives those of a class once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = np.memmap(SparkFiles.get(levels), np.uint8, "r")
        shared = np.int64((BUCKETS // len(level_of)).bit_length() - 1)
        done: set[int] = set()
        columns: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, keys, places, sizes, is_common = (np.concatenate(c) for c in zip(*columns))
            return pa.record_batch([_signed(tokens), pa.array(keys), pa.array(places), pa.array(sizes), pa.array(is_common)],
                                   ["token", "key", "place", "n", "common"])

        for batch in batches:
            for text in batch.column(1):
                tokens = shingle_set(text.as_py().encode())
                key = key_of(tokens)
                if not len(tokens) or key in done:
                    continue
                done.add(key)
                n = len(tokens)
                short = n - -(-n * percent // 100) + 1
                level = level_of[_bucket(tokens) >> shared]
                order = np.argsort(level, kind="stable")[:short]  # the set is sorted, so ties are in token order
                columns.append((tokens[order], np.full(short, key, np.int64), np.arange(short, dtype=np.int32),
                                np.full(short, n, np.int32), level[order] >= common))
                size += short
                if size > 50000:
                    yield flush()
                    columns, size = [], 0
        if columns:
            yield flush()
        forget_words()

    return arrow_map(docs, run, "token long, key long, place int, n int, common boolean")


def _candidates(percent: int):
    """Pairs of keys within the cells of sorted rows (cell, key, comp, place, n, side) that may reach the similarity."""
    def pairs_of(cell: np.ndarray, data: dict) -> tuple[np.ndarray, np.ndarray]:
        key, comp, place, n, side = (data[c] for c in ("key", "comp", "place", "n", "side"))
        found = []
        edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        longest = int(np.diff(edges).max())
        for shift in range(1, longest):
            a = np.flatnonzero(cell[:-shift] == cell[shift:])
            if not len(a):
                break
            b = a + shift
            ok = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[ok], b[ok]
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            # T = t / (1 + t) of both sizes; after these places both sets have only so many tokens left
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            ok = (100 * small >= percent * large) & (np.minimum(n[a] - place[a], n[b] - place[b]) >= need)
            a, b = a[ok], b[ok]
            if len(a):
                found.append(np.unique(np.stack((np.minimum(key[a], key[b]), np.maximum(key[a], key[b])), 1), axis=0))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0].copy(), both[:, 1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def work(table: pa.Table) -> pa.RecordBatch | None:
            data = {c: table.column(c).to_numpy().astype(np.int64) for c in ("cell", "key", "comp", "place", "n", "side")}
            a, b = pairs_of(data["cell"], data)
            new = [p for p in zip(a.tolist(), b.tolist()) if p not in seen]
            if len(seen) > 500000:
                seen.clear()
            seen.update(new)
            return pa.record_batch([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], ["a", "b"])

        yield from map(work, whole_cells(batches, "cell", 20000))

    return run


def whole_cells(batches: Iterator[pa.RecordBatch], name: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end where the sorted column ``name`` changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cell = table.column(name).to_numpy()
        change = np.flatnonzero(cell[1:] != cell[:-1])
        if len(change):
            yield table.slice(0, change[-1] + 1)
            held = table.slice(change[-1] + 1).to_batches()
        else:
            held = table.to_batches()
    table = pa.Table.from_batches(held) if held else None
    if table is not None and table.num_rows:
        yield table.combine_chunks()


def _wanted(values: DataFrame) -> str:
    """The published filter over a column ``bit``: of ``FILTER_BITS`` bits, whatever the number of values, folded while it is sparse."""
    words = np.zeros(FILTER_BITS // 64, np.int64)
    with shuffles_go(values.sparkSession):
        found = values.groupBy(F.shiftright("bit", 6).alias("word")) \
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()  # one job; a row for each word at most
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    ones = int(np.bitwise_count(words.view(np.uint64)).sum())
    while len(words) > 1 and 64 * (len(words) // 2) >= SPARSE * ones:
        words = words[:len(words) // 2] | words[len(words) // 2:]
    return publish(values.sparkSession, words.tobytes(), "wanted.bin")


def _passing(name: str, bit: pa.Array) -> np.ndarray:
    """Places in a batch whose bit is set."""
    bits = np.memmap(SparkFiles.get(name), np.int64, "r")
    place = bit.to_numpy() & (64 * len(bits) - 1)
    return np.flatnonzero((bits[place >> 6] >> (place & 63)) & 1)


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("bit")


def needed_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, tokens) of the classes in ``keys``, made again from the text of one document of each.

    The documents are picked by a filter over their ids; what it lets through in error is dropped by the joins on the
    key that follow.
    """
    name = _wanted(classes.join(keys.distinct(), "key", "left_semi").select(_bit("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            keys, sets = [], []
            for at in _passing(name, batch.column(0)):
                tokens = shingle_set(batch.column(1)[int(at)].as_py().encode())
                key = key_of(tokens)
                if len(tokens) and key not in done:
                    done.add(key)
                    keys.append(key)
                    sets.append(tokens)
                if sum(map(len, sets[-64:])) > 1 << 20 or len(sets) >= 1024:
                    yield _sets(keys, sets)
                    keys, sets = [], []
            if sets:
                yield _sets(keys, sets)
        forget_words()

    return arrow_map(docs.select(_bit("id"), "text"), run, "key long, tokens array<long>")


def needed_bitmaps(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, b) of ``keys``, once each. A filter over the keys goes before the join, so that few bitmaps are shuffled."""
    name = _wanted(keys.select(_bit("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.take(pa.array(_passing(name, batch.column(0))))
            yield pa.record_batch(some.columns[1:], ["key", "n", "b"])

    maps = rows.where("b is not null").select(_bit("key"), "key", "n", "b")
    return arrow_map(maps, run, "key long, n int, b binary").join(keys.distinct(), "key", "left_semi").dropDuplicates(["key"])


def _sets(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.record_batch([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, _signed(np.concatenate(sets)))], ["key", "tokens"])


def _around(pairs: DataFrame) -> DataFrame:
    """(cell, centre, key) of stored pairs: each around the end that has more pairs, at most about ``PART`` in a cell."""
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    da = degrees.select(F.col("key").alias("a"), F.col("degree").alias("da"))
    db = degrees.select(F.col("key").alias("b"), F.col("degree").alias("db"))
    first = F.col("da") >= F.col("db")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.greatest("da", "db") / PART))
    return store(pairs.join(da, "a").join(db, "b")
                 .withColumns({"centre": F.when(first, F.col("a")).otherwise(F.col("b")), "key": F.when(first, F.col("b")).otherwise(F.col("a"))})
                 .select(F.xxhash64("centre", part).alias("cell"), "centre", "key"), "around")


def _judged(around: DataFrame, values: DataFrame, columns: str, judge) -> DataFrame:
    """The pairs (a, b) that ``judge(centre's value, member's value)`` accepts. ``values``: (key, and the ``columns`` of a value).

    A centre's value travels once for each of its cells and comes first in it.
    """
    members = around.select("cell", "centre", "key")
    centres = around.select("cell", "centre", F.col("centre").alias("key")).distinct()
    loaded = members.unionByName(centres).join(values, "key") \
        .withColumn("member", F.col("key") != F.col("centre")) \
        .repartition("cell").sortWithinPartitions("cell", "centre", "member").select("centre", "key", "member", *columns.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            centre, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            member = batch.column(2).to_numpy(zero_copy_only=False)
            a, b = [], []
            for i in range(batch.num_rows):
                value = tuple(c[i] for c in batch.columns[3:])
                if not member[i]:
                    at, own = centre[i], value
                elif at == centre[i] and judge(own, value):
                    a.append(int(at))
                    b.append(int(key[i]))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return arrow_map(loaded, run, "a long, b long")


def _keys(around: DataFrame) -> DataFrame:
    """The keys of cells, repeated."""
    return around.select(F.explode(F.array("key", "centre")).alias("key"))


def possible(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps, an eighth of the sets' size, leave the similarity possible."""
    around = _around(store(pairs, "pairs"))
    return _judged(around, needed_bitmaps(rows, _keys(around)), "n b", lambda x, y: may_reach(x[1].as_py(), x[0].as_py(), y[1].as_py(), y[0].as_py(), percent))


def verified(docs: DataFrame, rows: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = store(possible(rows, pairs, percent).distinct(), "possible")
    around = _around(left)
    sets = needed_sets(docs, classes, _keys(around))
    tokens = lambda x: x[0].values.to_numpy().view(np.uint64)
    return _judged(around, sets, "tokens", lambda x, y: reaches(tokens(x), tokens(y), percent))


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity: the smaller one's tokens are probed in the larger by binary search."""
    if len(a) > len(b):
        a, b = b, a
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if need > len(a) or not len(a):
        return False
    common, at = 0, 0
    while at < len(a):
        part = a[at:at + 4096]
        place = np.searchsorted(b, part)
        place[place == len(b)] = 0
        common += int((b[place] == part).sum())
        at += len(part)
        if common + len(a) - at < need:
            return False
    return common >= need


def _stars(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of each class with the one of the smallest id that shares one of its minimum hashes."""
    spots = classes.select("key", "n", "id", F.posexplode("m").alias("turn", "least"))
    centres = spots.groupBy("turn", "least").agg(F.min(F.struct("id", "key", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    near = (100 * F.least("n", F.col("c.n")) >= percent * F.greatest("n", F.col("c.n")))
    return spots.join(centres, ["turn", "least"]).where((F.col("key") != F.col("c.key")) & near) \
        .select(F.col("c.key").alias("a"), F.col("key").alias("b")).distinct()


def _entries(shared: DataFrame, known: DataFrame) -> DataFrame:
    """Stored entries of the short lists with the component of their class: (token, key, comp, place, n)."""
    return store(shared.join(known.withColumnRenamed("node", "key"), "key", "left")
                 .select("token", "key", F.coalesce("component", "key").alias("comp"), "place", "n"), "entries")


def _lists(entries: DataFrame) -> DataFrame:
    """The lists that more than one component shares: (token, size, top: its most frequent component, in_top, centre).

    The centre is the entry with the fewest rarer tokens before it: the most typical set of those that differ in a few tokens.
    """
    return entries.groupBy("token", "comp").agg(F.count("*").alias("c"), F.min(F.struct("place", "n", "key")).alias("centre")) \
        .groupBy("token").agg(F.sum("c").alias("size"), F.max_by("comp", "c").alias("top"), F.max("c").alias("in_top"),
                              F.min(F.struct("centre", "comp")).alias("first"), F.count("*").alias("comps")).where("comps > 1") \
        .select("token", "size", "top", "in_top", F.col("first.centre").alias("centre"), F.col("first.comp").alias("centre_comp"))


def _typical(entries: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of each list's centre with the others: as many as entries at most."""
    n, m = F.col("n"), F.col("centre.n")
    left = F.least(n - F.col("place"), m - F.col("centre.place"))
    return entries.join(lists, "token") \
        .where((F.col("comp") != F.col("centre_comp")) & (100 * F.least(n, m) >= percent * F.greatest(n, m))
               & ((100 + percent) * left >= percent * (n + m))) \
        .select(F.least("key", "centre.key").alias("a"), F.greatest("key", "centre.key").alias("b")).distinct()


def _crossing(entries: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components."""
    split = F.col("size") > PART
    lists = _lists(entries).withColumn("parts", F.when(split, F.ceil((F.col("size") - F.col("in_top")) / PART)).otherwise(1).cast("int")) \
        .withColumn("core_parts", F.when(split, F.ceil(F.col("in_top") / PART)).otherwise(0).cast("int")) \
        .select("token", "top", "parts", "core_parts")
    cells = cells_of("key", (F.col("core_parts") > 0) & (F.col("comp") == F.col("top")))
    spread = entries.join(lists, "token").withColumn("c", F.explode(cells)) \
        .select(F.xxhash64("token", "c.x", "c.y").alias("cell"), "key", "comp", "place", "n", F.col("c.side").alias("side")) \
        .repartition("cell").sortWithinPartitions("cell")
    return arrow_map(spread, _candidates(percent), "a long, b long").distinct()


def _as_edges(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("node").alias("a"), F.col("component").alias("b"))


def link_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs``: (id, text). Returns rows (id, key, n), classes (key, id: the least) and the stars (node, component) of keys that link."""
    found = store(described(docs), "described")
    levels, common = publish_levels(found)
    rows = found.where("n >= 0").select("id", "key", "n", "m", "b")
    classes = store(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("m").alias("m")), "classes")
    known = stars_of(verified(docs, rows, classes, _stars(classes, percent), percent))
    entries = postings(docs, levels, common, percent)
    # an uncommon token's list is looked at whole; entries of common ones are dealt by key and judged by the counts that follow
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("key"), F.lit(64)) + 1).otherwise(0)
    of_token = Window.partitionBy("token", "salt")
    shared = entries.withColumn("salt", salt) \
        .withColumn("k0", F.min("key").over(of_token)).withColumn("k1", F.max("key").over(of_token)) \
        .where("common or k0 != k1").groupBy("token", "salt", "key").agg(F.first("place").alias("place"), F.first("n").alias("n")).drop("salt")  # as dealt
    entries = _entries(store(shared, "shared"), known)
    # each list's most typical set first: what links to it needs no comparison among itself
    more = verified(docs, rows, classes, _typical(entries, _lists(entries), percent), percent)
    known = stars_of(_as_edges(known).unionByName(more))
    more = verified(docs, rows, classes, _crossing(_entries(entries.select("token", "key", "place", "n"), known), percent), percent)
    return rows.select("id", "key", "n"), classes.select("key", "id"), stars_of(_as_edges(known).unionByName(more))


def jaccard_join(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, classes, linked = link_classes(_texts(docs, id_col, text_col), percent)
    named = classes.join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = named.join(least, "component").select("key", "component_id")
    return rows.join(classes, "key", "left") \
        .select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """Rows of Parquet files with a number of their own, from the file and the place in it: it is the same in every scan, so nothing is stored but the files' names."""
    place, file = docs.metadataColumn("_metadata"), fresh(docs, "file")
    names = docs.select(place["file_path"].alias(file)).distinct()
    files = store(names.withColumn(row, F.row_number().over(Window.orderBy(file))), "files")  # a row for each file
    at = fresh(docs, "at")
    return docs.select("*", place["file_path"].alias(file), place["row_index"].alias(at)).join(files, file) \
        .withColumn(row, F.shiftleft(F.col(row).cast("long"), 33) + F.col(at)).drop(file, at)


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                     in_files: bool = False) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of the smallest id, then the first stored one. Null ids come last.

    Rows have a number and are dropped by it, so ids may repeat or be null. They are stored for that, unless the caller knows that ``docs`` is
    just a read of Parquet files (``in_files``): then a row's number is its place in them.
    """
    row = fresh(docs, "row")
    numbered = _numbered(docs, row) if in_files else store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows, _, linked = link_classes(numbered.select(F.col(row).alias("id"), text_of(text_col).alias("text")), percent)
    members = store(rows.where("n > 0").select(F.col("id").alias("row"), "key"), "members")
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"))
    first = members.join(ids, "row").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
    stays = first.join(linked.withColumnRenamed("node", "key"), "key", "left") \
        .groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("first").alias("first")).select("first.row")
    gone = store(members.join(stays, "row", "left_anti").select(F.col("row").alias(row)), "gone")
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
