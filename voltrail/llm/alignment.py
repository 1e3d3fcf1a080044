"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how often each pair of ids is linked.

The byte-level tokenizer A and the piece tokenizer B cover the same bytes. Where both have a token's end, a group ends. Every
stretch between two neighbouring ends lies in one token of A and one of B: this is a link.

Identity-map fast path: an array made once has for each id of A the id of B with the same bytes. Groups of one token each
that this array maps onto each other are counted in a vector of A's length, which tasks add up; only the links of all other
groups enter the shuffle by pair, summed in their task first. The second pass has the totals of the identity pairs and the
largest total of each id of B as arrays of the vocabularies' length, and those of the ``HOT_PAIRS`` most frequent other pairs as
a sorted file; links of rarer pairs are joined with their totals by a shuffle. Each text is looked at once: the first pass stores the
distinct links of every document.

A text is cut before a blank that follows no blank and comes before no white space. No piece of B has a blank after another
character (this is checked), and A's pattern begins a new word there, so neither tokenizer looks across. Each cut is therefore an end
of both, and a task aligns each chunk once, as long as it remembers it, and adds up chunks.

Defined results: a null or empty text, and one whose bytes the tokens of A or B do not give back (U+2581 reads as a blank), has
no tokens: zeros, and an empty digest. Special tokens inside texts are plain text. Repeated ids are documents of their own, null ids
too. Very long texts are whole, also without blanks. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from voltrail.llm.common import arrow_map, publish, store, text_of

#: Pairs whose totals travel as a file: 16 MB at most.
HOT_PAIRS = 1 << 20
#: A task remembers so many chunks, and so many letters of them; then it starts anew.
REMEMBERED, REMEMBERED_LETTERS = 400000, 1 << 23
#: Texts of this many letters in all are looked at together.
LETTERS = 1 << 21
CUT = re.compile(r"(?<! ) (?=\S)")
#: What a chunk that is cut on both sides wherever it stands begins and ends with, and the letters of the longest one that goes with others.
CUT_OFF, TOGETHER = re.compile(r"\S(?:.*[^ ])?\Z", re.DOTALL), 1000
#: How the byte-level tokenizer splits a text in words (a fixed value of its vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank that is no cut, in a text that follows a blank.
NO_CUT = re.compile(r" (?!\S)|^\s")


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the array from ids of A to ids of B with the same bytes (-1: none)."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        merges = json.loads(a_json)["model"]["merges"]
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        # the same merges for texts in ASCII, where the pattern's classes leave no room for other tables
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                                      mergeable_ranks={b: i for i, b in enumerate(self.bytes_a[:256 + len(merges)])})
        for i, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if vocabulary[left + right] != 256 + i:
                raise ValueError("the ids of tokenizer A are not in the order of its merges")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece has a blank after another character, so texts cannot be cut at blanks")
        self.lengths_a = np.array([len(b) for b in self.bytes_a])
        self.lengths_b = np.array([len(b) for b in self.bytes_b])
        same: dict[bytes, int] = {}
        for i, own in enumerate(self.bytes_b):
            if own and not self.b.is_control(i) and not self.b.is_unknown(i) and (own not in same or self.b.is_byte(same[own])):
                same[own] = i  # a byte has a piece of its own, which is what is encoded, before the fallback
        self.identity = np.array([same.get(b, -1) for b in self.bytes_a])
        self.signs = [s for sign in (b"|", b";") for i in range(len(self.bytes_a if sign == b"|" else self.bytes_b)) for s in (b"%d," % i, b"%d%s" % (i, sign))]

    def spell(self, ids: np.ndarray, spelled: list[bytes]) -> bytes:
        return b"".join(map(spelled.__getitem__, ids.tolist()))

    def together(self, chunks: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A of chunks that are cut from each other wherever they stand, as one text, and how many each chunk has."""
        text = " " + " ".join(chunks)
        ids = np.array(self.fast.encode_ordinary(text) if text.isascii() else self.a.encode(text, add_special_tokens=False).ids, np.int64)
        ends = np.append(0, np.cumsum(self.lengths_a[ids]))
        return ids, np.diff(np.searchsorted(ends, np.append(0, np.cumsum(size))))

    def tokens(self, chunks: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all chunks on end, and how many each chunk has. ``size``: bytes of each with its blank."""
        n_a = np.zeros(len(chunks), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        plain = np.fromiter((len(c) <= TOGETHER and CUT_OFF.match(c) is not None for c in chunks), bool, len(chunks))
        ascii_only = np.fromiter(map(str.isascii, chunks), bool, len(chunks))
        for wanted in (plain & ascii_only, plain & ~ascii_only):
            place = np.flatnonzero(wanted)
            if len(place):
                ids, n_a[place] = self.together([chunks[i] for i in place.tolist()], size[place])
                found.append((np.repeat(place, n_a[place]), ids))
        for i in np.flatnonzero(~plain).tolist():
            ids = self.a.encode(" " + chunks[i], add_special_tokens=False).ids
            n_a[i] = len(ids)
            found.append((np.full(len(ids), i), np.array(ids, np.int64)))
        owner, ids = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        of_b = self.b.encode(chunks, num_threads=1) if chunks else []
        n_b = np.fromiter(map(len, of_b), np.int64, len(of_b))
        return ids[np.argsort(owner, kind="stable")], np.fromiter(chain.from_iterable(of_b), np.int64, int(n_b.sum())), n_a, n_b

    def exact(self, chunks: list[str]) -> tuple:
        """Chunks whose bytes both tokenizers give back: a flag for each, and their tokens and lengths in bytes."""
        whole = [(" " + c).encode() for c in chunks]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        a, b, n_a, n_b = self.tokens(chunks, size)
        joined = b"".join(whole)
        good = np.ones(len(chunks), bool)
        if self.spell(a, self.bytes_a) != joined or self.spell(b, self.bytes_b) != joined:
            at_a, at_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
            for i, own in enumerate(whole):
                good[i] = self.spell(a[at_a[i]:at_a[i + 1]], self.bytes_a) == own and self.spell(b[at_b[i]:at_b[i + 1]], self.bytes_b) == own
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b, size = n_a[good], n_b[good], size[good]
        return good, a, b, n_a, n_b, size

    def align(self, chunks: list[str]) -> "Aligned":
        """The alignments of texts that each follow a blank."""
        good, a, b, n_a, n_b, size = self.exact(chunks)
        n = len(n_a)
        last = np.cumsum(size)  # every chunk's end is one of both tokenizers
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        links = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, links), np.searchsorted(ends_b, links)
        chunk, group = np.searchsorted(last, links), group_a[at_a]
        mapped = (in_a[group] == 1) & (in_b[group] == 1) & (self.identity[a[at_a]] == b[at_b])
        # in writing, the ids of B of a group stand behind its ids of A
        order = np.empty(len(a) + len(b), np.int64)
        first = np.flatnonzero(np.append(group_a[1:] != group_a[:-1], True))
        ends_group = np.zeros(len(a), bool)
        ends_group[first] = True
        order[np.arange(len(a)) + np.append(0, np.cumsum(in_b))[group_a]] = 2 * a + ends_group
        ends_group = np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
        order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * (len(self.bytes_a) + b) + ends_group
        written = list(map(self.signs.__getitem__, order.tolist()))
        cuts = np.append(0, np.cumsum(n_a + n_b)).tolist()
        out = Aligned(len(chunks))
        place = np.flatnonzero(good)
        out.good = good
        for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", np.bincount(np.searchsorted(last, ends), minlength=n)), ("n_links", np.bincount(chunk, minlength=n))):
            getattr(out, name)[place] = values
        for i, low, high in zip(place.tolist(), cuts, cuts[1:]):
            out.text[i] = b"".join(written[low:high])
        out.own_chunk, out.own = place[chunk[mapped]], a[at_a[mapped]]
        out.pair_chunk, out.pairs = place[chunk[~mapped]], a[at_a[~mapped]] * len(self.bytes_b) + b[at_b[~mapped]]
        return out


class Aligned:
    """Alignments by chunk: counts, the groups in writing, and identity links and other links in the order of their chunks."""

    COUNTS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, n: int):
        self.good, self.text = np.ones(n, bool), [b""] * n
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in self.COUNTS)
        self.own_chunk, self.own, self.pair_chunk, self.pairs = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, other: "Aligned") -> None:
        shift = len(self.text)
        self.text += other.text
        for name in ("good", *self.COUNTS, "own", "pairs"):
            setattr(self, name, np.concatenate((getattr(self, name), getattr(other, name))))
        for name in ("own_chunk", "pair_chunk"):
            setattr(self, name, np.concatenate((getattr(self, name), getattr(other, name) + shift)))


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def loaded(a_file: str, b_file: str) -> Tokenizers:
    """The tokenizers of two published files; read once for each worker."""
    if (a_file, b_file) not in _LOADED:
        _LOADED.clear()
        with open(SparkFiles.get(a_file), encoding="utf-8") as a, open(SparkFiles.get(b_file), "rb") as b:
            _LOADED[a_file, b_file] = Tokenizers(a.read(), b.read())
    return _LOADED[a_file, b_file]


def publish_tokenizers(spark, a_path: str, b_path: str) -> tuple[str, str]:
    """The names under which every executor finds the two files of the driver."""
    names = []
    for path in (a_path, b_path):
        with open(path, "rb") as file:
            names.append(publish(spark, file.read(), path.rsplit("/", 1)[1]))
    return names[0], names[1]


class Chunks:
    """Alignments of chunks by number. Numbers hold until ``forget``."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.aligned, self.letters = Aligned(0), 0

    def full(self) -> bool:
        return len(self.number) > REMEMBERED or self.letters > REMEMBERED_LETTERS

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of each text in order; none of a text that is empty."""
        parts = [_cut(text) for text in texts]
        new = [p for p in set(chain.from_iterable(parts)) if p not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.letters += sum(map(len, new))
            self.aligned.add(self.tokenizers.align(new))
        return [np.fromiter(map(self.number.__getitem__, p), np.int64, len(p)) for p in parts]


def _cut(text: str) -> list[str]:
    """The chunks of a text without the blank before each."""
    if not text:
        return []
    if not NO_CUT.search(text):
        return text.split(" ")
    parts = CUT.split(" " + text)
    return [parts[0][1:], *parts[1:]] if parts[0] else parts[1:]


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts, about ``LETTERS`` letters or one text at a time."""
    for batch in batches:
        start, letters, texts = 0, 0, []
        for value in batch.column(column):
            texts.append(value.as_py())
            letters += len(texts[-1])
            if letters >= LETTERS:
                yield batch.slice(start, len(texts)), texts
                start, letters, texts = start + len(texts), 0, []
        if texts:
            yield batch.slice(start, len(texts)), texts


def _by_text(numbers: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """The sum of the chunks' values for each text."""
    if not numbers:
        return np.zeros(0, np.int64)
    running = np.append(0, np.cumsum(values[np.concatenate(numbers)]))
    ends = np.cumsum([len(n) for n in numbers])
    return running[ends] - running[np.append(0, ends[:-1])]


def _spread(numbers: list[np.ndarray], owner: np.ndarray, values: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, values, counts) of the distinct values of each text, from those of its chunks; ``owner`` is sorted."""
    starts = np.searchsorted(owner, np.arange(n + 1))
    chunk = np.concatenate([*numbers, np.zeros(0, np.int64)])
    text = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    size = starts[chunk + 1] - starts[chunk]
    at = np.repeat(starts[chunk] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(int(size.sum()))
    key, counts = np.unique(np.repeat(text, size) * width + values[at], return_counts=True)
    return np.searchsorted(key // width, np.arange(len(numbers) + 1)).astype(np.int32), key % width, counts


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


LINKS = "own array<int>, own_n array<long>, pairs array<long>, pairs_n array<long>"


def linked(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's counts, digest, and distinct links with their numbers; and rows with a task's sums of links, where ``total`` is set.

    ``own``: identity pairs by id of A; ``pairs``: other pairs, as a * size of B + b.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = loaded(a_file, b_file)
        size_a, size_b = len(tokenizers.bytes_a), len(tokenizers.bytes_b)
        identity = np.zeros(size_a, np.int64)
        chunks, times = Chunks(tokenizers), np.zeros(0, np.int64)
        names = ["doc_id", *Aligned.COUNTS, "groups_sha256", "own", "own_n", "pairs", "pairs_n", "total"]

        def sums(own: np.ndarray, own_n: np.ndarray, pairs: np.ndarray, pairs_n: np.ndarray) -> pa.RecordBatch:
            lists = [_lists(np.array([0, len(v)]), v, k) for v, k in ((own, pa.int32()), (own_n, pa.int64()), (pairs, pa.int64()), (pairs_n, pa.int64()))]
            return pa.record_batch([pa.nulls(1, kind_of_id), *(pa.nulls(1, pa.int64()) for _ in Aligned.COUNTS), pa.nulls(1, pa.string()), *lists, pa.array([True])], names)

        def pair_sums() -> pa.RecordBatch:
            """The other pairs of the chunks so far; the identity vector goes on."""
            found = chunks.aligned
            np.add(identity, np.bincount(found.own, times[found.own_chunk], size_a).astype(np.int64), out=identity)
            keys, place = np.unique(found.pairs, return_inverse=True)
            n = np.bincount(place, times[found.pair_chunk], len(keys)).astype(np.int64)
            none = np.zeros(0, np.int64)
            return sums(none, none, keys[n > 0], n[n > 0])

        kind_of_id = None
        for batch, texts in _blocks(batches, 1):
            kind_of_id = batch.column(0).type
            numbers = chunks.numbers(texts)
            found, known = chunks.aligned, len(chunks.number)
            whole = _by_text(numbers, ~found.good) == 0
            counts = [np.where(whole, _by_text(numbers, getattr(found, c)), 0) for c in Aligned.COUNTS]
            digests = [hashlib.sha256(b"".join(map(found.text.__getitem__, own.tolist()))[:-1]).hexdigest() if ok and len(own) else ""
                       for own, ok in zip(numbers, whole)]
            numbers = [own if ok else own[:0] for own, ok in zip(numbers, whole)]
            times = np.append(times, np.zeros(known - len(times), np.int64)) + np.bincount(np.concatenate(numbers), minlength=known)
            own_at, own, own_n = _spread(numbers, found.own_chunk, found.own, known, size_a)
            pair_at, pairs, pairs_n = _spread(numbers, found.pair_chunk, found.pairs, known, size_a * size_b)
            yield pa.record_batch([batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), _lists(own_at, own, pa.int32()),
                                   _lists(own_at, own_n, pa.int64()), _lists(pair_at, pairs, pa.int64()), _lists(pair_at, pairs_n, pa.int64()),
                                   pa.nulls(batch.num_rows, pa.bool_())], names)
            if chunks.full():
                yield pair_sums()
                chunks.forget()
                times = np.zeros(0, np.int64)
        if kind_of_id is not None:
            yield pair_sums()
            used = np.flatnonzero(identity)
            yield sums(used, identity[used], used[:0], used[:0])

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), run,
                     f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {LINKS}, total boolean")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, key, n) over all documents: identity pairs by id of A (key null), other pairs by key (a null). ``rows``: a stored result of ``linked``."""
    of_tasks = rows.where("total")
    own = of_tasks.select(F.explode(F.arrays_zip("own", "own_n")).alias("p")).groupBy(F.col("p.own").alias("a")).agg(F.sum("p.own_n").alias("n"))
    pairs = of_tasks.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p")).groupBy(F.col("p.pairs").alias("key")).agg(F.sum("p.pairs_n").alias("n"))
    return own.select("a", F.lit(None).cast("long").alias("key"), "n").unionByName(pairs.select(F.lit(None).cast("int").alias("a"), "key", "n"))


class Totals:
    """What the second pass looks up: totals of identity pairs by A, largest total by B, and the frequent other pairs in order."""

    def __init__(self, identity: np.ndarray, best: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.identity, self.best, self.keys, self.counts = identity, best, keys, counts

    def pack(self) -> bytes:
        return np.concatenate([[len(self.identity), len(self.best), len(self.keys)], self.identity, self.best, self.keys, self.counts]).astype(np.int64).tobytes()

    @staticmethod
    def read(path: str) -> "Totals":
        data = np.memmap(path, np.int64, "r")
        a, b, n = data[:3].tolist()
        return Totals(data[3:3 + a], data[3 + a:3 + a + b], data[3 + a + b:3 + a + b + n], data[3 + a + b + n:])

    def of_pairs(self, keys: np.ndarray) -> np.ndarray:
        """Totals of other pairs, 0 where they are not in the file."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.counts[place], 0)


def least_hot(counts: DataFrame, most: int) -> int:
    """The least total of a frequent pair, so that at most ``most`` pairs are frequent: totals are told apart by 24 steps a doubling."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 24)
    least, left = None, most
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).toLocalIterator():
        left -= row.pairs
        if left < 0:
            break
        least = row.least
    return least if least is not None else 1 << 62


def totals_of(counts: DataFrame, tokenizers: Tokenizers, hot_pairs: int = HOT_PAIRS) -> tuple[Totals, DataFrame]:
    """The looked-up totals, and (key, n) of the rarer pairs. ``counts``: a stored result of ``pair_counts``."""
    size_a, size_b = len(tokenizers.bytes_a), len(tokenizers.bytes_b)
    identity = np.zeros(size_a, np.int64)
    for row in counts.where("a is not null").collect():  # as many as A has ids
        identity[row.a] = row.n
    others = counts.where("key is not null").select("key", "n")
    mapped = np.flatnonzero(tokenizers.identity >= 0)
    of_identity = {int(a) * size_b + int(tokenizers.identity[a]): int(a) for a in mapped}
    # identity pairs may also be linked in other groups: as many rows as A has ids at most
    own = others.sparkSession.createDataFrame(pa.table({"key": pa.array(list(of_identity), pa.int64())}))
    for row in others.join(F.broadcast(own), "key").collect():
        identity[of_identity[row.key]] += row.n
    best = np.zeros(size_b, np.int64)
    np.maximum.at(best, tokenizers.identity[mapped], identity[mapped])
    for row in others.groupBy(F.pmod("key", F.lit(size_b)).alias("b")).agg(F.max("n").alias("n")).collect():  # as many as B has ids
        best[row.b] = max(best[row.b], row.n)
    least = least_hot(others, hot_pairs)
    hot = others.where(F.col("n") >= least).orderBy("key").toArrow()
    keys, n = hot.column("key").to_numpy(), hot.column("n").to_numpy().copy()
    pairs = Totals(identity, best, keys, n)
    place = np.fromiter((of_identity.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
    n[place >= 0] = identity[place[place >= 0]]
    return pairs, others.where(F.col("n") < least).join(F.broadcast(own), "key", "left_anti")


def summed(rows: DataFrame, totals: str, identity_file: tuple[str, str]) -> DataFrame:
    """One row for each document with what is looked up, and ``rare``: its links (key, k) of pairs that are not. ``rows``: of ``linked``."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, to_b = Totals.read(SparkFiles.get(totals)), loaded(*identity_file).identity
        names = ["doc_id", *Aligned.COUNTS, "groups_sha256", "best", "total", "rare"]
        flat = lambda column: (column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()))
        for batch in batches:
            n, column = batch.num_rows, dict(zip(batch.schema.names, batch.columns))
            a, sizes = flat(column["own"])
            times, _ = flat(column["own_n"])
            keys, pair_sizes = flat(column["pairs"])
            pair_times, _ = flat(column["pairs_n"])
            text, pair_text = np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), pair_sizes)
            first, second = np.divmod(keys, len(known.best))
            pair_total = np.where(to_b[first] == second, known.identity[first], known.of_pairs(keys))  # identity pairs in other groups
            best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)  # whole numbers: no sum of doubles
            np.add.at(total, text, times * known.identity[a])
            np.add.at(total, pair_text, pair_times * pair_total)
            np.add.at(best, text, np.where(known.identity[a] == known.best[to_b[a]], times, 0))
            np.add.at(best, pair_text, np.where((pair_total == known.best[second]) & (pair_total > 0), pair_times, 0))
            left = np.flatnonzero(pair_total == 0)
            at = pa.array(np.searchsorted(pair_text[left], np.arange(n + 1)), pa.int32())
            rare = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(keys[left], pa.int64()), pa.array(pair_times[left], pa.int64())], ["key", "k"]))
            yield pa.record_batch([*(column[c] for c in names[:6]), pa.array(best), pa.array(total), rare], names)

    return arrow_map(rows.where("total is null").drop("total"), run,
                     f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long, "
                     "rare array<struct<key: long, k: long>>")


def align(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    a_file, b_file = publish_tokenizers(spark, a_path, b_path)
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        tokenizers = Tokenizers(a.read(), b.read())
    linked_rows = store(linked(docs, a_file, b_file, id_col, text_col), "linked")
    counts = store(pair_counts(linked_rows), "pair-counts")
    totals, rare = totals_of(counts, tokenizers, hot_pairs)
    name = publish(spark, totals.pack(), "totals.bin")
    rows = store(summed(linked_rows, name, (a_file, b_file)).withColumn("row", F.monotonically_increasing_id()), "aligned")
    size_b = len(tokenizers.bytes_b)
    best = spark.createDataFrame(pa.table({"b": pa.array(range(size_b), pa.int64()), "most": pa.array(totals.best)}))
    links = rows.select("row", F.explode("rare").alias("p")).select("row", "p.*").join(rare, "key") \
        .join(F.broadcast(best), F.pmod("key", F.lit(size_b)) == F.col("b"))
    late = links.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("k")).otherwise(0)).alias("late_best"),
                                    F.sum(F.col("k") * F.col("n")).alias("late_total"))
    return rows.drop("rare").join(late, "row", "left") \
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("late_best", F.lit(0))).alias("n_best"),
                (F.col("total") + F.coalesce("late_total", F.lit(0))).alias("count_sum"), "groups_sha256")
