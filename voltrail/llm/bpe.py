"""Byte-pair encoding and decoding over a transducer lexicon.

The words of the corpus are counted in Spark, the most frequent ones (``LEXICON_WORDS``) are encoded once and compiled
into a minimal acyclic transducer (``lexicon.py``). Its file lies in the shared folder, Spark hands it to every executor,
and the tasks map it into memory. A word that the lexicon lacks is merged exactly, pair by pair, so the lexicon's
size changes the speed and never the ids.

The tokenizer file is one of the ``tokenizers`` format: byte-level BPE with an end-of-word suffix, NFC, white space to one
blank, lower case, and a split by a pattern no part of which matches white space. Its pattern, vocabulary, merges and special
tokens are read from the file. Special tokens in a text are encoded as such, and a vocabulary without decoder joins
its tokens by a blank, as the library does.

Defined results: a null text is an empty text and has no tokens. Repeated rows stay and are encoded each;
very long texts are encoded whole. An empty table gives no rows. Other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from voltrail.llm.common import arrow_map, publish, store, text_of
from voltrail.llm.lexicon import Lexicon, compile_lexicon

#: Most words in the lexicon (a bound on its size, about 40 bytes each), and how often each must occur.
LEXICON_WORDS, LEXICON_COUNT = 50000, 8
#: Chunks of text that a task counts before it gives their words away, and those whose ids a worker remembers; beyond that it keeps what came more than once.
REMEMBERED, KNOWN = 200000, 400000
#: Letters of text that are encoded at a time, and bytes of a word that is merged in an array with others.
AT_ONCE, IN_ARRAY = 1_000_000, 48
#: White space of the tokenizer's pattern: the Unicode property, which lacks U+001C to U+001F.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = 1 << 60
CHUNKS = pa.list_(pa.large_string())

# Code points of Unicode 16 that the tables of an older Python lack, as letters and as numbers, and lower
# cases of Unicode 17 in the form first-last:distance. The tokenizers library has them.
NEW_LETTERS = ("1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E "
               "11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF "
               "1E5D0-1E5ED 1E5F0-1E5F0")
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEW_CASES = ("1C89-1C89:1 A7CB-A7CB:-A567 A7CC-A7CC:1 A7CE-A7CE:1 A7D2-A7D2:1 A7D4-A7D4:1 A7DA-A7DA:1 A7DC-A7DC:-A641 10D50-10D65:20 "
             "16EA0-16EB8:1B")


def _ranges(text: str) -> list[tuple[int, int]]:
    return [tuple(int(x, 16) for x in part.split("-")) for part in text.split()]


def _class(first_letter: str, new: str) -> str:
    """The inside of a character class: code points of a general category, by Python's tables and the newer ones."""
    known = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == first_letter]
    edges = [i for i, (a, b) in enumerate(zip(known, known[1:])) if b != a + 1]
    starts, ends = [0, *(i + 1 for i in edges)], [*edges, len(known) - 1]
    spans = [(known[a], known[b]) for a, b in zip(starts, ends)] + _ranges(new)
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans)


def _cases() -> dict[int, int]:
    spans = [(*_ranges(part.split(":")[0])[0], int(part.split(":")[1], 16)) for part in NEW_CASES.split()]
    return {i: i + distance for first, last, distance in spans for i in range(first, last + 1)}


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Merger:
    """The tokenizer of a file: words of a text, exact merges of a word, tokens of ids."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("not a lower-casing byte-level vocabulary of words")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.tokens = {i: t for t, i in vocab.items()}
        # a pair's value: rank of the merge above the merged token's id; ids have 20 bits
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.letters = {i: chr(i) for i in self.tokens}
        # ids as decimals and as tokens, each with a blank after it, in the places of the ids
        self.names = tuple(pa.array([(name(i) + " ").encode() if i in self.tokens else b"" for i in range(max(self.tokens) + 1)], pa.large_binary())
                           for name in (str, self.tokens.__getitem__))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = split["pattern"]["Regex"]
        for name, members in ((r"\p{L}", _class("L", NEW_LETTERS)), (r"\p{N}", _class("N", NEW_NUMBERS)), (r"\s", BLANK)):
            pattern = regex.sub(r"\[[^]]*\]", lambda m: m[0].replace(name, members), pattern)
        if regex.search(r"\\[psPS]", pattern):
            raise ValueError("a pattern with classes outside brackets")
        self.any_words = regex.compile(pattern).findall
        plain = split["pattern"]["Regex"]
        for name, members in ((r"\p{L}", "a-zA-Z"), (r"\p{N}", "0-9")):
            plain = plain.replace(name, members)
        self.ascii_words = re.compile(plain, re.ASCII).findall
        # marks that the pattern cuts off from letters, as most chunks that are no word end in one
        self.ends = {mark for mark in ",.;:!?" if all(self.any_words(word + mark) == [word, mark] for word in ("a", "é", "ab", "éb中"))}
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_keys, self.pair_values = keys, np.array([self.pairs[k] for k in keys.tolist()], np.int64)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        # values of two neighbouring bytes: inside a word, and where the second ends it
        self.byte_values = np.concatenate([self._values(np.repeat(self.inner_ids, 256), np.tile(second, 256)) for second in (self.inner_ids, self.last_ids)])
        self.cases = _cases()
        self.new_case = regex.compile("[" + "".join(map(chr, self.cases)) + "]").search
        self.odd_chunks = regex.compile(f"[^{BLANK}]+").findall

    def normal(self, text: str) -> str:
        """The normalised text, but for the lower cases that Python lacks: ``words`` adds them."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text between white space, normalised by ``normal``."""
        text = self.normal(text)
        # str.split also splits at four control characters that are not white space here
        return text.split() if not self.odd(text) else self.odd_chunks(text)

    def odd(self, text: str) -> bool:
        return any(c in text for c in "\x1c\x1d\x1e\x1f")

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different chunks of the texts, the place among them of every chunk in order, and where each text's chunks end.

        A special token is a chunk that begins with a blank. The empty chunk stands for white space at an end of a text.
        """
        lists: list[pa.Array] = [pa.array([], CHUNKS)]
        plain: list[str] = []

        def cut() -> None:
            lists.append(pc.utf8_split_whitespace(pa.array(plain, pa.large_string())))
            plain.clear()

        for text in texts:
            segments = self.segments(text)
            own = self.normal(text) if len(segments) == 1 and not segments[0][0] else None
            if own is not None and not self.odd(own):  # Arrow splits where str.split does
                plain.append(own)
                continue
            cut()
            lists.append(pa.array([[c for special, part in segments for c in ([" " + part] if special else self.chunks(part))]], CHUNKS))
        cut()
        chunks = pa.concat_arrays(lists)
        coded = chunks.flatten().dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum(pc.list_value_length(chunks).to_numpy(), dtype=np.int64)

    def words(self, chunk: str) -> list[str]:
        """Words of a chunk."""
        if not chunk:
            return []
        if not chunk.isascii() and self.new_case(chunk):
            chunk = chunk.translate(self.cases)
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in self.ends and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.ascii_words(chunk) if chunk.isascii() else self.any_words(chunk)

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """Parts of a text: (is a special token, part)."""
        if not self.specials or "<|" not in text and not self.specials.search(text):
            return [(False, text)]
        return [(i % 2 == 1, part) for i, part in enumerate(self.specials.split(text)) if part]

    def merge(self, word: bytes) -> list[int]:
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        get = self.pairs.get
        values = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while values:
            best = min(values)
            if best == NONE:
                break
            i = values.index(best)
            ids[i:i + 2] = [best & 0xFFFFF]
            del values[i]
            if i:
                values[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(values):
                values[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _values(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = (first << 20) | second
        place = np.searchsorted(self.pair_keys, keys)
        place[place == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[place] == keys) & (second >= 0), self.pair_values[place], NONE)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many words: in each round all words make their next merge at once."""
        out: list = [None] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= IN_ARRAY), key=lambda i: len(words[i]))
        for i, word in enumerate(words):
            if len(word) > IN_ARRAY:
                out[i] = self.merge(word)
        for start in range(0, len(short), 8192):
            part = np.array(short[start:start + 8192])
            sizes = np.array([len(words[i]) for i in part])
            ids = np.full((len(part), int(sizes[-1]) + 1), -1, np.int64)
            data = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(part)), sizes)
            ends = np.cumsum(sizes)
            place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
            ids[row, place] = self.inner_ids[data]
            ids[np.arange(len(part)), sizes - 1] = self.last_ids[data[ends - 1]]
            values = np.full((len(part), ids.shape[1] - 1), NONE, np.int64)
            closing = np.zeros(len(data), bool)
            closing[ends - 1] = True
            inside = np.flatnonzero(~closing)  # bytes with another after them
            values[row[inside], place[inside]] = self.byte_values[closing[inside + 1] * 65536 + data[inside] * 256 + data[inside + 1]]
            column = np.arange(ids.shape[1])
            while len(part):
                at = values.argmin(axis=1)
                best = values[np.arange(len(part)), at]
                done = best == NONE
                if done.any():
                    for i, own in zip(part[done].tolist(), ids[done].tolist()):
                        out[i] = own[:own.index(-1)]
                    part, ids, values, at, best = part[~done], ids[~done], values[~done], at[~done], best[~done]
                every = np.arange(len(part))
                ids[:, :-1] = np.where(column[:-1] > at[:, None], ids[:, 1:], ids[:, :-1])
                ids[every, at] = best & 0xFFFFF
                values[:, :-1] = np.where(column[:-2] > at[:, None], values[:, 1:], values[:, :-1])
                values[every, at] = self._values(ids[every, at], ids[every, at + 1])
                left = at > 0
                values[every[left], at[left] - 1] = self._values(ids[every[left], at[left] - 1], ids[every[left], at[left]])
        return out


_MERGERS: dict[str, Merger] = {}
_LEXICONS: dict[str, Lexicon] = {}


def merger(path: str) -> Merger:
    """The tokenizer of a file that is installed on every machine; read once for each worker."""
    if path not in _MERGERS:
        with open(path, encoding="utf-8") as file:
            _MERGERS[path] = Merger(file.read())
    return _MERGERS[path]


def lexicon(name: str) -> Lexicon:
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon(SparkFiles.get(name))
    return _LEXICONS[name]


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    """One text at a time; a long batch is never a list of Python strings."""
    for value in batch.column(column):
        yield value.as_py() or ""


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; tasks sum their own words first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(tokenizer)

        def flush(seen: dict[str, int]) -> Iterator[pa.RecordBatch]:
            words: dict[str, int] = {}
            for chunk, n in seen.items():
                if not chunk.startswith(" "):  # no special token
                    for word in model.words(chunk):
                        words[word] = words.get(word, 0) + n
            keys = list(words)
            for i in range(0, len(keys), 50000):
                part = keys[i:i + 50000]
                yield pa.record_batch([pa.array(part, pa.string()), pa.array([words[w] for w in part], pa.int64())], ["word", "n"])

        seen: dict[str, int] = {}
        for batch in batches:
            for _, texts in parts_of(batch, 0):
                chunks, places, _ = model.split(texts)
                for chunk, n in zip(chunks, np.bincount(places, minlength=len(chunks)).tolist()):
                    seen[chunk] = seen.get(chunk, 0) + n
                if len(seen) > REMEMBERED:
                    yield from flush(seen)
                    seen = {}
        yield from flush(seen)

    return arrow_map(docs.select(text_of(text_col).alias("text")), count, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS, least: int = LEXICON_COUNT, text_col: str = "text") -> list[str]:
    """At most ``size`` words: those that occur at least ``least`` times and as often as makes them so few."""
    counts = store(word_counts(docs, tokenizer, text_col).where(F.col("n") >= least), "words")
    floor, left = None, size
    for row in counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).toLocalIterator():
        left -= row["count"]
        if left < 0:
            break
        floor = row.n
    return [] if floor is None else [r.word for r in counts.where(F.col("n") >= floor).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the frequent words of the corpus; the name of the published file."""
    words = sorted(w.encode() for w in frequent_words(docs, tokenizer, size, text_col=text_col))
    return publish(docs.sparkSession, compile_lexicon(words, merger(tokenizer).merge_many(words)), "lexicon.bin")


class Encoder:
    """Ids of whole texts, with the lexicon first and exact merges for all other words."""

    def __init__(self, model: Merger, words: Lexicon):
        self.model, self.lexicon = model, words
        self.again: set[str] = set()  # remembered chunks that came again

    def learn(self, chunks: list[str], known: dict, shape: Callable) -> None:
        """Put ``shape(ids)`` of each chunk into ``known``."""
        parts = {chunk: self.model.words(chunk) for chunk in chunks if not chunk.startswith(" ")}
        words = list(set(chain.from_iterable(parts.values())))
        ids = dict(zip(words, self.lexicon.many([word.encode() for word in words])))
        unseen = [word for word, found in ids.items() if found is None]
        ids.update(zip(unseen, self.model.merge_many([word.encode() for word in unseen])))
        for chunk in chunks:
            words = parts.get(chunk)
            if words is None:
                known[chunk] = shape([self.model.special[chunk[1:]]])
            else:
                known[chunk] = shape(ids[words[0]] if len(words) == 1 else [i for word in words for i in ids[word]])

    def shapes(self, chunks: list[str], known: dict, shape: Callable) -> list:
        """The shapes of different chunks. ``known`` remembers them between calls."""
        found = list(map(known.get, chunks))
        new = [chunk for chunk, own in zip(chunks, found) if own is None]
        if len(known) + len(new) > KNOWN:
            stay = self.again if len(self.again) + len(chunks) <= KNOWN * 3 // 4 else ()
            kept = {k: known[k] for k in {*stay, *chunks} if k in known}
            known.clear()
            known.update(kept)
            self.again = set()
        self.again.update(compress(chunks, found))
        self.learn(new, known, shape)
        return list(map(known.__getitem__, chunks)) if new else found

    def pieces(self, texts: list[str], known: dict, shape: Callable) -> Iterator[list]:
        """For each text the shapes of its chunks in order, without chunks that have no tokens."""
        chunks, places, ends = self.model.split(texts)
        here, start = self.shapes(chunks, known, shape), 0
        for end in ends.tolist():
            yield [here[i] for i in places[start:end].tolist() if here[i]]
            start = end

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(next(self.pieces([text], {}, list))))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.model.tokens[i] for i in ids if i in self.model.tokens])


def parts_of(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``AT_ONCE`` letters of text each."""
    start, texts, size = 0, [], 0
    for end, text in enumerate(texts_of(batch, column), 1):
        texts.append(text)
        size += len(text)
        if size >= AT_ONCE or end == batch.num_rows:
            yield batch.slice(start, end - start), texts
            start, texts, size = end, [], 0


#: Chunks whose strings are joined at a time; a very long text is never joined whole.
JOINED = 65536


def grouped(values: pa.LargeBinaryArray, edges: np.ndarray) -> pa.LargeBinaryArray:
    """Neighbouring values joined to one from each edge to the next."""
    if not len(values):
        return pa.array([b""] * (len(edges) - 1), pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)[edges]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(offsets), values.buffers()[2]])


def joined_sha256(values: pa.LargeBinaryArray, places: np.ndarray, ends: np.ndarray) -> list[str]:
    """For each text the digest of its values in order, without the very last blank; each value ends in a blank or is empty."""
    sums, begun = [hashlib.sha256() for _ in ends], [False] * len(ends)
    for low in range(0, len(places), JOINED):
        taken = values.take(pa.array(places[low:low + JOINED]))
        joined, high = memoryview(taken.buffers()[2] or b""), low + len(taken)
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high)
        cuts = np.clip(np.concatenate([[low], ends[first:last + 1]]), low, high) - low
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[cuts].tolist()
        for text, (a, b) in enumerate(zip(at, at[1:]), int(first)):
            if a < b:
                if begun[text]:  # the text began in an earlier block
                    sums[text].update(b" ")
                sums[text].update(joined[a:b - 1])
                begun[text] = True
    return [one.hexdigest() for one in sums]


#: What a worker remembers for the lexicon it used last, by kind of shape.
_KNOWN: dict[tuple[str, str], dict] = {}


def remembered(name: str, kind: str) -> dict:
    if (name, kind) not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name, kind] = {}
    return _KNOWN[name, kind]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""
    return digest(docs, tokenizer, id_col, text_col, lexicon_words, keep_ids=True).select("doc_id", "ids")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: doc_id, text (the tokens of its ids joined as the vocabulary does)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merger(tokenizer).tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids.as_py() or () if i in tokens]) for ids in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, f"doc_id {kind}, text string")


def digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           lexicon_words: int = LEXICON_WORDS, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; encoded and decoded in one pass.

    ``keep_ids`` adds the ids themselves as an array.
    """
    name = build_lexicon(docs, tokenizer, lexicon_words, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merger(tokenizer), lexicon(name))
        known = remembered(name, "digest")

        letters = encoder.model.letters  # a remembered chunk is a string with a letter for each token, whose code is the id: it is small

        def shape(ids: list[int]) -> str:
            return letters[ids[0]] if len(ids) == 1 else "".join(map(letters.__getitem__, ids))

        for batch in batches:
            for part, texts in parts_of(batch):
                chunks, places, ends = encoder.model.split(texts)
                made = encoder.shapes(chunks, known, shape)
                sizes = np.fromiter(map(len, made), np.int64, len(made))
                flat = np.frombuffer("".join(made).encode("utf-32-le", "surrogatepass"), np.int32)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                total = np.concatenate([[0], np.cumsum(sizes[places])])
                bounds = np.concatenate([[0], ends])
                columns = [part.column(0), pa.array(np.diff(total[bounds]), pa.int64())]
                columns += [pa.array(joined_sha256(grouped(names.take(pa.array(flat)), edges), places, ends), pa.string()) for names in encoder.model.names]
                if keep_ids:
                    lists = pa.LargeListArray.from_arrays(pa.array(edges), pa.array(flat))
                    columns.append(pa.array([lists.take(pa.array(places[a:b])).flatten().to_numpy() for a, b in zip(bounds, bounds[1:])], pa.list_(pa.int32())))
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return arrow_map(texts, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
