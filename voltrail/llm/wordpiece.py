"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest piece of the vocabulary at each place of a word. The automaton is a trie of the pieces in
which every state has a failure link and the number of pieces that following it completes. A word is then read
once, letter by letter: where no arc fits, the popped pieces are counted and the link is followed. Pieces are
never built, and the work is linear in the word's length.

A piece is either the start of a word or a continuation. A word that cannot be covered is one unknown token. Words are
the runs of a text without ASCII white space.

Defined results: a null or empty text has no words and no tokens. Repeated rows are counted each; very long texts
and words are read whole. An empty table gives no rows. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltrail.llm.common import arrow_map, text_of

#: Words that a task remembers; it starts anew beyond that.
REMEMBERED = 300000
UNKNOWN = 1 << 40  # an unknown word counts one token and one of these
START, INSIDE = 0, 1  # the two roots: of word starts and of continuations


class Automaton:
    """``starts``: pieces at the start of a word; ``insides``: pieces that continue one."""

    def __init__(self, starts: Iterable[str], insides: Iterable[str]):
        self.arcs: dict[tuple[int, str], int] = {}
        ends, parents = set(), [(START, ""), (INSIDE, "")]
        for root, pieces in ((START, starts), (INSIDE, insides)):
            for piece in pieces:
                state = root
                for letter in piece:
                    to = self.arcs.get((state, letter))
                    if to is None:
                        to = self.arcs[state, letter] = len(parents)
                        parents.append((state, letter))
                    state = to
                if piece:
                    ends.add(state)
        self.link: list[int | None] = [None] * len(parents)
        self.popped = [0] * len(parents)
        for state in self._by_depth(parents):
            parent, letter = parents[state]
            if state in ends:
                self.link[state], self.popped[state] = INSIDE, 1
                continue
            at, count = self.link[parent], self.popped[parent]
            while at is not None and (at, letter) not in self.arcs:
                count += self.popped[at]
                at = self.link[at]
            if at is not None:
                self.link[state], self.popped[state] = self.arcs[at, letter], count

    @staticmethod
    def _by_depth(parents: list[tuple[int, str]]) -> list[int]:
        depth = [0, 0]
        for parent, _ in parents[2:]:
            depth.append(depth[parent] + 1)
        return sorted(range(2, len(parents)), key=depth.__getitem__)

    def count(self, word: str) -> int:
        """Pieces of a word; 1 + UNKNOWN if it cannot be covered."""
        arcs, link, popped = self.arcs, self.link, self.popped
        state, total = START, 0
        for letter in word:
            to = arcs.get((state, letter))
            while to is None:
                total += popped[state]
                state = link[state]
                if state is None:
                    return 1 + UNKNOWN
                to = arcs.get((state, letter))
            state = to
        while state != INSIDE:
            total += popped[state]
            state = link[state]
            if state is None:
                return 1 + UNKNOWN
        return total


def pieces_of(model: str) -> tuple[list[str], list[str]]:
    """(starts, insides) from a sentencepiece vocabulary: its pieces after a blank start words, the others continue them."""
    import sentencepiece
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [i for i in range(vocabulary.vocab_size())
             if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i) or vocabulary.is_unused(i))]
    pieces = [vocabulary.id_to_piece(i) for i in plain]
    blank = "▁"
    return [p[1:] for p in pieces if p.startswith(blank) and len(p) > 1], [p for p in pieces if blank not in p]


def token_counts(docs: DataFrame, starts: Iterable[str], insides: Iterable[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown. The vocabulary is broadcast: its size is the caller's."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(starts, insides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = text.as_py().encode().split()  # bytes split at ASCII white space only
                new = set(words).difference(known)
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, set(words)
                for word in new:
                    known[word] = automaton.count(word.decode())
                total = sum(map(known.__getitem__, words))
                rows.append((len(words), total % UNKNOWN, total // UNKNOWN))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                                  ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return arrow_map(texts, run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
