"""Minimal acyclic transducer: words to numbers, in one automaton that shares prefixes and suffixes.

Words are added in byte order; as soon as a branch is complete its states are merged with equal ones, so the automaton
is minimal at every step. Every arc carries the number of words that lie before it, and the sum along a word's path is
the word's place in the sorted list: the output that leads to its ids. The arcs lie in flat arrays, and the
file of them is opened by ``numpy.memmap``, so that tasks on a machine share its pages.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

FIELDS = ("first", "final", "label", "target", "output", "offsets", "ids")


def compile_lexicon(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The automaton of sorted distinct ``words`` with their ``ids`` as one block of bytes."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []  # by state: ((label, target), ...)
    final_of: list[bool] = []

    def freeze(final: bool, arcs: list[list]) -> int:
        key = (final, tuple(map(tuple, arcs)))
        if key not in register:
            register[key] = len(arcs_of)
            arcs_of.append(key[1])
            final_of.append(final)
        return register[key]

    path: list[list] = [[False, []]]  # open states of the last word: final, arcs (the last arc's target is open)

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = freeze(*path.pop())
            path[-1][1][-1][1] = state

    last = b""
    for word in words:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        close(common)
        for byte in word[common:]:
            path[-1][1].append([byte, -1])
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(*path[0])

    count = [0] * len(arcs_of)  # words that end below a state; targets have smaller numbers
    first, label, target, output = [0], [], [], []
    for state, arcs in enumerate(arcs_of):
        seen = int(final_of[state])
        for byte, to in arcs:  # in byte order, as the words came
            label.append(byte)
            target.append(to)
            output.append(seen)
            seen += count[to]
        count[state] = seen
        first.append(len(label))
    arrays = {
        "first": np.array(first, np.int32), "final": np.array(final_of, np.uint8), "label": np.array(label, np.uint8),
        "target": np.array(target, np.int32), "output": np.array(output, np.int32),
        "offsets": np.cumsum([0, *map(len, ids)]).astype(np.int32),
        "ids": np.array([i for each in ids for i in each], np.int32),
    }
    head = json.dumps({"root": root, "arrays": [[k, arrays[k].dtype.str, len(arrays[k])] for k in FIELDS]}).encode()
    return b"%08d" % len(head) + _padded(head) + b"".join(_padded(arrays[k].tobytes()) for k in FIELDS)


def _padded(data: bytes) -> bytes:
    """Every part starts at a multiple of 8, so that it can be read in place."""
    return data + bytes(-len(data) % 8)


class Lexicon:
    """Read-only view of a compiled lexicon in a local file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        size = int(bytes(data[:8]))
        head, start = json.loads(bytes(data[8:8 + size])), 8 + size + -size % 8
        for name, kind, length in head["arrays"]:
            end = start + length * np.dtype(kind).itemsize
            setattr(self, name, memoryview(np.asarray(data[start:end]).view(kind)))
            start = end + -end % 8
        self.root = head["root"]
        # an arc's key: its state above its label; the arcs lie in the order of their keys
        first = np.asarray(self.first)
        self.arcs = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) << 8 | np.asarray(self.label)
        self.targets, self.outputs, self.ends = np.asarray(self.target), np.asarray(self.output), np.asarray(self.final) == 1

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """The words' numbers, or -1; all words take their next arc at once."""
        data, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        out = np.full(len(words), -1, np.int64)
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        on, depth = np.arange(len(words)), 0
        while len(on):
            ended = sizes[on] == depth
            done = on[ended]
            out[done] = np.where(self.ends[state[done]], total[done], -1)
            on = on[~ended]
            keys = state[on] << 8 | data[starts[on] + depth]
            arc = np.searchsorted(self.arcs, keys)
            fits = self.arcs[np.minimum(arc, len(self.arcs) - 1)] == keys if len(self.arcs) else np.zeros(len(on), bool)
            on, arc = on[fits], arc[fits]
            total[on] += self.outputs[arc]
            state[on] = self.targets[arc]
            depth += 1
        return out

    def many(self, words: Sequence[bytes]) -> list[list[int] | None]:
        """The ids of each word, or None."""
        offsets, ids = self.offsets, self.ids
        return [None if place < 0 else ids[offsets[place]:offsets[place + 1]].tolist() for place in self.places(words).tolist()]

    def ids_of(self, word: bytes) -> list[int] | None:
        return self.many([word])[0]
