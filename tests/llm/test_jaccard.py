import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voltrail.llm.common import store
from voltrail.llm import jaccard as J
from voltrail.llm.shingles import shingle_set


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows, percent=80):
    """(id, size, smallest id reachable) by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    near = defaultdict(set)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in lists[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                near[i].add(j)
    label = list(range(len(rows)))
    for start in range(len(rows)):
        if label[start] == start:
            todo, seen = [start], {start}
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            for j in seen:
                label[j] = start
    least = {}
    for (i, _), lab in zip(rows, label):
        least[lab] = i if least.get(lab) is None else least[lab] if i is None else min(least[lab], i)
    return sorted([(i, len(s), least[lab]) for (i, _), s, lab in zip(rows, sets, label)], key=str)


def joined(df, percent=80):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(df, percent).collect()], key=str)


def corpus(n=240, seed=5):
    """Copies with changes of every size around the threshold, a passage that most share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(rng.choice([3, 12, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base[:3] if i % 2 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(words))
            words[at:at + rng.choice([0, 1, 1])] = [word()]
        if rng.random() < 0.4:
            words += passage
        rows.append((1000 - 3 * i, rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(documents, seed):
    rows = corpus(seed=seed)
    assert joined(documents(rows).repartition(3)) == brute_force(rows)


def test_long_lists_are_dealt_in_cells(documents, monkeypatch):
    monkeypatch.setattr(J, "PART", 4)
    monkeypatch.setattr(J, "STARS", 1)
    monkeypatch.setattr(J, "_TURNS", J._TURNS[:1])
    rows = corpus(seed=7)
    assert joined(documents(rows)) == brute_force(rows)


def test_without_first_links(documents, monkeypatch):
    """The divided lists alone find every link."""
    monkeypatch.setattr(J, "_stars", lambda classes, percent: classes.sparkSession.createDataFrame([], "a long, b long"))
    rows = corpus(seed=9)
    assert joined(documents(rows)) == brute_force(rows)


@pytest.mark.parametrize("percent", [50, 95, 100])
def test_other_similarities(documents, percent):
    rows = corpus(n=120, seed=4)
    assert joined(documents(rows), percent) == brute_force(rows, percent)


def test_edges(documents):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(5, None), (4, ""), (3, " \t"), (9, "one"), (8, "ONE"), (7, "one two three four five"), (6, "one two three four"), (11, long), (10, long + " x"),
            (12, "É a b c d e"), (13, "é a b c d e"), (None, "one"), (9, "other text"), (14, "a b")]
    assert joined(documents(rows, clashes=True)) == brute_force(rows)
    assert joined(documents([])) == []
    assert joined(documents([(1, None), (2, None)])) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("in_files", [False, True])
def test_one_of_a_group_stays(documents, in_files):
    rows = corpus(seed=2)
    df = documents(rows, clashes=True)
    df = store(df.repartition(5), "t") if in_files else df
    left = J.drop_near_copies(df, in_files=in_files)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, least in brute_force(rows) if i == least)


@pytest.mark.parametrize("in_files", [False, True])
def test_one_of_a_group_stays_whatever_its_ids(documents, in_files):
    text = lambda name, last: " ".join([f"{name}{i}" for i in range(60)] + [last])
    rows = [(7, text("a", "x")), (7, text("a", "y")), (None, text("a", "z")), (None, text("b", "x")), (None, text("b", "y")), (9, text("c", "x")),
            (None, text("c", "x")), (9, text("d", "x")), (None, None), (None, ""), (7, "")]
    df = documents(rows, clashes=True)
    df = store(df.repartition(3), "t") if in_files else df
    left = [(r.doc_id, (r.text or "")[:2]) for r in J.drop_near_copies(df, in_files=in_files).collect()]
    assert sorted(left, key=str) == sorted([(7, "a0"), (None, "b0"), (9, "c0"), (9, "d0"), (None, ""), (None, ""), (7, "")], key=str)


def test_real_documents(table):
    docs = table("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert joined(docs) == brute_force(rows)


def test_probing(rng=np.random.default_rng(3)):
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(2))
        n = len(np.intersect1d(a, b))
        for percent in (50, 80, 100):
            assert J.reaches(a, b, percent) == (100 * n >= percent * (len(a) + len(b) - n))


def test_shingle_sets():
    for text in ("", " ", "a", "a b c d", "a b c d e", "a b c d e f a b c d e f", "É \x1c é x\u0085y z w v"):
        assert len(shingle_set(text.encode())) == len(shingles(text))
    assert (shingle_set(b"A b\tc\n d e") == shingle_set(b"a b c d e")).all()
