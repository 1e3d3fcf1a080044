import hashlib
import re
from collections import defaultdict

import pytest

from voltrail.llm import exact_dedup as E


def brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        text = text or ""
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text).encode()).hexdigest()].append((-len(text), doc_id is None, doc_id))
    out = []
    for digest, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], members[0][2], len(members), i == 0, digest) for i, m in enumerate(members)]
    return sorted(out, key=str)


def labels(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_dedup(df).collect()], key=str)


CASES = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "a\u00a0b"), (8, "ü" * 3000), (9, "ü" * 3000), (None, "ab"), (9, "zz"), (9, "zz")]


def test_labels_equal_brute_force(documents):
    assert labels(documents(CASES)) == brute_force(CASES)
    assert labels(documents(CASES, clashes=True)) == brute_force(CASES)


def test_frequent_and_other_groups_agree(documents, monkeypatch):
    rows = [(i, f"text {i % 40}" if i % 3 else "the same  text" + " " * (i % 5)) for i in range(600)]
    assert labels(documents(rows)) == brute_force(rows)  # every group is frequent
    monkeypatch.setattr(E, "HEAVY_SHARE", 5)  # only the largest is
    df = documents(rows)
    assert E.frequent(E.store(E.digests(df).withColumn("row", E.F.monotonically_increasing_id()), "t")).count() == 1
    assert labels(df) == brute_force(rows)


def test_one_row_of_a_group_stays(documents):
    df = documents(CASES, clashes=True)
    left = E.drop_exact_copies(df)
    assert left.columns == df.columns
    kept = sorted([(r.doc_id, r.text) for r in left.collect()], key=str)
    assert len(kept) == len({r[4] for r in brute_force(CASES)})
    assert (3, "a\tb ") in kept and (9, "zz") in kept and (6, " \n") in kept


def test_no_rows(documents):
    assert E.exact_dedup(documents([])).isEmpty() and E.drop_exact_copies(documents([])).isEmpty()


@pytest.mark.parametrize("share", [3, 2000])
def test_no_python_in_the_plan(documents, share, monkeypatch):
    monkeypatch.setattr(E, "HEAVY_SHARE", share)
    plan = E.exact_dedup(documents(CASES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
