import re

import pytest

from voltrail.llm import mixing as M


def water_fill(sizes, weights, budget, most=3):
    """Targets by repeated resharing of what stops at its limit."""
    left, open_, target = budget, list(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if most * sizes[s] < level * weights[s]]
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


ROWS = [(i, "w " * (1 + i * 7 % 23), "en", ["a", "b", "b", "b", "b", "B", None, "é"][i % 8]) for i in range(400)]


def test_targets_and_words(documents):
    got = M.mix(documents(ROWS, clashes=True)).toPandas()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sources = sorted({r[3] for r in ROWS}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in ROWS if r[3] == s) for s in sources}
    want = water_fill(total, {s: 1 + i % 3 for i, s in enumerate(sources)}, sum(total.values()))
    for s in sources:
        own = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert set(own["source_size"]) == {total[s]}
        assert own["target"].iloc[0] == pytest.approx(want[s])
        assert abs(own["taken"].sum() - want[s]) <= 23
    assert (got["taken"] <= 3 * got["size"]).all()
    assert dict(zip(got["doc_id"], got["size"])) == {r[0]: size(r[1]) for r in ROWS}


def test_smaller_budgets_are_contained(documents):
    df = documents(ROWS)
    small = M.mix(df, budget=0.4).toPandas().set_index("doc_id")["repeats"].sort_index()
    large = M.mix(df, budget=0.9).toPandas().set_index("doc_id")["repeats"].sort_index()
    assert (small <= large).all() and (small < large).any()


def test_reruns_and_layouts_agree(documents):
    one = sorted(M.mix(documents(ROWS)).select("doc_id", "taken").collect())
    assert one == sorted(M.mix(documents(ROWS).repartition(7)).select("doc_id", "taken").collect())


def test_rows_are_repeated(documents):
    df = documents(ROWS, clashes=True)
    taken = {r.doc_id: r.repeats for r in M.mix(df).collect()}
    rows = M.mixed(df)
    assert rows.columns == df.columns
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, None, "en", None), (None, "", "en", None)], [(1, "a"), (1, "a"), (2, "b c", "en", "s")]])
def test_edge_tables(documents, rows):
    got = M.mix(documents(rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)


def test_a_single_source_is_taken_once(documents):
    got = M.mix(documents([(i, "x y z") for i in range(50)])).collect()
    assert all(r.taken == r.size == 3 for r in got)
