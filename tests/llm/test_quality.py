import pytest
from pyspark.sql import functions as F

from voltrail.llm import empirical_bayes as B, quality as Q

LABELS = "doc_id long, quality int, toxic int"


def test_accuracy_on_other_labels(table):
    docs, labels = table("documents"), table("labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    fitted = {r.id for r in Q.labels_of(labels).orderBy(F.xxhash64("id"), "id").limit(60).collect()}
    rows = Q.classify(docs, labels, fit_rows=60).collect()
    assert len(rows) == docs.count()
    checked = [(known[r.doc_id], r.keep) for r in rows if r.doc_id in known and r.doc_id not in fitted]
    assert sum(bool(q) == k for q, k in checked) >= 0.93 * len(checked)


def made(documents, clashes=False):
    good, bad = "This is a calm line of prose, and it goes on. ", "BUY!! NOW!! FREE!! "
    rows = [(i, (bad if i % 4 == 0 else good) * (1 + i % 3), "en", f"s{i % 5}") for i in range(120)]
    return documents(rows + [(500, None, None, None), (501, "", "en", "new"), (502, bad * 20000, "en", "s0"), (None, good, "en", "s1"), (1, good, "en", "s1")], clashes)


def labelled(spark, n=80):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)] + [(7, None, None), (None, 1, 0)], LABELS)


def test_edges(spark, documents):
    df = made(documents, clashes=True)
    rows = Q.classify(df, labelled(spark)).collect()
    assert len(rows) == df.count() and all(0 <= r.p_bad <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].keep == (i % 4 != 0) for i in range(2, 120)) and not by[502].keep and by[None].keep
    assert by[500].host is None and by[500].path is None
    kept = Q.keep_good(df, labelled(spark))
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.keep)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_both_kinds_of_labels(spark, documents, labels):
    rows = Q.classify(made(documents), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.evidence == 0 for r in rows)


def test_no_documents(spark, documents):
    assert Q.classify(documents([]), labelled(spark)).isEmpty()
    assert Q.keep_good(documents([]), labelled(spark)).isEmpty()


def test_a_site_s_rate_decides_unclear_texts(spark):
    """Rates of paths lean on their host, those of sparse ones on all documents."""
    rows = [("clean", "a", 0.0)] * 300 + [("clean", "b", 0.0)] * 5 + [("spam", "a", 1.0)] * 300 + [("spam", "b", 0.5)] * 2 + [("new", "a", 0.5)]
    got = {(r.host, r.path): r for r in Q.site_rates(spark.createDataFrame(rows, "host string, path string, bad double")).collect()}
    assert got["clean", "b"].rate < 0.2 < 0.6 < got["spam", "b"].rate
    assert 0.2 < got["new", "a"].rate < 0.8 and got["clean", "a"].rate < 0.01 and got["spam", "a"].rate > 0.99


def test_shrinkage(spark):
    level = spark.createDataFrame([(0.5, 10, 10.0), (0.5, 1000, 500.0)], "parent double, n long, bad double")
    got = {r.n: r for r in B.shrunk(level, "parent", "rate").collect()}
    assert 0.5 < got[10].rate < 1 and got[1000].rate == pytest.approx(0.5)
