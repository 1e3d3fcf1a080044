import itertools
import re

import pytest

from voltrail.llm import filter_audit as A

LONG = "a b c d e " * 50
ALL_WORDS = " ".join(f"w{i}" for i in range(250))
LABELS = "doc_id long, quality int, toxic int, part string"


def brute_force(rows, labels):
    """Every column of the contract, by applying each order to each document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts, smallest = {}, {}
    no_id = 1 << 63
    for i, text, *_ in rows:
        smallest[text or ""] = min(smallest.get(text or "", no_id), no_id if i is None else i)
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": re.search("[#$%&*|]", text) is not None, "E": (no_id if i is None else i) > smallest[text]}
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        removed_by, lines = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                early = sum(f in d[0] for d in docs) - len(gone)
                left = [d for d in left if f not in d[0]]
                removed_by[f] += len(gone)
                lines.append([part, order, step, len(left), len(gone), early, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        out += [tuple([*line, removed_by[line[1][line[2] - 1]]]) for line in lines]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
ROWS = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG, "fr"), (4, ALL_WORDS, "en"), (5, ALL_WORDS + " #", "en"), (6, "SHOUT " * 210, "en"), (7, None, "en"), (8, "", None),
        (9, "", ""), (10, "short text", "fr"), (10, "short text", "fr"), (11, "short text", "en"), (None, "short text", "de"), (None, "alone", "de"), (None, "alone", "de"),
        (0, ALL_WORDS, "es"), (12, ALL_WORDS + " $ " + "ABC" * 300, "es"), (13, "a b " * 300, "es"), (14, "x" * 100000, "en"), (-5, LONG, "en")]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (4, None, 1), (7, 1, None), (10, 1, 1), (None, 1, 1), (0, 1, 1), (-5, 1, 0), (99, 1, 1)]


def write(documents, rows, path, files):
    documents(rows, clashes=True).repartition(files).write.parquet(path)


def read(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("files", [1, 2, 100])
def test_all_orders_equal_brute_force(spark, documents, tmp_path, files):
    """Batches of 1, 2 or all 7 files: smaller ids arrive in later batches."""
    write(documents, ROWS, f"{tmp_path}/documents.parquet", 7)
    labels = spark.createDataFrame([(*m, "x") for m in MARKS], LABELS)
    found = A.counters(spark, f"{tmp_path}/documents.parquet", labels, files)
    assert read(A.interactions(found)) == brute_force(ROWS, MARKS)
    assert found.agg({"n": "sum"}).first()[0] == len(ROWS)


def test_falling_ids_retract_every_batch(spark, documents, tmp_path):
    """Each file has a smaller id of the same text than the one before it."""
    rows = [(9 - i, ALL_WORDS, "en" if i % 2 else "fr") for i in range(6)]
    for i, row in enumerate(rows):
        documents([row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert read(A.interactions(A.counters(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame([], LABELS), 1))) == brute_force(rows, [])


def test_a_single_file_and_the_given_tables(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert read(A.audit(spark, sf_dir)) == brute_force([(r.doc_id, r.text, r.lang) for r in docs], [(r.doc_id, r.quality, r.toxic) for r in labels])


def test_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert read(A.audit(spark, str(tmp_path))) == []
