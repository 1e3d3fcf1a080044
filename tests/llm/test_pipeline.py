"""The pipeline against brute force of its stages, and the contract of the registered queries."""

import hashlib
import re

import pytest

import corpus_pipeline as P
from .test_exact_dedup import brute_force as exact_groups
from .test_jaccard import brute_force as near_groups
from voltrail.llm import mixing, quality
from voltrail.llm.common import tokenizer_path
from voltrail.llm.queries import ORACLES, QUERIES

tokenizers = pytest.importorskip("tokenizers")


def test_every_stage_and_the_whole(spark, sf_dir, table):
    docs = table("documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    verdict = {r.doc_id: r.keep for r in quality.classify(docs, table("labels")).collect()}
    first = sorted(i for i in text if verdict[i])
    second = sorted(i for i, _, _, kept, _ in exact_groups([(i, text[i]) for i in first]) if kept)
    third = sorted(i for i, _, least in near_groups([(i, text[i]) for i in second]) if i == least)
    left = docs.where(docs.doc_id.isin(third))
    times = {r.doc_id: r.repeats for r in mixing.mix(left).collect()}
    fourth = sorted(i for i in third for _ in range(times[i]))
    made, seen = docs, []
    for name, stage in P.STAGES:
        made = P.store(stage(spark, made, sf_dir), "t")
        seen.append(sorted(r.doc_id for r in made.select("doc_id").collect()))
        assert name == P.STAGES[-1][0] or made.columns == docs.columns
    assert seen[0] == first and seen[1] == second and seen[2] == third and seen[3] == fourth
    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = P.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == fourth
    for r in rows:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_an_empty_table(spark, documents, sf_dir):
    made = documents([])
    for _, stage in P.STAGES:
        made = P.store(stage(spark, made, sf_dir), "t")
    assert made.isEmpty()


COLUMNS = {"op1": "doc_id size source_size target taken", "op2": "page_id url text n_chars", "op3": "doc_id p_bad keep",
           "op4": "doc_id keep_id group_size kept text_sha256", "op5": "page_id host path rule verdict", "op6": "doc_id n_words n_tokens",
           "op7": "doc_id n_tokens ids_sha256 decoded_sha256", "op8": "doc_id n_shingles component_id", "op9": "vec_id n_links component_id kept",
           "op10": "doc_id held_out lang_pred score",
           "op11": "query_id rank vec_id score", "op12": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
           "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"}


def test_registered_queries(spark, sf_dir, table):
    assert sorted(re.match(r"op\d+", q)[0] for q in QUERIES) == sorted(COLUMNS) and set(ORACLES) <= set(QUERIES)
    for name, run in QUERIES.items():
        short = re.match(r"op\d+", name)[0]
        df = run(spark, sf_dir)
        assert set(COLUMNS[short].split()) <= set(df.columns)
        source = {"op2": "pages", "op5": "pages", "op9": "embeddings"}.get(short, "documents")
        rows = {"op11": 20 * table("embeddings").where("vec_id % 20 = 0").count(), "op12": 600 * table("documents").select("lang").distinct().count()}
        assert df.count() == (rows[short] if short in rows else table(source).count())
