import zlib

from voltrail.llm import language as L


def test_accuracy_on_held_out_documents(table):
    docs = table("documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.identify(docs, sample=100).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then they were thinking of this", "de": "der schnelle braune Fuchs springt über den faulen Hund und dann"}


def training(documents):
    return documents([(i, TEXTS[lang] + f" {i}" * (i % 4), lang) for i, lang in enumerate(["en", "de"] * 20)], clashes=True)


def test_edges(documents):
    model = L.fit(training(documents))
    rows = [(1, None), (2, ""), (3, "123 !? 。"), (4, "THE DOG AND THE FOX"), (5, "ÜBER DEN HUND"), (6, "the dog " * 50000), (None, "the fox"), (4, "the dog"),
            (7, "зимний вечер")]
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in L.predict(documents(rows, clashes=True), model).collect()]
    by = {(i, p) for i, p, _, _ in got}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "en"), (None, "en")} <= by and len(got) == len(rows)
    assert all(s == 0 and not r for _, p, s, r in got if p == "und")
    assert [r for i, _, _, r in got if i == 7] == [True]  # far from every centroid
    assert L.predict(documents([]), model).isEmpty()


def test_centroids_of_each_language(documents):
    model = L.fit(training(documents), centroids=3)
    assert sorted(set(model.languages)) == ["de", "en"] and len(model.languages) <= 6


def test_nothing_to_learn_from(documents):
    got = L.identify(documents([(1, "some text", None), (2, None, "en"), (3, "12", "en")])).collect()
    assert [r.lang_pred for r in got] == ["und"] * 3
    assert L.identify(documents([])).isEmpty()


def test_counts_of_ngrams():
    counts = L.counts_of("Ab, ab")
    assert counts.sum() == (5 + 2) + 6 + 5 - 2  # " ab ab ": letters and blanks within, pairs, triples
    assert (counts == L.counts_of(" aB\tAB 1")).all() and L.counts_of("1 2") is None
