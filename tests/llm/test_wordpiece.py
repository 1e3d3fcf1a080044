import pytest
from hypothesis import given, settings, strategies as st

from voltrail.llm import wordpiece as W
from voltrail.llm.common import tokenizer_path

STARTS, INSIDES = ["a", "ab", "abc", "b", "xyz"], ["b", "bc", "cd", "d", "abcd", "c"]


def greedy(word, starts, insides):
    at, n = 0, 0
    while at < len(word):
        vocabulary = insides if at else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1 + W.UNKNOWN
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.sets(st.text("abc", min_size=1, max_size=4), max_size=8),
       st.text("abcd", min_size=1, max_size=14))
def test_counts_equal_the_greedy_search(starts, insides, word):
    assert W.Automaton(starts, insides).count(word) == greedy(word, starts, insides)


def test_real_vocabulary(table, documents):
    pytest.importorskip("sentencepiece")
    starts, insides = W.pieces_of(tokenizer_path("piece_bpe_32k.model"))
    docs = table("documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    s, i, known = set(starts), set(insides), {}
    for row in W.token_counts(docs, starts, insides).collect():
        words = (texts[row.doc_id] or "").encode().split()
        for w in words:
            known.setdefault(w, greedy(w.decode()[:400], s, i))
        total = sum(known[w] for w in words)
        assert (row.n_words, row.n_tokens, row.n_unknown) == (len(words), total % W.UNKNOWN, total // W.UNKNOWN)


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "abcd abc q"), (5, "ab " * 50000), (None, "a"), (4, "a\u00a0b"), (6, "a" + "b" * 100000)]
    got = sorted([(r.doc_id or 0, r.n_words, r.n_tokens, r.n_unknown) for r in W.token_counts(documents(rows, clashes=True), STARTS, INSIDES).collect()])
    assert got == [(0, 1, 1, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 1, 1), (4, 3, 4, 1), (5, 50000, 50000, 0), (6, 1, 100000, 0)]
    assert W.token_counts(documents([]), STARTS, INSIDES).isEmpty()
