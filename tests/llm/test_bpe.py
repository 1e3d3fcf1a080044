import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from hypothesis import given, settings, strategies as st

from voltrail.llm import bpe as B
from voltrail.llm.common import tokenizer_path
from voltrail.llm.lexicon import Lexicon, compile_lexicon

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = ["a<|endoftext|>b <|STARTOFTEXT|> \u0391\u03a3 \u03a3\u0391\u03a3 \u0130x \x1c\x1d a\x1eb caf\u0065\u0301 \uff11\u2460 don't we'LL 'S''s x'", "", "   ",
         "<|startoftext|>", "a\u200bb\u0085c\u2028\u3000\u017f \u212a \u01c5 \u1e9e", "\U0001f642\U0001f44d\U0001f3fd \u0928\u092e \u0e44\u0e17\u0e22 \u4e2d\u6587", "\ufb01 \u00bd x\u00b2 _a_b--c",
         "<|endo <|endoftext|", "the " * 30000 + "end", "x" * 5000, None]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def of_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("words", [0, 3, 1000])
def test_ids_and_texts_equal_the_library(documents, library, words):
    df = documents(list(enumerate(TEXTS)) + [(None, "null id"), (1, "twice")], clashes=True)
    encoded = B.encode(df, PATH, lexicon_words=words)
    decoded = {r.doc_id: r.text for r in B.decode(encoded, PATH).where("doc_id != 1").collect()}
    for row in encoded.where("doc_id != 1").collect():
        ids, text = of_library(library, TEXTS[row.doc_id])
        assert row.ids == ids and decoded[row.doc_id] == text


def test_query_columns(documents, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in B.digest(documents(list(enumerate(TEXTS))), PATH, keep_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids, back = of_library(library, text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, got[i].ids) == (len(ids), sha(" ".join(map(str, ids))), sha(back), ids)


def test_no_rows(documents):
    assert B.digest(documents([]), PATH).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library = tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_any_text, "library") else test_any_text.library
    test_any_text.library = library
    model = B.merger(PATH)
    ids = [i for special, part in model.segments(text) for i in ([model.special[part]] if special else
                                                                [x for c in model.chunks(part) for w in model.words(c) for x in model.merge(w.encode())])]
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_word_counts(documents):
    got = {r.word: r.n for r in B.word_counts(documents([(1, "The the, don't"), (2, None), (3, "the 12")]), PATH).collect()}
    assert got == {"the": 3, ",": 1, "don": 1, "'t": 1, "1": 1, "2": 1}


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({a + b + c for a in (b"", b"x", b"yy") for b in (b"ing", b"ed", b"ings") for c in (b"", b"!", "é".encode())} | {b"a"})
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon(words, [[i, 2 * i] for i in range(len(words))]))
    lexicon = Lexicon(str(path))
    assert [lexicon.ids_of(w) for w in words] == [[i, 2 * i] for i in range(len(words))]
    assert all(lexicon.ids_of(w) is None for w in (b"", b"in", b"zz", b"ingx", b"xinging"))
    signatures = [(f, tuple(lexicon.label[a:b]), tuple(lexicon.target[a:b])) for f, a, b in zip(lexicon.final, lexicon.first, lexicon.first[1:])]
    assert len(set(signatures)) == len(signatures)  # no two states are alike


def test_empty_lexicon(tmp_path):
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon([], []))
    assert Lexicon(str(path)).ids_of(b"a") is None


def test_what_comes_again_stays_remembered(tmp_path, monkeypatch):
    """A chunk of many texts is learned once, although rare ones fill the memory several times."""
    monkeypatch.setattr(B, "KNOWN", 400)
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon([], []))
    encoder, learned = B.Encoder(B.merger(PATH), Lexicon(str(path))), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda chunks, *rest: learned.extend(chunks) or learn(chunks, *rest))
    known = {}
    for i in range(0, 60, 2):
        usual = "often, " if i % 4 else ""  # not in every call
        made = [list(p) for p in encoder.pieces([f"{usual}r{i}x{j} r{i}y{j}" for j in range(20)], known, list)]
        assert len(known) <= 400 and all(made)
    assert learned.count("often,") == 1


def test_words_before_marks(library):
    model = B.merger(PATH)
    assert model.ends == set(",.;:!?")
    for text in ("word,", "\u00e9t\u00e9.", "\u4e2d\u6587!", "1,", "a1.", "it's,", ",", ",,", "a,,", "don't", "\u00aa;", "\u2160.", "a\u0301?"):
        ids = [x for c in model.chunks(text) for w in model.words(c) for x in model.merge(w.encode())]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_memory_grows_with_different_chunks(documents, tmp_path, monkeypatch):
    """Python makes no string for each place of a chunk, and no letter for each token."""
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon([], []))
    monkeypatch.setattr(B, "arrow_map", lambda df, run, schema: run)
    monkeypatch.setattr(B, "build_lexicon", lambda *args: "lexicon")
    monkeypatch.setattr(B, "lexicon", lambda name: Lexicon(str(path)))
    run = B.digest(documents([]), PATH)
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["few words, often " * 55000, "x"])], ["doc_id", "text"])
    list(run(iter([batch.slice(1)])))
    tracemalloc.start()
    rows = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows[0]["n_tokens"] == 4 * 55000
    assert most < 10 * len(batch.column(1)[0].as_py())


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_digests_of_texts_cut_in_blocks(size, monkeypatch):
    monkeypatch.setattr(B, "JOINED", size)
    values, places, ends = ["a b ", "", "c ", "dd e "], [1, 0, 2, 1, 1, 1, 3, 3, 1, 1, 0], [0, 2, 2, 3, 6, 11, 11]
    got = B.joined_sha256(pa.array([v.encode() for v in values], pa.large_binary()), np.array(places, np.int32), np.array(ends))
    whole = ["".join(values[p] for p in places[a:b])[:-1] for a, b in zip([0, *ends], ends)]
    assert got == [hashlib.sha256(w.encode()).hexdigest() for w in whole]
    assert B.joined_sha256(pa.array([], pa.large_binary()), np.array([], np.int32), np.array([0, 0])) == [hashlib.sha256().hexdigest()] * 2


def test_texts_of_one_call(library, tmp_path):
    """Plain, odd and special texts side by side, with a small lexicon."""
    words = [b"a", b"the", b"word"]
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon(words, B.merger(PATH).merge_many(words)))
    encoder = B.Encoder(B.merger(PATH), Lexicon(str(path)))
    texts = [t or "" for t in TEXTS] + [" word\x1cthe ", "\u16ea0 \U00016ea0x \ua7da.", "<|endoftext|><|startoftext|>", "the\u2003word\xa0a ", "\x1f", "\x1f <|endoftext|>\x1c the"]
    made = [[i for ids in own for i in ids] for own in encoder.pieces(texts * 2, {}, list)]
    assert made == [of_library(library, t)[0] for t in texts] * 2
    assert [encoder.encode(t) for t in texts] == made[:len(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(["<|endoftext|>", "a\x1d b", " the "]), max_size=5))
def test_any_split(texts):
    model = B.merger(PATH)
    chunks, places, ends = model.split(texts)
    flat = [chunks[p] for p in places]
    got = [[c for c in flat[a:b] if c] for a, b in zip([0, *ends], ends)]
    assert got == [[c for special, part in model.segments(t) for c in ([" " + part] if special else model.chunks(part))] for t in texts]


def test_arrow_splits_where_the_tokenizer_does():
    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    cut = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in letters]))).to_numpy() > 1
    blank = regex.compile(f"[{B.BLANK}\x1c-\x1f]").fullmatch  # texts with the last four are split by ``odd_chunks``
    assert [c for c, own in zip(letters, cut) if own] == [c for c in letters if blank(c)]
