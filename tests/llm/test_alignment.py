import hashlib
from collections import Counter

import pytest

from voltrail.llm import alignment as A
from voltrail.llm.common import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = ["The quick brown fox don't  jump  over\n\n the lazy dog's tail.", "", None, " ", "   ", " lead", "trail ", "two  blanks   three", "a\tb \t c\x1c d\x85 e f 　g",
         "ﬁne café Å \U0001f642\U0001f44d\U0001f3fd", "x▁y", "<s> </s> <|endoftext|> <unk> <0x41>", "\x00\x01\n\r\n", "supercalifragilistic " * 3,
         "la casa es azul y el perro duerme", "x" * 3000, "the " * 20000 + "end", "\n \n  \n", "'s 't 'll it's we'LL 123 4567 3.14 !!! ??"]


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def byte_names():
    """The byte of every letter of the byte-level alphabet."""
    alphabet = sorted(tokenizers.pre_tokenizers.ByteLevel.alphabet())
    byte_of, n = {}, 0
    for b in range(256):
        kept = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        byte_of[chr(b) if kept else chr(256 + n)] = b
        n += not kept
    assert sorted(byte_of) == alphabet
    return byte_of


def brute_force(models, rows):
    """Per document the counts of the contract, from whole texts and all pairs of overlapping tokens."""
    a_model, b_model = models
    names, letters = {i: t for t, i in a_model.get_vocab().items()}, byte_names()
    found, pairs = [], Counter()
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            found.append((0, 0, [], []))
            continue
        spans = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i, part in zip(ids, parts):
                own.append((i, at, at + len(part)))
                at += len(part)
            spans.append(own)
        shared = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups, low = [], 0
        left, right = 0, 0
        links = []
        for high in shared:
            x, y = [], []
            while left < len(a) and spans[0][left][2] <= high:
                x.append(spans[0][left])
                left += 1
            while right < len(b) and spans[1][right][2] <= high:
                y.append(spans[1][right])
                right += 1
            groups.append(",".join(str(s[0]) for s in x) + "|" + ",".join(str(s[0]) for s in y))
            links += [(p[0], q[0]) for p in x for q in y if p[1] < q[2] and q[1] < p[2]]
        pairs.update(links)
        found.append((len(a), len(b), groups, links))
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    return [(i, n_a, n_b, len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for (i, _), (n_a, n_b, groups, links) in zip(rows, found)]


def key(row):
    return tuple((x is None, x) for x in row)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [0, 20, A.HOT_PAIRS])
def test_all_columns_equal_brute_force(documents, models, hot):
    rows = [*enumerate(TEXTS), (3, TEXTS[0]), (None, TEXTS[0]), (None, None)]
    df = A.align(documents(rows, clashes=True).repartition(4), A_PATH, B_PATH, hot_pairs=hot)
    assert df.columns == COLUMNS
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(brute_force(models, rows), key=key)


def test_given_documents_equal_brute_force(table, models):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    got = sorted(tuple(r) for r in A.align(table("documents"), A_PATH, B_PATH).collect())
    assert got == sorted(brute_force(models, rows))


def test_forgotten_chunks_are_aligned_again(models):
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        chunks = A.Chunks(A.Tokenizers(a.read(), b.read()))
    texts = ["one two three two one two three  four " + "y" * 100, "", " two"]
    written = lambda: [b"".join(chunks.aligned.text[n] for n in own) for own in chunks.numbers(texts)]
    first = written()
    assert [len(n) for n in chunks.numbers(texts)] == [8, 0, 1] and len(chunks.number) == 6  # equal chunks are aligned once
    chunks.forget()
    assert written() == first


def test_empty_table(documents):
    df = A.align(documents([]), A_PATH, B_PATH)
    assert df.columns == COLUMNS and df.count() == 0
