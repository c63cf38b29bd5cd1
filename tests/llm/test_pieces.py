"""SentencePiece merge rounds against the library."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import pieces
from tessera.llm import queries as llm_queries

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", " a", "a ", "▁", "▁a", "a ▁ b", "   a   b      c", "\n\n  x\r\n\t", "<s>", "<0x41>", "</s> <unk>", "\0", "é€😀𝄞", " " * 3000, "a" * 9000, "ab" * 5000, "the " * 3000, "中文字" * 50]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(MODEL)


def texts():
    r = random.Random(5)
    alphabets = ["ab", " a", "▁ ", "aeinrst ", "abcdefghijklmnopqrstuvwxyzABC 019.,\n\t", "中文字日本 ", "é€😀 \0\r\n▁x", "aaa bbb", "0123456789+/ABCxyz"]
    return ODD + ["".join(r.choice(a) for _ in range(r.randint(0, 70))) for a in alphabets for _ in range(300)]


@pytest.mark.parametrize("size", [5, 64, pieces.SLICE])
def test_equals_the_library(vocab, library, size):
    rows = texts()
    for a, b, ids, sizes in pieces.encode_texts(vocab, rows, size):
        decoded = pieces.decode_ids(vocab, ids, sizes)
        for text, mine, back in zip(rows[a:b], np.split(ids, np.cumsum(sizes)[:-1]), decoded):
            want = library.encode(text or "", add_eos=True)
            assert mine.tolist() == want, repr(text)
            assert back == library.decode(want)


def test_pieces_in_random_order(vocab, library):
    """Texts out of pieces meet pairs whose merges are better than the ones before them."""
    r = random.Random(6)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    rows = ["".join(r.choice(known) for _ in range(r.randint(1, 30))) for _ in range(4000)]
    for a, b, ids, sizes in pieces.encode_texts(vocab, rows):
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library.encode(rows[a:b], add_eos=True)


def test_rounds_and_single_merges_agree(vocab):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij▁") for _ in range(r.randint(1, 200))) for _ in range(300)]
    symbols = [vocab.symbol_of[[ord(c) for c in w]] for w in words]
    flat, sizes = pieces.merge_rounds(vocab, np.concatenate(symbols), np.array([len(s) for s in symbols]))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [pieces.single_merges(vocab, s.tolist()) for s in symbols]


def test_long_texts_without_spaces(vocab, library):
    r = random.Random(8)
    for text in ("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), " " * 100_000, "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(200_000)), "x" * 100_000):
        for size in (10_000, pieces.SLICE):
            (_, _, ids, _), = pieces.encode_texts(vocab, [text], size)
            assert ids.tolist() == library.encode(text, add_eos=True)


def test_decoding_any_ids(vocab, library):
    r = random.Random(9)
    rows = [[r.choice([1, 2, r.randint(3, 258), r.randint(259, 31999)]) for _ in range(r.randint(0, 12))] for _ in range(500)]
    rows = [x for x in rows if all(i >= 259 or i < 3 for i in x)] + [[], [2], [1, 2], [1, 263, 2], [2, 2, 29871, 29871]]
    got = pieces.decode_ids(vocab, np.concatenate([np.array(x, np.int32) for x in rows]), np.array([len(x) for x in rows]))
    assert got == [library.decode(x) for x in rows]


def test_frames(make, library, spark):
    rows = [(None, None), (None, "one two"), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (8, "one"), (9, "é" * 5000)]
    encoded = pieces.encode(make(rows), MODEL)
    got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str)
    assert got == sorted(((d, library.encode(t or "", add_eos=True)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in pieces.decode(encoded, MODEL).collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert pieces.encode(make(rows).where("false"), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).first()["text"] == ""


def test_query_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in llm_queries.op12_sentencepiece(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert got == want
