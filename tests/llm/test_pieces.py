import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from seamgraph.llm.pieces import Pieces, encode_decode, round_trip  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [
    "", " ", "a", " a", "a  b", "a\nb", "x▁y", "<s> hi", "\0a", "　x", " a  ", "\r\n\t", "▁", "▁▁ ▁", "\n", "\n\n a", "   ", "a \n b", "😀👍🏽 漢字 ᚠ", "é" * 50,
    "a" * 3000, "  lead", "trail ", "\n lead", " \n", "word" * 400,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_against_the_library(library):
    rng = random.Random(1)
    m = Pieces(PATH)
    signs = "abcdeth ▁\n漢字é😀  ing\tS.,12"
    texts = EDGES + ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices(m.piece[259:], k=12)) for _ in range(800)]
    for t in texts:
        ids = library.encode(t)
        assert m.encode(t) == ids, t
        assert m.decode(ids) == library.decode(ids), t
        own, decoded = round_trip(t, PATH)
        assert (own.tolist(), decoded) == (ids, library.decode(ids)), t


def test_loose_ids(library):
    m = Pieces(PATH)
    for ids in ([3, 4, 5], [200, 201], [259, 3], [264, 0, 264], [230, 264], [28705, 264], []):
        assert m.decode(ids) == library.decode(ids)


def test_operator(spark, table, library):
    texts = [None, *EDGES, "same", "same"]
    got = {r["doc_id"]: r for r in encode_decode(table(texts), PATH).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (got[k]["ids"], got[k]["decoded"]) == (ids, library.decode(ids))
    assert encode_decode(table(["a"]).limit(0), PATH).count() == 0


def test_long_texts(spark, table, library):
    rng = random.Random(7)
    signs = "abcdeth ▁\n漢字é😀  ing\tS.,12"
    texts = ["".join(rng.choices(signs, k=n)) for n in (3_001, 40_000, 300_000)] + ["a" * 20_000, "漢" * 9_000, " " * 5_000, "word " * 30_000]
    got = {r["doc_id"]: r for r in encode_decode(table(texts), PATH).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t)
        assert (got[k]["ids"], got[k]["decoded"]) == (ids, library.decode(ids))
