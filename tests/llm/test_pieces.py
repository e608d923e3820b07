"""SentencePiece merges and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest

from sparkwave.llm.pieces import PieceModel, decode, encode

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return PieceModel(MODEL)


def texts(rng, vocabulary, n):
    for _ in range(n):
        kind = rng.randrange(8)
        if kind == 0:
            yield "".join(rng.choice(" ▁ \n\tab") for _ in range(rng.randint(0, 60)))
        elif kind == 1:
            yield "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 50)))
        elif kind == 2:
            yield "".join(rng.choice(vocabulary).replace("▁", " ") for _ in range(rng.randint(0, 40)))
        elif kind == 3:
            yield "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(0, 300)))
        elif kind == 4:
            yield " " * rng.randint(0, 200) + "x" * rng.randint(0, 100)
        elif kind == 5:
            yield "".join(rng.choice("═─=-*#_.") * rng.randint(1, 40) for _ in range(rng.randint(0, 9)))
        else:
            yield " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 50)))


@pytest.mark.parametrize("memory", [300_000, 20])
def test_ids_and_text_as_the_library(pieces, monkeypatch, memory):
    monkeypatch.setattr(PieceModel, "MEMORY", memory)
    monkeypatch.setattr(pieces, "memory", {})
    rng, vocabulary = random.Random(5), list(pieces.known)
    for _ in range(20):
        group = list(texts(rng, vocabulary, 100))
        want = pieces.library.encode(group)
        got = pieces.encode(group)
        assert [ids.tolist() for ids in got] == want
        assert pieces.decode(got) == [pieces.library.decode(ids) for ids in want]
        assert len(pieces.memory) <= memory


def test_decode_any_ids(pieces):
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 2), rng.randint(3, 258), rng.randrange(pieces.size), 28705]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode([np.array(ids, np.int32)]) == [pieces.library.decode(ids)]
    with pytest.raises(IndexError):
        pieces.decode([np.array([pieces.size])])


@pytest.mark.parametrize("text", [" " * 100_000, "a" * 300_000, "ab" * 50_000, "\n" * 50_000, "é" * 40_000])
def test_long_words(pieces, text):
    assert pieces.encode([text])[0].tolist() == pieces.library.encode(text)


def test_refuses_other_models(monkeypatch):
    from sentencepiece import sentencepiece_model_pb2 as proto

    monkeypatch.setattr(proto.TrainerSpec, "BPE", 99)
    with pytest.raises(ValueError):
        PieceModel(MODEL)


def test_rows_stay_as_they_are(spark, pieces):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2**60 + 1, "", "y"), (3, "word " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").repartition(2)
    out = decode(encode(df, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in out.collect())
    assert got == sorted((str(i), tuple(pieces.library.encode(t or "")), t or "") for i, t, _ in rows)
    assert decode(encode(df.limit(0), MODEL), MODEL).count() == 0
    lists = spark.createDataFrame([([5, 6, 7],), (None,), ([],), ([300],)], "ids array<int>")
    assert [r["decoded"] for r in decode(lists, MODEL).collect()] == [pieces.library.decode(i) for i in ([5, 6, 7], [], [], [300])]
    again = encode(df.withColumnRenamed("text", "body"), MODEL, column="body", out="tokens")
    assert "body" in again.columns and "IDS" in again.columns and again.count() == 5


def test_query_digests(spark):
    from sparkwave.llm.queries import op11_sentencepiece

    library, rows = PieceModel(MODEL).library, op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
