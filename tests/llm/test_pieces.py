"""Operator 12 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tokenloom.llm import pieces
from tokenloom.llm.queries import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
BITS = ["a", "th", "e", "in", "ing", " ", "  ", "\n", "▁", "é", "ß", "漢", "字", "😀", "\x00", "\t", "12", ".", "<s>", "</s>", "<0x0A>", "<unk>", "́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return pieces.Coder(pieces.read_model(f.read()))


def check(coder, library, text):
    want = library.encode(text)
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == want, text
    assert coder.decode(coder.encode(text)).decode() == library.decode(want), text


def test_runs_of_spaces(coder, library):
    for n in range(40):
        for text in (" " * n, " " * n + "a", "a" + " " * n + "b", "▁" * n + " x", "\n" * n + " " * n):
            check(coder, library, text)


def test_random_texts(coder, library):
    draw = random.Random(3)
    for _ in range(3000):
        check(coder, library, "".join(draw.choices(BITS, k=draw.randint(0, 30))))
        check(coder, library, "".join(library.id_to_piece(draw.randrange(259, 32000)) for _ in range(draw.randint(0, 10))))


def test_decoding_of_any_ids(coder, library):
    draw = random.Random(4)
    for _ in range(3000):
        ids = draw.choices([*range(3, 259), 300, 400, 28705, 1, 2], k=draw.randint(0, 12))
        assert coder.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids), ids


def test_long_text_and_small_caches(coder, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(pieces, "CACHE_CHARS", 8)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 50)
    draw = random.Random(5)
    check(coder, library, "".join(draw.choices("abcdefghij", k=50_000)))
    check(coder, library, "".join(draw.choices(BITS, k=20_000)))


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.read_model(b"\x12\x02\x18\x01")  # a unigram model without pieces


def test_documents(spark, library):
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [None, "", " ", "one", "one", *real]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece_ids string")
    got = pieces.piece_digests(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    coded = pieces.encode_pieces(docs, PATH)
    assert coded.columns == ["doc_id", "text", "piece_ids", "piece_text"]
    assert coded.where(F.coalesce("text", F.lit("")) != F.col("piece_text")).count() == 0
    assert pieces.encode_pieces(docs.limit(0), PATH, decode=False).columns == ["doc_id", "text", "piece_ids"]
    assert pieces.piece_digests(docs.limit(0), PATH).count() == 0
