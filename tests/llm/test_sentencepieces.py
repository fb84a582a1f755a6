"""SentencePiece encoding and decoding, exactly as the library does it."""

import hashlib
import random

import pytest

pytest.importorskip("inkwell.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from inkwell.llm import sentencepieces as S  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(S.MODEL))


@pytest.fixture(scope="module")
def model():
    return S.Model.load(S.MODEL)


def texts():
    r = random.Random(5)
    alphabets = ["ab ▁\n\tthe ié一𐀀\0<s>,.", "etaoinshr", " a", "".join(map(chr, range(0x4E00, 0x4E40))), "🙂🙃é​﻿ x"]
    out = ["", " ", "▁", "a", "  a  b ", "<s></s><unk><0x41>", "\n\n", "x" * 300, " " * 100, "\r\n \t", "𐀀" * 20]
    out += ["".join(r.choice(a) for _ in range(r.randint(1, 120))) for a in alphabets for _ in range(150)]
    return out


def test_ids_and_decoded_text(model, library):
    for t in texts():
        ids = library.encode(t)
        assert model.encode(t).tolist() == ids, t
        assert model.decode(ids) == library.decode(ids), t
    for t in ("word " * 300_000, "x" * 200_000, "ab" * 50_000 + "\n" + " " * 70_000 + "end"):
        assert model.encode(t).tolist() == library.encode(t)


def test_tokens_next_to_each_other(model, library):
    """Any two tokens side by side: kept apart or merged anew, as the library does."""
    r = random.Random(6)
    tokens = [t for t in model.token if not t.startswith("<")]
    for _ in range(4000):
        t = "".join(r.choice(tokens) for _ in range(r.randint(1, 6)))
        assert model.encode(t).tolist() == library.encode(t), t


def test_any_ids_are_decoded(model, library):
    r = random.Random(7)
    space = library.piece_to_id("▁")
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(259, 31999), space]) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_failed_places_are_left(model):
    """A vocabulary in which the longest match leads nowhere, so that tokens are taken back."""
    own = S.Model.__new__(S.Model)
    own.token = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc", "cb"])}
    own.score = {"bc": 5.0, "ab": 4.0, "cb": 3.0, "abc": 2.0}
    own.alone, own.byte, own.unknown, own.shown = {}, {}, 0, [b""] * 7
    own.text = {i: t for t, i in own.token.items()}
    own._index()
    r = random.Random(8)
    for _ in range(3000):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 25)))
        assert [own.text[i] for i in own.encode_word(word)] == own.merged(word), word


def test_small_stores_and_stretches(model, library, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 5)
    monkeypatch.setattr(S, "KEPT_WORDS", 3)
    monkeypatch.setattr(S, "KEPT_PAIRS", 10)
    for t in texts()[:300]:
        ids = library.encode(t)
        assert model.encode(t).tolist() == ids
        assert model.digests(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_tables(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(texts()[:200])] + [(7, "same", 1), (7, "same", 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = S.encode_documents(docs)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=key) == sorted(((i, library.encode(t or "")) for i, t, _ in rows), key=key)
    back = S.decode_documents(encoded)
    assert sorted((tuple(r) for r in back.collect()), key=key) == sorted(((i, library.decode(library.encode(t or ""))) for i, t, _ in rows), key=key)
    assert S.encoding_digests(docs.where("false")).collect() == [] and S.decode_documents(encoded.where("false")).collect() == []
