"""Piece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from pageloom.llm import piece_tokens, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return piece_tokens.PieceCodec(piece_tokens.load_model(PATH))


def hard_texts():
    long = "".join(random.Random(3).choice("the quick, é日🙂\n 12<>._") for _ in range(60_000))
    return ["", " ", "\n", "\n\n a", "a", " a", "  a  ", "<s>", "</s>", "<0x0A>", "▁", "▁▁a", "a\0b", "\r\n\t", "﻿x", "²..", "x" * 5000, "ab" * 3000, "=" * 3000, "日" * 999, "naïve café, Straße — 東京", long]


def test_encoding_of_hard_texts(codec, library):
    for text in hard_texts():
        assert codec.encode(text) == library.encode(text, add_eos=True), text[:40]
    assert codec.encode(None) == [library.eos_id()]


def test_encoding_of_runs_of_blanks_whose_pieces_tie(codec, library):
    for n in range(70):
        for before, after in (("", ""), ("a", "hello"), ("b\n", "é"), ("日", "\n"), (",", "🙂")):
            text = before + " " * n + after
            assert codec.encode(text) == library.encode(text, add_eos=True), text


def test_encoding_of_every_piece_and_of_strings_of_pieces(codec, library):
    rng, pieces = random.Random(1), list(codec.pieces)
    texts = [p.replace("▁", " ") for p in pieces]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 7))) for _ in range(8000)]
    texts += ["".join(chr(rng.choice((rng.randint(0, 127), rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x1FFFF)))) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    assert [codec.encode(t) for t in texts] == library.encode(texts, add_eos=True)


def test_merging_anew_equals_the_library(codec, library):
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("thein aos") for _ in range(rng.randint(1, 30)))
        assert [*codec.merge("▁" + text.replace(" ", "▁")), 2] == library.encode(text, add_eos=True)


def test_decoding_of_any_ids(codec, library):
    rng = random.Random(4)
    for _ in range(6000):
        ids = [rng.choice((rng.randint(0, 31_999), rng.randint(0, 300), rng.randint(3, 258), rng.randint(120, 258))) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_a_worker_forgets_units_and_pairs_without_harm(library, monkeypatch):
    monkeypatch.setattr(piece_tokens, "MOST_UNITS", 5)
    monkeypatch.setattr(piece_tokens, "MOST_PAIRS", 7)
    codec = piece_tokens.PieceCodec(piece_tokens.load_model(PATH))
    text = "the rain in Spain, the plain; the rain stays mainly in the plain of Spain " * 3
    assert codec.encode(text) == library.encode(text, add_eos=True)
    assert len(codec.units) <= 5 and len(codec.agree) <= 7


def test_rows_with_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", None), (3, "w" * 70_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "1 AS decoded", "named_struct('a', array(1)) AS extra")
    coded = piece_tokens.encode_texts(df, PATH)
    assert coded.columns == ["doc_id", "text", "decoded", "extra", "ids"]
    for r in coded.collect():
        assert r.ids == library.encode(r.text or "", add_eos=True)
    back = piece_tokens.decode_ids(coded, PATH)
    assert sorted(str(r.decoded) for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    both = piece_tokens.round_trip(df, PATH)
    assert both.columns == ["doc_id", "extra", "ids", "decoded"] and both.count() == 5
    empty = df.filter("doc_id = 99")
    assert piece_tokens.encode_texts(empty, PATH).count() == piece_tokens.round_trip(empty, PATH).count() == 0


def test_query_against_the_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op13_piece_encoding"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_eos=True)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        assert got[r.doc_id] == (len(ids), *digest)


def test_other_models_are_refused(monkeypatch):
    class Changed(sentencepiece.SentencePieceProcessor):
        def normalize(self, text, **kwargs):
            return text

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Changed)
    with pytest.raises(ValueError, match="normaliser"):
        piece_tokens.load_model(PATH)
