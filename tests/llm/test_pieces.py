"""SentencePiece encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import random
from itertools import chain

import pytest
import sentencepiece
from pyspark.sql import functions as F

from txrisk.llm import pieces, queries
from txrisk.llm.piece_model import BLANK, read_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_path(), "rb") as f:
        return read_model(f.read())


def texts(model, seed, count):
    rng = random.Random(seed)
    alphabets = ["ab aA  \n\t▁<s>éß", "aaaa  ▁ b", "🙂 éa\0x́中文 한국", "01239 .,;-_=+/%", "the of and ing er on "]
    written = [p.replace(BLANK, " ") for p in model.ids]
    out = ["", " ", "  ", "▁", "\n", "a", "</s>", "<0x41>", " " * 100, "aaaa" * 50, "�", "😀"]
    for _ in range(count):
        out.append("".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randint(0, 40))))
        out.append("".join(rng.choice(written) for _ in range(rng.randint(1, 8))))
    return out


def ids_of(encoder, text):
    return [*chain.from_iterable(encoder.segments(text)), encoder.model.end_id]


def test_ids_are_the_librarys(library, model):
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for text in texts(model, 1, 4000):
        ids = library.encode(text, add_eos=True)
        assert ids_of(encoder, text) == ids, repr(text)
        assert "".join(decoder.texts([ids])) == library.decode(ids), repr(text)


def test_any_ids_decode_as_in_the_library(library, model):
    rng, decoder = random.Random(2), pieces.Decoder(model)
    some = [0, 1, 2, model.ids[BLANK], model.ids["▁▁"]]
    for _ in range(8000):
        ids = [rng.choice([*some, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 9))]
        cut = rng.randint(0, len(ids))
        assert "".join(decoder.texts([ids[:cut], ids[cut:]])) == library.decode(ids), ids


def test_each_prefix_has_the_token_its_encoding_ends_with(library, model):
    encoder = pieces.Encoder(model)
    word = f"{BLANK}unbelievablyé中"
    last, _ = encoder.prefix_table(word)
    for k in range(2, len(word) - 1):
        assert last[k] == library.encode(word[1:k])[-1]


def test_segments_and_forgotten_words_change_nothing(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENT", 7)
    monkeypatch.setattr(pieces, "WORDS_KEPT", 3)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 5)
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for text in texts(model, 3, 300):
        ids = library.encode(text, add_eos=True)
        assert ids_of(encoder, text) == ids, repr(text)
        assert "".join(decoder.texts([*encoder.segments(text), [2]])) == library.decode(ids)


def test_a_very_long_word_and_text(library, model):
    rng = random.Random(4)
    encoder = pieces.Encoder(model)
    for text in ("".join(rng.choice("abcdeé中") for _ in range(200_000)), "word and\nword " * 60_000, " " * 5000):
        assert ids_of(encoder, text) == library.encode(text, add_eos=True)


def test_models_that_rewrite_texts_are_refused():
    piece = bytes([10, 3, 10, 1, 97])  # one piece, "a"
    with pytest.raises(ValueError, match="as it is"):
        read_model(piece + bytes([26, 3, 18, 1, 120]))  # with a table of replacements


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
    return len(ids), *sha


def test_op12(spark, sf_dir, library):
    """The query over its whole table."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, sf_dir).collect()}
    assert found == {r["doc_id"]: expected(library, r["text"]) for r in rows}


def test_rows_and_round_trip(spark, library):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (None, "x"), (3, ""), (4, "é" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(c) for c in ("value", "ids", "n_tokens", "ids_sha256")}
    )
    assert sorted(map(tuple, pieces.digests(df).collect()), key=str) == sorted(
        ((i, *expected(library, t)) for i, t in rows), key=str
    )
    encoded = pieces.encode(df)
    back = pieces.decode(encoded).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    none = df.limit(0)
    assert pieces.digests(none).collect() == pieces.encode(none).collect() == []
    no_ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decode(no_ids).collect()] == ["", ""]
