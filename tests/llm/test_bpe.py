from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import regex

from rungwise.llm import bpe

RANKS = public_tokenizers.path(bpe.RANKS)
TEXTS = [
    None,
    "",
    " ",
    "a",
    "It's we'll  two   spaces\n\n and\ttabs \r\n",
    "é漢字 🙂 <|endoftext|> \x00\x1c x\x1c y",
    " " * 3000 + "word",
    "word" + " " * 3000,
    "x" + "\n" * 700 + " " * 700 + "y  z",
    "　" * 600 + "\x1c" * 3 + " " * 600 + "q",
    ("many words, " * 9000) + "end",
    "a" * 70000 + " b" * 40000,
    "same row",
    "same row",
]


def by_pieces(text: str) -> list[int]:
    own = bpe.encoding(RANKS)
    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in own._encode_single_piece(m)]


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_long_and_odd_texts_equal_one_match_at_a_time(text):
    own = bpe.encoding(RANKS)
    ids = bpe.encode_text(text, own)
    assert ids == by_pieces(text)
    assert own.decode_bytes(ids) == text.encode()


def test_parts_are_the_text_again():
    for text in filter(None, TEXTS):
        assert "".join(p for p, _ in bpe.parts(text)) == text


def test_round_trip_with_nulls_ties_and_clashing_columns(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = by_pieces(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), RANKS).count() == 0


def test_encode_then_decode_returns_the_bytes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "ids int, text string")
    coded = bpe.encode(df.withColumnRenamed("ids", "k"), RANKS)
    assert coded.columns == ["k", "text", "ids"]
    for r in bpe.decode(coded, RANKS).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.decode(nothing, RANKS).first().decoded is None
