from __future__ import annotations

import random

import public_tokenizers

from rungwise.llm import bpe, editcount

RANKS = public_tokenizers.path(bpe.RANKS)
WORDS = ["alpha", " beta", "'s", "  ", "\n", "12", "é漢", "!?", " it's", "\t", "x" * 300, " " * 600, "\x1c"]


def test_counts_equal_whole_encoding_after_random_edits():
    own, r = bpe.encoding(RANKS), random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(WORDS) for _ in range(r.randint(0, 300)))
        doc = editcount.Document(text, own)
        assert doc.tokens() == len(bpe.encode_text(text, own))
        for _ in range(8):
            a = r.randint(-3, len(text) + 5)
            b = a + r.choice([0, 0, 1, 5, 40, 700])
            new = "".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 3, 80])))
            doc.edit(a, b, new)
            low = min(max(a, 0), len(text))
            text = text[:low] + new + text[min(max(b, low), len(text)) :]
            assert doc.text == text
            assert doc.tokens() == len(bpe.encode_text(text, own))
            assert sum(doc.tree.leaf_chars()) == len(text)


def test_only_the_touched_region_is_encoded_again():
    own = bpe.encoding(RANKS)
    text = "some plain words in a row, " * 4000
    whole = editcount.Document(text, own)
    doc = editcount.Document(text, own, whole.tree.leaf_chars(), whole.tree.leaf_tokens())
    assert doc.encoded == 0
    doc.edit(50_000, 50_003, "other")
    assert 0 < doc.encoded < 2_000
    assert doc.tokens() == len(own.encode_ordinary(doc.text))


def test_table_with_nulls_ties_and_clashing_columns(spark):
    rows = [
        (1, "one two three", [(4, 7, "2")], 5),
        (1, "one two three", [(4, 7, "2")], 5),
        (2, None, [(0, 0, "new text")], 5),
        (3, "", None, 5),
        (4, "keep", [(None, 3, "x"), None, (0, 2, None)], 5),
        (None, "w " * 5000, [(10**6, 10**6 + 5, " end"), (0, 1, "W")], 5),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {editcount.EDITS}, n_tokens int")
    out = editcount.apply(editcount.build(df, RANKS), "edits", RANKS)
    own = bpe.encoding(RANKS)
    texts = sorted((r.doc_id or 0, r.text, r.n_tokens, r.n_tokens_before) for r in out.collect())
    assert [t[1] for t in texts if t[0] in (1, 2, 3, 4)] == ["one 2 three", "one 2 three", "new text", "", "ep"]
    for _, text, n, before in texts:
        assert n == len(own.encode_ordinary(text))
        assert before >= 0
    assert texts[0][1] == "W " + "w " * 4999 + " end"
    again = out.withColumn("edits", editcount.derived_edits())
    for r in editcount.apply(again, "edits", RANKS).collect():
        assert r.n_tokens == len(own.encode_ordinary(r.text))
    assert editcount.build(df.limit(0), RANKS).count() == 0
