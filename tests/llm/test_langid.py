from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rungwise.llm import langid

PATH = public_tokenizers.path(langid.VOCABULARY)


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces(PATH)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    known = {model.id_to_piece(i) for i in range(3 + 256, model.get_piece_size())}
    r = np.random.default_rng(0)
    probability = r.random((vocabulary.n + 1, 2)) * 1e-2
    row = lambda piece: int(np.searchsorted(vocabulary.hashes, np.uint64(vocabulary._hash(piece))))

    def total(text):
        sums = [np.ones(2)]
        for end in range(1, len(text) + 1):
            here = np.zeros(2)
            for start in range(max(0, end - vocabulary.longest), end):
                piece = text[start:end]
                if piece in known:
                    here += sums[start] * probability[row(piece)]
                elif end == start + 1:
                    here += sums[start] * probability[-1]
            sums.append(here)
        return np.log(sums[-1])

    words = ["the", "straße", "a", "international", "漢字", "xqzt"]
    got = langid.word_scores(words, vocabulary, probability)
    assert got == pytest.approx(np.stack([total(langid.MARK + w) for w in words]))
    # A word of several stretches is their product.
    long = "abcdefgh" * 9
    assert langid.word_scores([long, "the"], vocabulary, probability)[0] == pytest.approx(sum(total(s) for s in langid.stretches(long)))


def test_expected_counts_add_up_to_the_pieces_of_segmentations():
    vocabulary = langid.pieces(PATH)
    share = np.full(vocabulary.n + 1, 1 / (vocabulary.n + 1))
    counts = langid.expected_counts(["▁a", "▁q"], np.array([2.0, 1.0]), vocabulary, share)
    assert 3 <= counts.sum() <= 6 and (counts >= 0).all()


def test_held_out_accuracy_and_odd_rows(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**9, None, "en"), (10**9 + 1, "12 !!", "en"), (10**9 + 2, "", None), (None, "the and of", None), (5, "z" * 40_000, None)]
    df = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("score", docs["doc_id"])
    got = langid.identify(df).collect()
    assert len(got) == docs.count() + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[10**9 + k].lang_pred for k in range(3)] == ["und"] * 3
    assert by_id[10**9].score == 0 and by_id[None].held_out
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and lang.get(r.doc_id)]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0


def test_every_language_keeps_rows_in_the_sample(spark):
    rows = [(i, f"text {i}", f"lang{i % 40}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df, langid.Training(rows_per_language=4, max_languages=2), "doc_id", "text", "lang")
    assert len(got) == 40 and len({a for a, _ in got}) == 40
