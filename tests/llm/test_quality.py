from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from rungwise.llm import quality

TEXTS = [
    "", "   \n ", "one", "a b c a b c", "x x x x x", "l1\nl1\n \n\nl1\nl2", "é # % *** <|>   \x1c y\x85z",
    "the same line\n" * 60, "漢字 " * 80, "# " * 300,
]


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts_against_brute_force(text):
    assert quality.base_counts(text, text.encode().split(), quality.class_counts(text)) == slow(text)


def test_distance_is_a_bounded_symmetric_one():
    p, q = np.array([[0.5, 0.5, 0]]), np.array([0, 0, 1.0])
    assert quality.js_distance(p, q)[0] == pytest.approx(1)
    assert quality.js_distance(p, p[0])[0] == 0
    assert quality.js_distance(p, np.array([0.2, 0.3, 0.5]))[0] == pytest.approx(quality.js_distance(np.array([[0.2, 0.3, 0.5]]), p[0])[0])


def test_table_with_odd_rows(spark):
    good = " ".join(f"{w} word{i}" for i, w in enumerate(["the", "of", "and", "to"] * 60))
    rows = [(i, t, "en", 1) for i, t in enumerate(TEXTS)] + [(100 + i, good, "en", 1) for i in range(40)]
    rows += [(200, None, None, 1), (201, "### $$$ " * 200 + good[:50], "xx", 1), (100, good, "en", 1), (None, good, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = quality.assess(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(TEXTS):
        r, want = by_id[i], slow(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert by_id[100].kept and by_id[None].kept
    assert by_id[200].n_words == 0 and by_id[200].base_failed
    assert quality.assess(df.limit(0)).count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.assess(docs).where("not base_failed").join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_junk_goes_in_every_band_of_lengths(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.assess(docs).where("not base_failed").join(labels, "doc_id").collect()
    for low, high in ((50, 100), (100, 10**9)):
        band = [r for r in got if low <= r.n_words < high]
        good, bad = ([r.kept for r in band if r.quality == q] for q in (1, 0))
        assert good and np.mean(good) > 0.98 and bad and np.mean(bad) < 0.2
        assert not [r.doc_id for r in band if r.kept and (r.word_distance is None or r.word_distance > 0.55)]


@pytest.mark.parametrize("rows", [quality.Rules().collected_rows, 0])
def test_every_language_has_a_reference(spark, rows):
    """Clean texts of more languages than a task holds unpacked, each with words of its own."""
    text = lambda k: " ".join(f"l{k}w{i % 30}" if i % 3 else f"l{k}x{i}" for i in range(120))
    docs = [(k, text(k), f"lang{k:04}") for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.assess(df, quality.Rules(collected_rows=rows)).collect()}
    assert [k for k in range(600) if not got[k].kept] == []
    assert max(got[k].word_distance for k in range(600)) < 0.3


def test_one_row_of_a_new_language_vouches_for_nothing(spark):
    """Junk kept does not rise by a row with a tag of its own, nor is that row kept for its tag."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("bcdfghjk"), 8)) for _ in range(250)]
    strange = spark.createDataFrame([(-1, " ".join(words), "zz")], "doc_id long, text string, lang string")
    columns = ["doc_id", "text", "lang"]
    before = quality.assess(docs.select(columns))
    after = quality.assess(docs.select(columns).unionByName(strange)).toPandas().set_index("doc_id")
    assert not after.kept[-1]
    junk = [x.doc_id for x in labels.where("quality = 0").collect()]
    kept = lambda t: t[t.index.isin(junk)].kept.sum()
    assert kept(after) <= kept(before.toPandas().set_index("doc_id")) + 1


def test_texts_without_any_common_word_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = np.random.default_rng(9)
    rows = [(-1 - i, " ".join("".join(r.choice(list("etaoinshrd"), 8)) for _ in range(n)), "en") for i, n in enumerate((60, 200, 2000))]
    got = quality.assess(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert [x.kept for x in got.where("doc_id < 0").collect()] == [False] * 3


def test_languages_of_few_words_are_pooled(spark):
    rows = [("en", "word", f"w{i}", 1000) for i in range(100)] + [(f"x{i}", "word", f"r{i % 7}", 3) for i in range(50)]
    rows += [("en", "class", "vowel", 10), ("x1", "class", "digit", 4)]
    counts = spark.createDataFrame(rows, "lang string, kind string, key string, n long")
    got = quality.voting(counts, quality.Rules())
    assert {(r.lang, r.kind): r.n for r in got.groupBy("lang", "kind").agg({"n": "sum"}).toDF("lang", "kind", "n").collect()} == {
        ("en", "word"): 100_000, ("en", "class"): 10, (quality.POOLED, "word"): 150, (quality.POOLED, "class"): 4,
    }
    assert {r.lang for r in quality.voting(counts.where("lang in ('en', 'x1')"), quality.Rules()).collect()} == {"en"}
