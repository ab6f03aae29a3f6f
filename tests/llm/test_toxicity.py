from __future__ import annotations

import numpy as np
import pytest

from rungwise.llm import toxicity


def slow_segments(scores):
    """Maximal scoring segments by their recursive definition."""
    found = []

    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        if best:
            search(a, best[1])
            found.append((best[1], best[2], best[0]))
            search(best[2], b)

    search(0, len(scores))
    return found


def test_segments_against_the_definition():
    r = np.random.default_rng(4)
    for _ in range(80):
        scores = r.normal(-0.3, 1, r.integers(0, 25))
        got, want = toxicity.segments(scores), slow_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_decay_solves_its_equation():
    shares, values = np.array([0.9, 0.08, 0.02]), np.array([-0.5, 0.4, 3.0])
    rate = toxicity.decay(shares, values)
    assert (shares * np.exp(rate * values)).sum() == pytest.approx(1)
    assert toxicity.decay(np.array([1.0]), np.array([-1.0])) == 1


def table(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"plain words number w{i} and more of them " * 5 + ("vile insult vile " if bad else ""), i, "x"))
        labels.append((i, int(bad), 1))
    rows += [(1000, None, 0, "x"), (1001, "", 0, "x"), (1002, "vile insult vile", 0, "x"), (0, rows[0][1], 0, "x"), (None, "vile insult", 0, "x")]
    rows.append((1003, "plain words " * 60_000 + "vile insult vile", 0, "x"))
    labels += [(0, 1, 1), (5, None, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_passages_scores_and_odd_rows(spark):
    docs, labels = table(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        bad = r.doc_id in (1002, None) or (r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0)
        if r.doc_id != 1003:
            assert r.predicted == int(bad), r.doc_id
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    text = {r.doc_id: r.text for r in docs.collect()}
    one = next(r for r in got if r.doc_id == 1002)
    assert [text[1002][p.start : p.end] for p in one.passages] == ["vile insult vile"]
    assert all(p.log10_e <= -1 + 1e-9 for r in got for p in r.passages)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_without_labels_every_score_is_zero(spark):
    docs, labels = table(spark)
    assert {(r.score, r.predicted) for r in toxicity.score(docs, labels.limit(0)).collect()} == {(0.0, 0)}


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r.predicted == r.toxic for r in got])
    false_alarms = np.mean([r.predicted for r in got if r.toxic == 0])
    assert right > 0.9 and false_alarms < 0.03


def test_unseen_words_count_by_their_beginnings():
    known = toxicity.Model({"viles": 1.0, "vil+": 3.0, "vile+": 4.0, "pla+": -1.0})
    assert [known.of(w) for w in ("viles", "vileness", "vilst", "vil", "plain", "other")] == [1, 4, 3, 0, -1, 0]
    assert toxicity.beginnings("vile") == ["vil+"] and toxicity.beginnings("abcdefghij")[-1] == "abcdefg+"


def test_inflected_stems_are_found_in_words_never_learned(spark):
    r = np.random.default_rng(3)
    draw = lambda n: " ".join("".join(r.choice(list("abcdefghij"), 6)) for _ in range(n))
    ending = lambda: "".join(r.choice(list("abcdefghij"), 5))
    rows = [(i, draw(60) + (f" zzor{ending()} {draw(20)} zzor{ending()}" if i % 5 == 0 else draw(20)), int(i % 5 == 0)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs.drop("toxic"), docs.select("doc_id", "toxic")).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.95 and np.mean([r.predicted for r in got if not r.toxic]) < 0.03


def test_scores_of_held_out_documents_differ(spark):
    """Weak segments count too, so no large group ties at one score above that of no evidence."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    bad, good = got[got.toxic == 1].score, got[got.toxic == 0].score
    assert (bad >= 0.5).mean() > 0.93 and (good < 0.5).mean() > 0.97
    ranks = got.score.rank()[got.toxic == 1]
    auc = (ranks.sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    assert auc > 0.95
