from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from rungwise.llm import ranked
from rungwise.llm.ranked import Ranking

UP = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_all
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in words(text) if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, at, doc, -s) for at, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éclair", "naïve", "日本", "X9", "the"]
    weights = [1 / (i + 1) for i in range(405)]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 3, 20, 90])))) for i in range(n)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)]  # groups of copies
    docs += [(2000, None), (2001, ""), (2002, "--- ??"), (2003, "The the, THE w1!"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1])]
    docs += [(3000, "w399 " * 5000), (3001, "w398" * 3000)]
    items = [(i, ", ".join(r.choices(vocabulary, weights if i % 2 else None, k=r.choice([1, 4, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "absent words only"), (103, "w0 w0 w0 the"), (3, items[3][1]), (104, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("seed, options", [(1, Ranking()), (2, Ranking(k=3)), (3, Ranking(k=1, class_factor=2))])
def test_equal_to_scoring_every_document(spark, seed, options):
    docs, items = corpus(seed)
    left = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, term int").repartition(6)
    right = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = ranked.rank(left, right, options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, options.k)


def test_items_stop_making_accumulators_and_survivors_stay_exact(spark):
    docs = [(i, f"common {'rare' if i < 20 else 'other'} filler{i % 7}") for i in range(2000)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame([(1, "rare common")], "item_id long, text string")
    asked = ranked.item_terms(right, "item_id", "text")
    rows = ranked.forward(left, ranked.bitmap(asked.select("term")), "doc_id", "text")
    options = Ranking()
    found = ranked.bodies(rows, options)
    assert found.agg({"copies": "sum"}).first()[0] == 2000 and found.count() <= 14
    weights = ranked.weigh(asked.select("term"), found, options, 2000)
    assert {r.term: r["class"] for r in weights.collect()} == {"rare": 2, "common": 5}
    postings = ranked.postings_of(found, weights, options)
    sums = ranked.accumulate(ranked.plan_of(asked, weights), postings, [2, 5], 10)
    # Only classes of documents with the rare term have accumulators, though all hold the other.
    rare = found.where("array_contains(terms, 'rare')")
    assert {r.doc for r in sums.collect()} == {r.doc for r in rare.collect()}
    got = sorted(map(tuple, ranked.rank(left, right).collect()), key=str)
    assert got == brute(docs, [(1, "rare common")]) and {r[2] for r in got} == set(range(10))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for a, b in [(docs.where("false"), items), (docs, items.where("false")), (docs.where("false"), items.where("false"))]:
        got = ranked.rank(a, b)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.rank(docs, items).count() == 1
