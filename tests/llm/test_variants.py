from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rungwise.llm import variants
from rungwise.llm.variants import Spelling


def brute(docs, factor=10):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    return grouped(words, factor)


def grouped(words, factor=10):
    close = defaultdict(set)
    shared = defaultdict(set)
    for w in words:
        shared[w].add(w)
        for i in range(len(w)):
            shared[w[:i] + w[i + 1 :]].add(w)
            shared[w[:i] + "*" + w[i + 1 :]].add(w)
    for key, group in shared.items():
        for a in group:
            for b in group:
                if a != b and ("*" in key or key in (a, b)):
                    close[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def typo(word, r, letters="aeßéÿ"):
    i, kind = r.randrange(len(word)), r.randrange(3)
    return word[:i] + ("" if kind == 0 else r.choice(letters)) + word[i + (kind < 2) :]


def corpus(seed, long=30000):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randrange(7, 14))) for _ in range(60)]
    base += ["Straßenbahn", "aaaaaaaa", "ÀÉÎÕÜßàÿ", "cat", "mississippi"]
    docs = []
    for i in range(250):
        picked = r.choices(base, [1 / (k + 1) for k in range(len(base))], k=60)
        docs.append((i, " ".join(typo(w, r) if r.random() < 0.2 else w for w in picked)))
    docs += [(None, docs[0][1]), (7, docs[7][1]), (7, docs[7][1]), (900, None), (901, ""), (902, "12 34 --")]
    return docs + [(903, " ".join("z" * (long + k) for k in (0, 0, 1, 1))), (904, "aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa")]


@pytest.mark.parametrize("seed, block, long", [(1, 4096, 30000), (2, 2, 40)])
def test_equal_to_brute_force(spark, seed, block, long):
    docs = corpus(seed, long)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(5)
    got = variants.group(df, Spelling(block_words=block))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(docs)
    assert sorted(map(tuple, got.collect())) == want
    assert any(form for _, form, *_ in want)


@pytest.mark.parametrize("seed", range(10))
def test_recurrence_against_plain_distance(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abÿ") for _ in range(r.choice([7, 8]))) for _ in range(300)})
    lengths = np.array(list(map(len, words)))
    letters = np.frombuffer(b"".join(w.encode("latin-1").ljust(9, b"\0") for w in words), np.uint8).reshape(-1, 9)
    i, j = variants.near_pairs(letters, lengths, 7)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))

    want = {(a, b) for a in range(len(words)) for b in range(len(words)) if len(words[a]) == 7 and a != b and one_edit(words[a], words[b])}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_chains_and_ties(spark):
    words = {"aaaaaaa": 1000, "aaaaaab": 50, "aaaaabb": 4, "zzzzzzz": 2, "zzzzzzy": 20, "zzzzzzx": 20, "lonelyword": 3}
    df = spark.createDataFrame([(i, " ".join(w for w in words for _ in range(words[w]))) for i in range(1)], "doc_id long, text string")
    got = {r.word: r for r in variants.group(df, Spelling(drop_every=0)).collect()}
    assert sorted(map(tuple, got.values())) == grouped(words)
    assert got["aaaaabb"].root == "aaaaaaa" and got["zzzzzzz"].form == "zzzzzzx" and got["lonelyword"].n_near == 0


def test_a_large_block_is_dealt_again(spark):
    """A stem with thousands of endings: no block above the limit but those the alphabet bounds."""
    rows = [(f"commonstem{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", 2 + i % 5) for i in range(3000)]
    words = spark.createDataFrame(rows, "word string, n long")
    options = Spelling(block_words=100)
    tables = variants.blocks(words, options)
    assert len(tables) > 1
    for table in tables[:-1]:
        assert table.groupBy("key", "short", "lo", "hi").count().agg({"count": "max"}).first()[0] <= 100
    got = {r.word: r.n_near for r in variants.near(words, options).collect()}
    want = {w: k for w, _, _, _, k, _ in grouped(dict(rows))}
    assert got == {w: k for w, k in want.items() if k}


def test_empty_table(spark):
    got = variants.group(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
