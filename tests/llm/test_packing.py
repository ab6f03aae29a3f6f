from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from rungwise.llm import bpe, packing
from rungwise.llm.packing import Packing

FILE = public_tokenizers.path(packing.VOCABULARY)
RANKS = public_tokenizers.path(bpe.RANKS)


def one_by_one(counts):
    """Best-two-fit bin by bin, by plain search."""
    left, size, bins = Counter({i: int(n) for i, n in enumerate(counts) if n and i}), len(counts) - 1, []
    while sum(left.values()):
        trial, content, gap = Counter(left), [], size
        while fits := [l for l in trial if trial[l] and l <= gap]:
            content.append(max(fits))
            trial[max(fits)] -= 1
            gap -= max(fits)
        small = min(content)
        pairs = [
            (a + b, a, b) for a in trial for b in trial
            if trial[a] and trial[b] and a >= b and (a != b or trial[a] > 1) and small < a + b <= gap + small
        ] if gap else []
        if pairs:
            content.remove(small)
            content += max(pairs)[1:]
        left.subtract(content)
        bins.append(tuple(sorted(content, reverse=True)))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_the_bins_of_plain_best_two_fit(seed):
    r = random.Random(seed)
    size = r.choice([10, 37, 100])
    counts = np.zeros(size + 1, np.int64)
    for _ in range(r.randrange(1, 25)):
        counts[r.randrange(1, size + 1)] += r.choice([1, 2, 3, 50, 400])
    got = []
    for run in packing.plan(counts):
        got += [tuple(l for l, n in run.parts for _ in range(n))] * run.times
    assert Counter(got) == Counter(one_by_one(counts))


def test_two_pieces_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.plan(counts)[0].parts == ((6, 1), (2, 2))


def test_few_runs_and_tight_bins_for_many_pieces():
    r = np.random.default_rng(0)
    counts = np.bincount(np.clip(r.lognormal(5.5, 1, 3_000_000), 1, 1024).astype(int), minlength=1025)
    runs = packing.plan(counts)
    assert len(runs) < 5000
    bins, total = sum(x.times for x in runs), int((counts * np.arange(1025)).sum())
    assert bins <= -(-total // 1024) * 1.001


def texts():
    r = random.Random(3)
    made = [" ".join(r.choice(["alpha", "beta", "straße", "naïve", "x1"]) for _ in range(r.choice([1, 5, 40, 400]))) for _ in range(150)]
    return [None, "", "word " * 3000, "日本語テキスト" * 500, "  \n\n \t" * 50, "<|endoftext|>", *made, *made[:20]]


def check(rows, docs, size):
    """Every piece right, documents whole, sequences full and gapless."""
    own = packing.library(FILE)
    found = defaultdict(list)
    for row in rows:
        found[row.doc_id].append(row)
    copies = Counter(i for i, _ in docs)
    for doc_id, text in docs:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        got = sorted(found[doc_id], key=lambda x: x.piece)
        n = len({x.piece for x in got})
        assert len(got) == n * copies[doc_id] and [x.piece for x in got[:: copies[doc_id]]] == list(range(n))
        at = 0
        for x in got[:: copies[doc_id]]:
            assert x.start == at and x.length == (size if x.piece else len(ids) % size or size)
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(ids)
    bins = defaultdict(list)
    for row in rows:
        bins[row.sequence_id].append((row.offset, row.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(bins) == list(range(len(bins)))
    return len(bins), Counter(l for b in bins.values() for _, l in b)


@pytest.mark.parametrize("size", [16, 1024])
def test_pieces_and_sequences(spark, size):
    docs = list(enumerate(texts())) + [(900, "twice here"), (900, "twice here"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, piece string, part int").repartition(5)
    rows = packing.pack(df, FILE, RANKS, Packing(size=size)).collect()
    bins, lengths = check(rows, docs, size)
    counts = np.zeros(size + 1, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    assert bins == len(one_by_one(counts))


def test_given_table(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    bins, lengths = check(packing.pack(df, FILE, RANKS).collect(), docs, 1024)
    total = sum(l * n for l, n in lengths.items())
    assert bins <= -(-total // 1024) + 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    got = packing.pack(df, FILE, RANKS)
    assert got.count() == 0 and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_both_libraries_agree_on_plain_characters():
    own, fast = packing.library(FILE), bpe.encoding(RANKS)
    for code in range(0x110000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or not packing.PLAIN.fullmatch(char):
            continue
        for text in (char, f"a{char}b", f"1{char} {char}{char}!", f" {char}\n {char}"):
            assert own.encode(text, add_special_tokens=False).ids == fast.encode_ordinary(text), hex(code)
    r = random.Random(5)
    chars = [chr(c) for c in range(0x2100) if packing.PLAIN.fullmatch(chr(c))]
    for _ in range(500):
        text = "".join(r.choice(chars if r.random() < 0.3 else " ab1'st\n") for _ in range(r.randrange(200)))
        assert own.encode(text, add_special_tokens=False).ids == fast.encode_ordinary(text)
