from __future__ import annotations

import re
from collections import Counter

import pytest

from rungwise.llm import mix

SCHEMA = "doc_id long, text string, source string, size string, target int"


def corpus():
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 4}", "x", 1) for i in range(300)]
    rows += [(1000 + i, "hot word " * 5, "hot", "x", 1) for i in range(400)]
    rows += [(2000, None, "s1", "x", 1), (2001, "", "s2", "x", 1), (2002, "no source here", None, "x", 1)]
    rows += [(2003, "long " * 5000, "s3", "x", 1), (7, "w " * 8, "s3", "x", 1), (7, "w " * 8, "s3", "x", 1)]
    return rows + [(2004, "   ", "blank", "x", 1)]


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared(sizes):
    """Targets by plain repetition of the rule."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = 3 * sizes[s]
        left = sum(sizes.values()) - sum(fixed.values())


@pytest.mark.parametrize("block", [1, 16, 256])
def test_targets_are_met_and_no_document_exceeds_three_times(spark, block):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    options = mix.Mix(block_words=block, bucket_rows=64)
    got = [tuple(r) for r in mix.takes(df, options).collect()]
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += n_words(text)
    want = shared(dict(sizes))
    source_of = {r[0]: r[2] for r in rows}
    taken = Counter()
    for doc_id, size, source_size, target, took in got:
        source = source_of[doc_id]
        assert source_size == sizes[source] and target == pytest.approx(want[source])
        assert 0 <= took <= 3 * size
        taken[source] += took
    for source, target in want.items():
        assert taken[source] == int(target + 1e-9)
    assert sorted(got) == sorted(tuple(r) for r in mix.takes(df.repartition(3), options).collect())


def test_every_stretch_of_the_schedule_is_near_the_weights(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    options = mix.Mix(block_words=4, bucket_rows=100)
    sized = mix._sized(df, options, "doc_id", "text", "source")
    sources, _ = mix.plan(sized, options)
    share = {r.position: r.high - r.low for r in sources.collect()}
    slots = sorted(tuple(r) for r in mix.schedule(sources, options).select("slot", "position", "block").collect())
    assert len({(p, b) for _, p, b in slots}) == len(slots)
    for lo in range(0, 1500, 250):
        part = Counter(p for s, p, _ in slots if lo <= s < lo + 250)
        for position, w in share.items():
            assert abs(part[position] - 250 * w) <= 12


def test_mixed_corpus_repeats_whole_documents(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = mix.apply_mix(df, mix.Mix(block_words=16))
    assert out.columns == df.columns
    copies = Counter(r.doc_id for r in out.collect())
    assert max(copies.values()) <= 6 and 2000 not in copies and 2004 not in copies


def test_empty_and_wordless(spark):
    assert mix.takes(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, " ", None, "x", 1)], SCHEMA)
    assert [tuple(r) for r in mix.takes(blank).collect()] == [(1, 0, 0, 0.0, 0)]
    assert mix.apply_mix(blank).count() == 0
