from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from rungwise.llm import parity

JOIN = parity.Join()


def slow_set(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(rows):
    sets = [slow_set(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i]]
        out.append((doc_id, len(sets[i]), min(x for x in ids if x is not None) if any(x is not None for x in ids) else None))
    return sorted(out, key=str)


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(r.choice(words) for _ in range(60))
    rows, n = [], 0
    for size in (3, 5, 6, 9, 14, 20, 45, 60, 90, 150, 255, 262, 400, 1030):
        for _ in range(3):
            base = [r.choice(words) for _ in range(size)]
            for copy in range(r.choice([1, 2, 5])):
                text = list(base)
                for _ in range(r.choice([0, 0, 1, 2, max(1, size // 40), max(1, size // 25)])):
                    k = r.randrange(len(text))
                    text[k : k + r.choice([0, 1])] = [r.choice(words)]
                head = common + " " if r.random() < 0.3 else ""
                rows.append((n, head + " ".join(text).upper() if copy % 2 else head + " ".join(text), n))
                n += 1
    # A chain: each links to the next, the ends do not.
    chain = [f"c{i}" for i in range(200)]
    for k in range(6):
        rows.append((n, " ".join(chain[k * 10 : k * 10 + 120]), n))
        n += 1
    rows += [(n, None, 0), (n + 1, "", 0), (n + 2, " \n\t ", 0), (n + 3, "a b", 0), (n + 4, "A  b", 0), (n + 5, "a b c", 0)]
    rows += [(rows[0][0] + n + 10, rows[0][1], 0), (None, rows[5][1], 0), (None, "stands alone here without any id", 0)]
    return rows


@pytest.mark.parametrize("join", [JOIN, parity.Join(stars=0, nearest=0, block=3), parity.Join(stars=0, nearest=1, block=3)])
def test_components_against_brute_force(spark, join):
    """With and without the star rounds, in one or in many blocks, the result is the same."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted((tuple(r) for r in parity.classes(df, join).collect()), key=str)
    assert got == slow_components(rows)


def test_near_copies_without_an_id(spark):
    """Sets that only rows with a null id hold link, and connect others."""
    rows = corpus(3)
    chain = [f"x{i}" for i in range(200)]
    rows += [(d, " ".join(chain[k * 10 : k * 10 + 120]), 0) for k, d in enumerate((5000, None, 5001))]
    rows += [(None, rows[4][1] + " more", 0), (None, "only without any id " * 3 + "a", 0), (None, rows[-1][1], 0)]
    rows += [(None, " ".join(f"y{i}" for i in range(60 + k)), 0) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted((tuple(r) for r in parity.classes(df).collect()), key=str)
    assert got == slow_components(rows)
    assert (5001, 116, 5000) in got and (None, 116, 5000) in got


def test_one_of_each_component_stays(spark):
    rows = corpus(2)
    rows.append((rows[3][0], rows[3][1], 99))
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = parity.keep_one(df)
    assert kept.columns == df.columns
    want = {d for d, _, c in slow_components(rows) if d == c and d is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == want
    assert len([i for i in ids if i is not None]) == len(want) and ids.count(None) == 2


def test_rows_of_one_id_are_decided_one_by_one(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(80))
    rows = [
        (5, None, 1), (5, None, 2), (6, "", 3), (6, text("f"), 4),  # no words: documents of their own
        (7, text("a"), 5), (7, text("b"), 6),  # two unlinked texts
        (8, text("c"), 7), (9, text("c") + " more", 8), (9, text("d"), 9),  # one goes, the other stays
        (10, text("e"), 10), (10, text("e") + " more", 11), (11, text("e"), 12), (11, None, 13),
        (12, text("a"), 14), (12, text("a"), 15), (None, text("b"), 16),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, set int")
    kept = parity.keep_one(df)
    assert kept.columns == df.columns
    gone = {8, 11, 12, 14, 15}
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[2]) == [r for r in rows if r[2] not in gone]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert parity.classes(df).count() == 0 and parity.keep_one(df).count() == 0


def test_hamming_distance_is_a_lower_bound():
    r = np.random.default_rng(0)
    for n in (1, 10, 200, 3000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, n - n // 5)], r.integers(0, 2**63, n // 3 + 1).astype(np.uint64)]))
        difference = len(np.setxor1d(a, b))
        assert parity.hamming(parity.parity_sketch(a), parity.parity_sketch(b)) <= difference
        for band in {parity.band_of(n), parity.band_of(JOIN.smallest(n))}:
            x, y = parity.part_values(a, band), parity.part_values(b, band)
            assert len(x) - len(np.intersect1d(x, y)) <= difference


def test_bands_of_linked_sizes_meet_and_hold_enough_parts():
    r = np.random.default_rng(0)
    for a in [*range(1, 300), 1000, 1023, 1024, 5000, 20_000]:
        b = JOIN.largest(a)
        assert parity.band_of(a) in {parity.band_of(b), parity.band_of(JOIN.smallest(b))}
        if a in (16, 32, 63, 64, 127, 128, 255, 256, 1023, 5000):
            for n, total in ((a, a + b), (b, 2 * b)):
                values = parity.part_values(np.unique(r.integers(0, 2**63, n).astype(np.uint64)), parity.band_of(a))
                assert len(values) > JOIN.difference(total)


def test_open_values_name_their_holders_and_a_hub(spark):
    """Values inside one component go; of the others every holder sees their number and the same hub."""
    r = random.Random(6)
    where = sorted({(r.randrange(30), s) for s in range(40) for _ in range(4)})
    part = {s: s % 3 if s < 30 else s for s in range(40)}
    met = spark.createDataFrame([(v, s, 100 + s) for v, s in where], "value long, set long, n long")
    parts = spark.createDataFrame(sorted(part.items()), "set long, component_id long")
    got = parity.still_open(met, parts, 1).collect()
    holders = {v: [s for w, s in where if w == v] for v, _ in where}
    want = {(v, s) for v, s in where if len({part[x] for x in holders[v]}) > 1}
    assert {(x.value, x.set) for x in got} == want and len(got) == len(want)
    for x in got:
        assert x.k == len(holders[x.value]) and x.hub.a in holders[x.value]
        assert (x.hub.na, x.hub.ca, x.component_id, x.n) == (100 + x.hub.a, part[x.hub.a], part[x.set], 100 + x.set)
    assert all(len({x.hub.a for x in got if x.value == v}) == 1 for v in {x.value for x in got})


def test_values_move_packed_and_are_counted_whole(spark):
    """Every value with several holders comes back with all of them; a value moves in about eight bytes."""
    r = np.random.default_rng(4)
    held = {row: np.unique(r.integers(0, 2**50, 400).astype(np.uint64) % np.uint64(40_000) * np.uint64(1 << 30)) for row in [*range(40), *range(1 << 36, (1 << 36) + 40), 5 + (1 << 16)]}
    rows = [(row, len(v), [(0, 1, v[:100].view(np.int64).tolist()), (1, 1, v[100:].view(np.int64).tolist())]) for row, v in held.items()]
    sets = spark.createDataFrame([*rows, (7000, 0, [])], "row long, n long, bands array<struct<band:int,need:int,values:array<long>>>")
    by_value = {}
    for row, values in held.items():
        for v in values.tolist():
            by_value.setdefault(v & (1 << 48) - 1, []).append(row)
    want = sorted((v, row, len(k)) for v, k in by_value.items() if len(k) > 1 for row in k)
    assert sorted(map(tuple, parity.shared_values(sets).collect())) == want and want

    values = np.concatenate(list(held.values())[:40])
    near = np.repeat(np.arange(40), [len(v) for v in list(held.values())[:40]])
    moved = parity.packed(near, values, 16)
    assert sum(len(x.as_py()) for c in ("rows", "bytes") for x in moved.column(c)) == 8 * len(values)
    back = [parity.unpacked(*(moved.column(c)[i].as_py() for c in ("base", "rows", "bytes"))) for i in range(moved.num_rows)]
    both = lambda x, y: sorted(zip(x.tolist(), (y & np.uint64((1 << 48) - 1)).tolist()))
    assert both(*(np.concatenate(x) for x in zip(*back))) == both(near, values)


def test_values_that_named_all_pairs_do_not_meet_again(spark):
    """Of narrow values and small blocks all pairs are named at once; only a wide one of near copies is not whole."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 120).astype(np.uint64)
    copies = [np.unique(np.append(base, r.integers(0, 2**63, 1).astype(np.uint64))) for _ in range(60)]
    others = [np.unique(r.integers(0, 2**63, 121).astype(np.uint64)) for _ in range(60)]
    sketches = [parity.parity_sketch(x) for x in [*copies, *others]]
    sets = spark.createDataFrame([(i, bytearray(s.tobytes()), bytearray(parity.folded(s, 4).tobytes())) for i, s in enumerate(sketches)], "set long, sketch binary, brief binary")
    where = [(1, i) for i in range(60)] + [(2, i) for i in range(60, 120)] + [(3, i) for i in (0, 1, 70)]
    k = {1: 60, 2: 60, 3: 3}
    open_ = spark.createDataFrame([(v, i, 121, i, k[v], 0) for v, i in where], "value long, set long, n long, component_id long, k long, hub int")
    got = parity.crossing(open_, sets, JOIN, nearest=False).collect()
    assert {(x.a, x.b) for x in got} >= set(itertools.combinations(range(60), 2)) and all(x.whole for x in got)
    assert {(0, 1), (0, 70), (1, 70)} <= {(x.a, x.b) for x in got}
    got = parity.crossing(open_, sets, JOIN, nearest=True).collect()
    assert {x.value for x in got if not x.whole} == {1}
    assert not {x.value for x in got if x.whole} & {1}


def test_shingles_of_many_texts_are_those_of_each(monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "B", "cc"]) for _ in range(r.randrange(12))) for _ in range(200)] + [None, "", " \n", "x " * 3000]
    alone = [next(parity.shingle_sets([t], 5, parity.Words())) for t in texts]
    assert [len(x) for x in alone] == [len(slow_set(t)) for t in texts]
    monkeypatch.setattr(parity, "STRETCH_BYTES", 500)
    for x, y in zip(alone, parity.shingle_sets(texts, 5, parity.Words()), strict=True):
        assert (x == y).all()


def test_values_of_the_same_classes_meet_as_one_group(spark):
    """Near copies that share many values move once and not per value; unlike values stay apart."""
    where = [(64 * v, s) for v in range(1, 31) for s in range(100) if (s + v) % 10]
    where += [(64 * v, s) for v in (50, 51) for s in [(-1, 1000)[v == 50], *range(100 * v, 100 * v + 40)]]
    # One class, that of the smallest hash, holds two values that share nothing else.
    hashed = spark.range(10_000, 90_000).selectExpr("id", "xxhash64(id) h").orderBy("h").first().id
    where += [(64 * v, s) for v in (60, 61) for s in [hashed, *range(200_000 + 100 * v, 200_000 + 100 * v + 40)]]
    k = {v: sum(w == v for w, _ in where) for v, _ in where}
    open_ = spark.createDataFrame([(v, s, 50, s, k[v], 0) for v, s in where], "value long, set long, n long, component_id long, k long, hub int")
    got = [(x.value, x.set, x.k) for x in parity.gathered(open_, JOIN).collect()]
    assert len({x[:2] for x in got}) == len(got)
    assert {v for v, s, _ in got if s == hashed} == {64 * 60, 64 * 61}
    copies = [x for x in got if x[1] < 100 and x[0] < 64 * 50]
    assert len(copies) < 600 < sum(v < 64 * 50 for v, _ in where)
    meets = lambda rows: {(a, b) for v in {x[0] for x in rows} for a, b in itertools.combinations(sorted(x[1] for x in rows if x[0] == v), 2)}
    assert meets(got) >= meets(where)
    assert all(n == sum(x[0] == v for x in got) for v, _, n in got)


def test_a_row_of_a_frequent_value_moves_a_bounded_number_of_times(spark):
    """Ten times the holders are ten times the rows dealt, not a hundred times, and all pairs are compared."""
    join = parity.Join(few=2, block=8, blocks=4)
    held = lambda k: spark.range(k).selectExpr("7L value", "id set", f"{k}L k")
    assert [parity.tiled(held(k), join).count() for k in (8, 80, 800)] == [8, 320, 3200]
    r = np.random.default_rng(7)
    base = r.integers(0, 2**63, 120).astype(np.uint64)
    sketches = [parity.parity_sketch(np.append(base, x)) for x in r.integers(0, 2**63, 80).astype(np.uint64)]
    sets = spark.createDataFrame([(i, bytearray(s.tobytes()), bytearray(parity.folded(s, 4).tobytes())) for i, s in enumerate(sketches)], "set long, sketch binary, brief binary")
    open_ = spark.createDataFrame([(64, i, 121, i, 80) for i in range(80)], "value long, set long, n long, component_id long, k long")
    got = [(x.a, x.b) for x in parity.crossing(open_, sets, join).collect()]
    assert sorted(got) == list(itertools.combinations(range(80), 2))


def test_pairs_are_looked_at_in_stretches(monkeypatch):
    r = np.random.default_rng(9)
    part = r.integers(0, 30, 50)
    n = r.integers(40, 60, 50)
    brief = [x.tobytes() for x in r.integers(0, 2**6, (50, 4)).astype(np.uint64)]
    group = parity.pa.table({"n": n, "component_id": part, "block": part % 2, "i": np.zeros(50, int), "j": np.ones(50, int), "brief": brief})
    named = lambda nearest: [(a, b, whole) for x, y, whole in parity.near_pairs(group, JOIN, nearest) for a, b in zip(x.tolist(), y.tolist())]
    at_once = named(False)
    assert at_once and all(w for *_, w in at_once)
    assert all(not w for *_, w in named(True))
    monkeypatch.setattr(parity, "STRETCH_PAIRS", 200)
    assert sorted(named(False)) == sorted(at_once)
    few = named(True)
    assert {w for *_, w in few} == {True, False} and {x[:2] for x in few} < {x[:2] for x in at_once}


def test_classes_before_any_link_are_their_own_components(spark):
    """The first round needs no table of components; it is as if each class were one."""
    r = random.Random(11)
    where = sorted({(r.randrange(60), s) for s in range(40) for _ in range(3)})
    met = spark.createDataFrame([(v, s, 100 + s) for v, s in where], "value long, set long, n long")
    own = spark.createDataFrame([(s, s) for s in range(40)], "set long, component_id long")
    rows = lambda df: sorted((x.value, x.set, x.n, x.component_id, x.k, x.hub.a, x.hub.na, x.hub.ca) for x in df.collect())
    got = rows(parity.still_open(met, None, 2))
    assert got and got == rows(parity.still_open(met, own, 2))
