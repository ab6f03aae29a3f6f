from __future__ import annotations

import numpy as np
import pytest

from rungwise.llm import rpforest

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def corpus(seed=0, dense=60):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(300):
        base = r.normal(0, 1, 32)
        for _ in range(r.choice([1, 1, 1, 2, 4])):
            rows.append((base + r.normal(0, r.choice([0.02, 0.2, 0.3]), 32), int(k % 3)))
    heart = r.normal(0, 1, 32)
    rows += [(heart + r.normal(0, 0.1, 32), 1) for _ in range(dense)]
    rows += [(rows[0][0], rows[0][1]), (rows[0][0], rows[0][1] + 1), (rows[1][0] * 2, rows[1][1])]
    return [(i, [float(v) for v in x], label, "x") for i, (x, label) in enumerate(rows)]


def odd(at):
    one = [1.0] * 32
    return [
        (at, None, 1, "x"), (at + 1, [0.0] * 32, 1, "x"), (at + 2, [float("nan")] + one[1:], 1, "x"),
        (at + 3, [None] + one[1:], 1, "x"), (at + 4, [float("inf")] + one[1:], 1, "x"), (at + 5, one, None, "x"),
        (at + 6, one, None, "x"), (at + 7, [], 1, "x"), (at + 8, one[:5], 9, "x"), (at + 9, one, 9, "x"), (None, one, 9, "x"),
    ]


def brute(rows):
    x = np.array([v for _, v, *_ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    group = np.arange(len(rows))
    while True:
        new = np.minimum(group, np.where(near, group[None, :], len(rows)).min(1))
        if (new == group).all():
            return near, group
        group = new


@pytest.mark.parametrize("options", [rpforest.Forest(), rpforest.Forest(leaf=32, rounds=6), rpforest.Forest(leaf=24, rounds=1)])
def test_recall_precision_and_components(spark, options):
    rows = corpus()
    near, group = brute(rows)
    got = {r.vec_id: r for r in rpforest.linked(spark.createDataFrame(rows, SCHEMA), options).collect()}
    assert len(got) == len(rows)
    want = near.sum(1)
    links = np.array([got[i].n_links for i in range(len(rows))])
    assert (links <= want).all()
    assert links.sum() / want.sum() >= (0.97 if options.leaf == 512 else 0.9)
    right = np.mean([got[i].component_id == group[i] for i in range(len(rows))])
    assert right >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows_link_with_nothing(spark):
    rows = corpus(1, 5)
    more = odd(len(rows))
    got = rpforest.linked(spark.createDataFrame(rows + more, SCHEMA)).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        if r.vec_id is None or r.vec_id >= len(rows):
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert rpforest.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_vectors_that_cannot_be_split_are_compared_in_blocks(spark):
    """Two directions with many lengths: no projection tells equal directions apart."""
    rows = [(i, [0.0, float(1 + i % 40)] if i % 2 else [float(1 + i % 40), 0.0], 1, "x") for i in range(80)]
    got = rpforest.linked(spark.createDataFrame(rows, SCHEMA), rpforest.Forest(leaf=8, rounds=2)).collect()
    assert {r.n_links for r in got} == {39} and {r.component_id for r in got} == {0, 1}
