"""Near-duplicate embeddings by a forest of random-projection trees (operator 5).

Equal vectors of a label are one class. Every class goes down ``trees`` trees per label: a node
projects its vectors on a random direction and splits at the median, and vectors in the middle
``2 * spill`` share go to both sides. Vectors of one leaf are compared with each other by cosine in
double precision; pairs at or above the threshold link.

Thresholds of up to ``LEVELS`` levels below a node are fitted at once, on a hashed sample of its
vectors, by one small task per node; then all its vectors are routed in a map. Rounds repeat while a
leaf holds more than ``leaf`` vectors, so leaves are bounded. A leaf that cannot be split further
(ties) is compared in pairs of bounded blocks, which together are all of it.

A pair that meets in several leaves is counted in the smallest of them only, which both rows can
tell, as each carries the list of its leaves. So a leaf returns a count per vector and the edges of
a spanning forest, never its pairs, and large groups of near copies stay linear.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a
null label or a null id, link with nothing (0 links, their own id, kept); vectors of unequal length
never link; repeated rows are vectors of their own, linked as equal vectors; an empty table gives
no rows; extra columns are ignored. Whatever is linked is at or above the threshold; what the forest
misses is measured in the tests (recall at least 0.9, in practice close to 1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import components, map_arrow, stored

LEVELS = 6


@dataclass(frozen=True)
class Forest:
    threshold: float = 0.93
    trees: int = 16
    spill: float = 0.06
    leaf: int = 512
    sample: int = 4096
    rounds: int = 8
    seed: int = 5


def prepared(df: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(id, label, body): ``body`` the raw numbers of a vector that can link, else null."""
    element = df.schema[vector].dataType.elementType.simpleString()
    number = np.float32 if element == "float" else np.float64
    picked = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(F.col(label).cast("string")).alias("label"),
        F.col(label).isNotNull().alias("labelled"),
        F.col(vector).cast("array<float>" if number is np.float32 else "array<double>").alias("vector"),
    )

    def kernel(batches):
        for batch in batches:
            bodies = []
            ids, labelled = batch.column("id").to_pylist(), batch.column("labelled").to_pylist()
            for i, known, v in zip(ids, labelled, batch.column("vector").to_pylist(), strict=True):
                if i is None or not known or not v or any(c is None for c in v):
                    bodies.append(None)
                    continue
                x = np.array(v, np.float64)
                good = np.isfinite(x).all() and x.any() and np.isfinite(np.linalg.norm(x))
                bodies.append((x.astype(number) + number(0)).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(bodies, pa.binary())], names=["id", "label", "body"])

    return map_arrow(picked, kernel, "id long, label long, body binary"), number


def directions(leaf: int, dim: int, seed: int) -> np.ndarray:
    """The random directions of the nodes below ``leaf``, in heap order (row 0 unused)."""
    return np.random.default_rng([leaf & 0xFFFFFFFFFFFFFFFF, seed]).standard_normal((1 << LEVELS, dim))


def unit(bodies, number) -> np.ndarray:
    x = np.frombuffer(b"".join(bodies), number).reshape(len(bodies), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cuts(x: np.ndarray, levels: int, axes: np.ndarray, spill: float) -> np.ndarray:
    """(low, high) of each node in heap order; nan where a node is not split."""
    out = np.full((1 << LEVELS, 2), np.nan)
    held = {1: x}
    for node in range(1, 1 << levels):
        rows = held.pop(node, None)
        if rows is None or len(rows) < 8:
            continue
        place = rows @ axes[node]
        low, high = np.quantile(place, [0.5 - spill, 0.5 + spill])
        if not (place <= high).any() or not (place > high).any():
            continue
        out[node] = low, high
        held[2 * node], held[2 * node + 1] = rows[place <= high], rows[place >= low]
    return out


def routed(x: np.ndarray, axes: np.ndarray, cut: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(node, rows) of the nodes in which rows end; rows in a spill band end in several."""
    out, open_ = [], [(1, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        if not len(rows):
            continue
        if node >= 1 << LEVELS or np.isnan(cut[node, 0]):
            out.append((node, rows))
            continue
        place = x[rows] @ axes[node]
        open_.append((2 * node, rows[place <= cut[node, 1]]))
        # Where low and high are one value, rows on it go left only.
        right = place >= cut[node, 0] if cut[node, 0] < cut[node, 1] else place > cut[node, 1]
        open_.append((2 * node + 1, rows[right]))
    return out


def split(rows: DataFrame, big: DataFrame, options: Forest, number, turn: int) -> DataFrame:
    """The rows of the big leaves one round further down: (cls, body, leaf)."""
    seed = options.seed + turn
    chance = F.least(F.lit(1.0), F.lit(float(options.sample)) / F.col("size"))
    drawn = F.pmod(F.xxhash64("cls", "leaf", F.lit(seed)), F.lit(1 << 20)) < chance * (1 << 20)
    full = rows.join(big, "leaf")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, size = int(pdf.leaf.iloc[0]), int(pdf["size"].iloc[0])
        x = unit(pdf.body, number)
        levels = min(LEVELS, max(1, int(np.ceil(np.log2(size / (0.6 * options.leaf))))))
        cut = cuts(x, levels, directions(leaf, x.shape[1], seed), options.spill)
        return pd.DataFrame({"leaf": [leaf], "cut": [cut.tobytes()]})

    # A group here is a sample of about ``sample`` rows.
    models = stored(full.where(drawn).groupBy("leaf").applyInPandas(fit, "leaf long, cut binary"), "tree-nodes")

    def kernel(batches):
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            bodies, cut = batch.column("body").to_pylist(), batch.column("cut").to_pylist()
            order = np.argsort(leaf, kind="stable")
            edges = np.flatnonzero(np.diff(leaf[order])) + 1
            picked, below = [], []
            for rows_ in np.split(order, edges) if len(order) else []:
                x = unit([bodies[i] for i in rows_], number)
                own = np.frombuffer(cut[rows_[0]], np.float64).reshape(-1, 2)
                for node, ended in routed(x, directions(int(leaf[rows_[0]]), x.shape[1], seed), own):
                    picked.append(rows_[ended])
                    below.append(np.full(len(ended), node))
            if picked:
                take = np.concatenate(picked)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls").take(pa.array(take)), batch.column("body").take(pa.array(take)), pa.array(leaf[take]), pa.array(np.concatenate(below))],
                    names=["cls", "body", "above", "node"],
                )

    moved = rows.join(models, "leaf").select("cls", "body", "leaf", "cut")
    found = map_arrow(moved, kernel, "cls long, body binary, above long, node long")
    return found.select("cls", "body", F.xxhash64("above", "node", F.lit(turn)).alias("leaf"))


def leaves(classes: DataFrame, options: Forest, number) -> DataFrame:
    """(cls, body, leaf, size): every class in all its leaves."""
    trees = F.explode(F.sequence(F.lit(1), F.lit(options.trees)))
    rows = classes.select("cls", "body", "label", trees.alias("tree")).select(
        "cls", "body", F.xxhash64("label", F.length("body"), "tree").alias("leaf")
    )
    done = None
    for turn in range(options.rounds + 1):
        rows = stored(rows, "forest")
        sizes = stored(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")), "leaf-sizes")
        big = sizes.where(F.col("size") > options.leaf)
        last = turn == options.rounds or big.isEmpty()
        kept = rows.join(sizes if last else sizes.where(F.col("size") <= options.leaf), "leaf").select("cls", "body", "leaf", "size")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        rows = split(rows, big, options, number, turn)


def compare(pdf: pd.DataFrame, options: Forest, number) -> pd.DataFrame:
    """Counts and spanning edges of one leaf, or of one pair of its blocks: (a, b, n).

    A row with b null adds n links to a; one with b not null is an edge.
    """
    pdf = pdf.sort_values("cls", ignore_index=True)
    n, leaf = len(pdf), int(pdf.leaf.iloc[0])
    x = unit(pdf.body, number)
    near = x @ x.T >= options.threshold
    np.fill_diagonal(near, False)
    if pdf.i.iloc[0] != pdf.j.iloc[0]:  # two blocks: only pairs across
        near &= pdf.block.to_numpy()[:, None] != pdf.block.to_numpy()[None, :]
    if not near.any():
        return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
    name, copies = pdf.cls.to_numpy(), pdf.copies.to_numpy()
    left, right = np.nonzero(np.triu(near))
    width = max(map(len, pdf["all"]))
    table = np.full((n, width), np.iinfo(np.int64).max)
    for k, own in enumerate(pdf["all"]):
        table[k, : len(own)] = own
    links = np.zeros(n, np.int64)
    for at in range(0, len(left), 20_000):
        l, r = left[at : at + 20_000], right[at : at + 20_000]
        # The smallest leaf that both rows are in: their lists are sorted.
        first = np.full(len(l), np.iinfo(np.int64).max)
        for k in range(width):
            column = table[l, k]
            both = (table[r] == column[:, None]).any(1)
            first = np.where(both, np.minimum(first, column), first)
        own = first == leaf
        np.add.at(links, l[own], copies[r[own]])
        np.add.at(links, r[own], copies[l[own]])
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    some, tied = links > 0, label != np.arange(n)
    return pd.DataFrame({
        "a": pd.array(np.concatenate([name[some], name[tied]]), "Int64"),
        "b": pd.array([None] * int(some.sum()) + name[label[tied]].tolist(), "Int64"),
        "n": pd.array(np.concatenate([links[some], np.zeros(int(tied.sum()), np.int64)]), "Int64"),
    })


def linked(
    df: DataFrame, options: Forest = Forest(), id_column: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows, number = prepared(df, id_column, vector, label)
    rows = stored(rows.withColumn("cls", F.when(F.col("body").isNotNull(), F.xxhash64("label", "body"))), "vectors")
    classes = stored(
        rows.where("cls is not null").groupBy("cls").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("body").alias("body"), F.first("label").alias("label")
        ), "vector-classes",
    )
    placed = stored(leaves(classes, options, number), "leaves")
    lists = placed.groupBy("cls").agg(F.sort_array(F.collect_list("leaf")).alias("all"))
    # A leaf within bounds is one block; a larger one is every pair of its blocks.
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") * 2 / options.leaf)).cast("int")
    blocks = F.when(F.col("size") <= options.leaf, 1).otherwise(parts)
    full = (
        placed.join(lists, "cls").join(classes.select("cls", "copies"), "cls")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("cls", F.lit(options.seed)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cls", "body", "copies", "all", "leaf", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    found = stored(
        full.groupBy("leaf", "i", "j").applyInPandas(lambda pdf: compare(pdf, options, number), "a long, b long, n long"), "vector-links"
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    joined = stored(components(classes.select("cls"), found.where("b is not null").select("a", "b"), "cls"), "vector-components")
    least = joined.join(classes, "cls").groupBy("component_id").agg(F.min("least").alias("first"))
    facts = (
        classes.select("cls", "copies").join(joined, "cls").join(least, "component_id").join(counts, "cls", "left")
        .select("cls", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    )
    out = rows.join(facts, "cls", "left")
    component = F.coalesce("first", "id")
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"),
    )
