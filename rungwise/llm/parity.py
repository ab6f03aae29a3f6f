"""N-gram Jaccard join by parity sketches (operator 7).

A document is its set of distinct word shingles, as 64-bit fingerprints. Documents with equal sets
are one class. Two classes of sizes a <= b link when intersection / union reaches the threshold t;
then the symmetric difference D is at most (a + b)(1 - t) / (1 + t).

Two sketches are made of XORs, so what both sets share cancels out:

* parts: within a size band all fingerprints are dealt to p parts and each part is the XOR of its
  fingerprints. A difference of D elements changes at most D parts, so by the pigeonhole principle
  two linked sets agree in all but D of their non-empty parts. Ordering part values by how many
  classes hold them, rarest first, they must then share one of the first D + 1 (values held once
  come first and are never joined). Classes meet on those values only.
* parity bits: every fingerprint flips one bit. The Hamming distance of two sketches is at most D,
  so candidates beyond that bound go before any set is fetched.

What is left is verified on whole sets. To keep large groups of near copies from becoming all their
pairs, a first round verifies each class against at most ``hubs`` of the classes it meets (a star).
Pairs inside a component need no further test. Pairs that still meet across components are compared
by parity bits where their value stands, in blocks of bounded size: first only the nearest pair of
any two components leaves the task to be verified, which joins most of what belongs together; then,
exactly, all pairs within the bound that are left. No link between different components can be lost.

Size bands are [2^g, 2^(g+1)); a class also joins the band of the smallest size that it may link
to. The number of parts exceeds what D + 1 non-empty parts need by 9 standard deviations or more;
below 32 shingles every shingle is a part of its own.

Defined cases: null and empty texts have size 0 and link with nothing; texts of fewer words than a
shingle are one shingle; rows with equal ids are documents of their own, links never go through an
id; null ids take part, and get the smallest id of their component, null if there is none; an empty
table gives no rows; extra columns are ignored by ``classes`` and kept by ``keep_one``. Fingerprints
of 64 bits stand for shingles and sets: unequal ones are taken for equal with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwise.llm.common import broadcast_if_small, components, fresh, map_arrow, stored

CACHE_WORDS = 300_000
STRETCH_BYTES = 1 << 20
#: Values that one task counts at a time, about; bytes of a value that stay (the lowest six bits name its band).
BUCKET_VALUES = 1_000_000
VALUE_BYTES = 6
#: Pairs that are looked at together.
STRETCH_PAIRS = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Join:
    shingle: int = 5
    #: The threshold as a fraction of whole numbers: numerator * union <= denominator * intersection.
    numerator: int = 75
    denominator: int = 100
    stars: int = 1
    nearest: int = 1
    hubs: int = 4
    #: Rows of a value that are compared with others in one task, and how many such blocks a value may
    #: have: no row moves more often, beyond that blocks hold more rows.
    block: int = 8192
    blocks: int = 64
    #: Values of at most so many classes name their pairs at once, without sketches.
    few: int = 32

    def difference(self, total: int) -> int:
        """The largest symmetric difference of two linked sets whose sizes add up to ``total``."""
        return total * (self.denominator - self.numerator) // (self.denominator + self.numerator)

    def largest(self, n: int) -> int:
        return n * self.denominator // self.numerator

    def smallest(self, n: int) -> int:
        return -(-n * self.numerator // self.denominator)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """One fingerprint per stretch of ``width`` neighbouring word hashes."""
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * _ODD + h[k : len(h) - width + 1 + k])
    return out


def shingle_sets(texts: list[str | None], width: int, cache: Words) -> Iterator[np.ndarray]:
    """Sorted distinct fingerprints of every text's shingles; texts of a stretch share the arithmetic."""
    at = 0
    while at < len(texts):
        words, ends, size = [], [0], 0
        while at < len(texts) and size < STRETCH_BYTES:
            raw = texts[at].encode().lower() if texts[at] else b""
            words += raw.split()
            ends.append(len(words))
            size += len(raw)
            at += 1
        if len(cache) > CACHE_WORDS:
            cache.clear()
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        full = rolled(h, width) if len(h) >= width else h[:0]
        for low, high in zip(ends, ends[1:]):
            n = high - low
            found = full[low : high - width + 1] if n >= width else rolled(h[low:high], n) if n else h[:0]
            found = np.sort(found)
            yield found[np.concatenate([found[:1] == found[:1], found[1:] != found[:-1]])]


def fingerprint(elements: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(elements.tobytes()), np.uint64).view(np.int64))


def band_of(n: int) -> int:
    return n.bit_length() - 1


def part_count(band: int) -> int:
    """Parts of a band; 0: every element is a part of its own."""
    low = 2**band
    return 0 if band < 5 else 2 * low if band < 6 else low * 3 // 2 if band < 8 else low


def part_values(elements: np.ndarray, band: int) -> np.ndarray:
    """One value per non-empty part, naming band and part; the band stands in the lowest 6 bits."""
    parts = part_count(band)
    if parts:
        where = mixed(elements + np.uint64(band)) % np.uint64(parts)
        order = np.argsort(where, kind="stable")
        where = where[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        folded = np.bitwise_xor.reduceat(elements[order], first) ^ mixed(where[first] + np.uint64(1))
    else:
        folded = elements
    return (mixed(folded * _ODD) & ~np.uint64(63)) | np.uint64(band)


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """Parity bits in 64-bit words: four to eight per element, a power of two, 256 to 32,768."""
    bits = 1 << min(15, max(8, (4 * len(elements) - 1).bit_length()))
    flips = np.bincount((mixed(elements ^ _ODD) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance after folding the longer sketch onto the shorter."""
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    return int(np.bitwise_count(a ^ b).sum())


def _picked(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))


def named(picked: DataFrame, join: Join) -> DataFrame:
    """(id, set, n): every document with the fingerprint and the size of its set."""

    def kernel(batches):
        cache = Words()
        for batch in batches:
            found = list(shingle_sets(batch.column("text").to_pylist(), join.shingle, cache))
            names = pa.array([fingerprint(s) if len(s) else None for s in found], pa.int64())
            sizes = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), names, sizes], names=["id", "set", "n"])

    return map_arrow(picked, kernel, "id long, set long, n long")


def sketched(picked: DataFrame, join: Join, source: int = 0) -> DataFrame:
    """(row, set, n, sketch, brief, bands): a row per document, numbered apart from other sources;
    ``brief`` is the sketch folded to half, ``bands`` are (band, need, values), where a class must
    be joined on its ``need`` rarest values."""
    band = pa.struct([("band", pa.int32()), ("need", pa.int32()), ("values", pa.list_(pa.int64()))])

    def bands(elements: np.ndarray) -> list[dict]:
        n, out = len(elements), []
        for b in sorted({band_of(n), band_of(join.smallest(n))}):
            # In its own band the set may be the smaller one, below it is the larger.
            total = n + (join.largest(n) if b == band_of(n) else n)
            out.append({"band": b, "need": join.difference(total) + 1, "values": part_values(elements, b).view(np.int64)})
        return out

    def kernel(batches):
        cache = Words()
        row = (source << 62) + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(at, 256).to_pylist()
                found = [s for s in shingle_sets(texts, join.shingle, cache) if len(s)]
                sketches = [parity_sketch(s) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(found))),
                        pa.array([fingerprint(s) for s in found], pa.int64()),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([x.tobytes() for x in sketches], pa.binary()),
                        pa.array([folded(x, max(4, len(x) // 2)).tobytes() for x in sketches], pa.binary()),
                        pa.array([bands(s) for s in found], pa.list_(band)),
                    ],
                    names=["row", "set", "n", "sketch", "brief", "bands"],
                )
                row += len(found)

    schema = "row long, set long, n long, sketch binary, brief binary, bands array<struct<band:int,need:int,values:array<long>>>"
    return map_arrow(picked, kernel, schema)


def packed(rows: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, base, rows, bytes): a row per bucket of values, in the order of values.

    A value moves as the bytes that differ inside a bucket (``VALUE_BYTES``, highest first, byte by
    byte, so that the sorted ones compress) and the number of its row from ``base`` in two bytes.
    """
    values = values & np.uint64((1 << 8 * VALUE_BYTES) - 1)
    order = np.argsort(values, kind="stable")
    values, base = values[order], int(rows.min())
    places = (rows[order] - base).astype(np.uint16)
    bucket = bucket_of(values, buckets)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(values)]
    planes = values.view(np.uint8).reshape(-1, 8)[:, VALUE_BYTES - 1 :: -1]
    spans = list(zip(edges, edges[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([bucket[low] for low, _ in spans], pa.int32()),
            pa.array([base] * len(spans), pa.int64()),
            pa.array([places[low:high].tobytes() for low, high in spans], pa.binary()),
            pa.array([planes[low:high].T.tobytes() for low, high in spans], pa.binary()),
        ],
        names=["bucket", "base", "rows", "bytes"],
    )


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the highest 32 of the bytes that stay."""
    high = values >> np.uint64(8 * VALUE_BYTES - 32)
    return ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def unpacked(base: int, rows: bytes, planes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` put in: rows and values."""
    places = np.frombuffer(rows, np.uint16)
    wide = np.zeros((len(places), 8), np.uint8)
    wide[:, VALUE_BYTES - 1 :: -1] = np.frombuffer(planes, np.uint8).reshape(VALUE_BYTES, -1).T
    return places.astype(np.int64) + base, wide.view(np.uint64).ravel()


def shared_values(sets: DataFrame) -> DataFrame:
    """(value, row, often): values that several rows of ``sets`` hold, and how many do.

    Values move once, packed, into buckets of a bounded number; a task counts one bucket at a time.
    """
    each = sets.select("row", F.flatten("bands.values").alias("values"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    tasks = max(2 * sets.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET_VALUES))

    def pack(batches):
        for batch in batches:
            rows, lists = batch.column("row").to_numpy(), batch.column("values")
            at = 0
            while at < len(rows):  # as many rows as two bytes number; those of one file follow each other
                near = (rows[at:] >= rows[at]) & (rows[at:] - rows[at] < 1 << 16)
                size = len(near) if near.all() else int(near.argmin())
                part = lists.slice(at, size)
                values = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                counts = part.value_lengths().to_numpy(zero_copy_only=False)
                if len(values):
                    yield packed(np.repeat(rows[at : at + size], counts), values, tasks)
                at += size

    def counted(held):
        rows, values = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(values, kind="stable")
        rows, values = rows[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        often = np.diff(np.append(first, len(values)))
        often = np.repeat(often, often)
        keep = often > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(values[keep].view(np.int64)), pa.array(rows[keep]), pa.array(often[keep])],
            names=["value", "row", "often"],
        )

    def count(batches):
        now, held = None, []
        for batch in batches:
            for bucket, *blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "base", "rows", "bytes")), strict=True):
                if held and bucket != now:
                    yield counted(held)
                    held = []
                now = bucket
                held.append(unpacked(*blob))
        if held:
            yield counted(held)

    moved = map_arrow(each, pack, "bucket int, base long, rows binary, bytes binary")
    dealt = moved.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, count, "value long, row long, often long")


def met(sets: DataFrame) -> DataFrame:
    """(value, set, n): the shared values that each class must be joined on.

    One shuffle of values counts the classes of each (``shared_values``); those held once go there.
    Per class and band the rarest ``need`` values, counting the ones held once, are kept.
    """
    shared = stored(shared_values(sets), "shared-values")
    facts = sets.select("row", "set", "n", F.explode("bands").alias("x")).select(
        "row", "set", "n", F.col("x.band").alias("band"), F.col("x.need").alias("need"), F.size("x.values").alias("values")
    )
    own = Window.partitionBy("row", "band")
    ranked = (
        shared.withColumn("band", F.col("value").bitwiseAND(63).cast("int"))
        .withColumn("shared", F.count(F.lit(1)).over(own))
        .withColumn("place", F.row_number().over(own.orderBy("often", "value")))
        .join(facts, ["row", "band"])
        .where(F.col("place") <= F.col("need") - (F.col("values") - F.col("shared")))
    )
    return ranked.select("value", "set", "n")


def still_open(where: DataFrame, parts: DataFrame | None, turn: int = 0) -> DataFrame:
    """(value, set, n, component_id, k, hub) of the values that classes of several components share;
    ``k`` is how many classes hold the value, ``hub`` one of them, drawn by hash. Without ``parts``
    every class is a component of its own, and only the hubs move."""
    if parts is None:
        drawn = F.struct(F.xxhash64("value", "set", F.lit(turn)).alias("h"), "set", "n")
        several = where.groupBy("value").agg(F.count(F.lit(1)).alias("k"), F.min(drawn).alias("hub")).where("k > 1")
        hub = F.struct(F.col("hub.set").alias("a"), F.col("hub.n").alias("na"), F.col("hub.set").alias("ca"))
        return where.withColumn("component_id", F.col("set")).join(several.withColumn("hub", hub), "value")
    labelled = where.join(broadcast_if_small(parts), "set")
    hub = F.struct(
        F.xxhash64("value", "set", F.lit(turn)).alias("h"), F.col("set").alias("a"),
        F.col("n").alias("na"), F.col("component_id").alias("ca"),
    )
    several = labelled.groupBy("value").agg(
        F.min("component_id").alias("x"), F.max("component_id").alias("y"),
        F.count(F.lit(1)).alias("k"), F.min(hub).alias("hub"),
    )
    return labelled.join(several.where("x <> y").drop("x", "y"), "value")


def _may_link(m: str, n: str, join: Join):
    """Do the sizes allow a link?"""
    a, b = F.col(m), F.col(n)
    return (a * join.numerator <= b * join.denominator) & (b * join.numerator <= a * join.denominator)


def stars(open_: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) of each class with at most ``hubs`` classes of other components, those that it
    meets most often as hubs of values."""
    met_hub = open_.select("set", "n", "component_id", "hub.a", "hub.na", "hub.ca")
    often = met_hub.where("component_id <> ca").where(_may_link("n", "na", join)).groupBy("set", "a").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("times"), "a"))
    best = often.withColumn("place", place).where(F.col("place") <= join.hubs)
    return best.select(F.least("a", "set").alias("a"), F.greatest("a", "set").alias("b")).distinct()


def gathered(open_: DataFrame, join: Join) -> DataFrame:
    """``open_`` without its hubs, and with values that much the same classes hold taken as one.

    Near copies share dozens of values, and at each of them all their pairs would meet anew. Values
    of many classes and one band are grouped by the holder of the smallest hash; a group that has no
    more pairs than its values have, each for itself, takes their place under its smallest value.
    Classes that share a value share its group, so no pair is lost.
    """
    open_ = stored(open_.drop("hub"), "open-values")
    few = F.col("k") <= min(join.few, join.block)
    if open_.where(~few).isEmpty():
        return open_
    band = F.col("value").bitwiseAND(63).alias("band")
    first = open_.where(~few).groupBy("value").agg(F.min(F.xxhash64("set")).alias("first"))
    many = stored(open_.where(~few).join(first, "value").select(*open_.columns, "first", band), "many")
    each = many.groupBy("first", "band", "set").agg(
        F.min("n").alias("n"), F.min("component_id").alias("component_id"),
        F.min("value").alias("least"), F.sum("k").alias("pairs"),
    )
    groups = stored(
        each.groupBy("first", "band")
        .agg(F.min("least").alias("value"), F.count(F.lit(1)).alias("k"), F.sum("pairs").alias("pairs"))
        .where("k * k <= pairs").drop("pairs"),
        "groups",
    )
    together = each.join(groups, ["first", "band"]).select(open_.columns)
    apart = many.join(groups.select("first", "band"), ["first", "band"], "left_anti").select(open_.columns)
    return open_.where(few).unionByName(apart).unionByName(together)


def near_pairs(group: pa.Table, join: Join, nearest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of one value, or of two of its blocks, that may link and are in different components, and
    whether those are all, a stretch of rows at a time: with ``nearest``, once they are more than
    twice the rows, just the pair that is nearest for its sizes of each two components is named."""
    n, part, block = (group.column(c).to_numpy() for c in ("n", "component_id", "block"))
    two = group.column("i")[0] != group.column("j")[0]
    low, high = n * join.numerator, n * join.denominator
    place = np.arange(len(n))
    sketches = [np.frombuffer(x, np.uint64) for x in group.column("brief").to_pylist()]
    words = min(map(len, sketches))
    table = np.stack([folded(x, words) for x in sketches])
    step = max(1, (1 << 21) // words)
    rows, named = max(1, STRETCH_PAIRS // len(n)), 0
    for start in range(0, len(n), rows):
        own, rest = (slice(start, start + rows), None), (None, slice(start, None))
        across = (part[own] != part[rest]) & (place[own] < place[rest])
        if two:
            across &= block[own] != block[rest]
        across &= (low[own] <= high[rest]) & (low[rest] <= high[own])
        left, right = (x + start for x in np.nonzero(across))
        keep, share = [np.zeros(0, np.int64)], [np.zeros(0)]
        for at in range(0, len(left), step):
            a, b = left[at : at + step], right[at : at + step]
            apart = np.bitwise_count(table[a] ^ table[b]).sum(1, dtype=np.int64)
            bound = (n[a] + n[b]) * (join.denominator - join.numerator) // (join.denominator + join.numerator)
            near = np.flatnonzero(apart <= bound)
            keep.append(at + near)
            share.append(apart[near] / np.maximum(1, n[a] + n[b])[near])
        keep = np.concatenate(keep)
        named += len(keep)
        whole = not nearest or named <= 2 * len(n)
        if not whole:
            x, y = (np.sort(np.stack([part[left[keep]], part[right[keep]]]), axis=0))
            order = np.lexsort((keep, np.concatenate(share), y, x))
            first = np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])[: len(order)]
            keep = keep[order[first]]
        yield left[keep], right[keep], whole


def tiled(many: DataFrame, join: Join) -> DataFrame:
    """``many`` with ``block``, and a row for each pair of blocks (i, j) that its block is in."""
    blocks = F.least(F.lit(join.blocks), F.ceil(F.col("k") / join.block)).cast("int")
    return (
        many.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    )


def crossing(open_: DataFrame, sets: DataFrame, join: Join, nearest: bool = False) -> DataFrame:
    """(value, a, b, whole): pairs that share a value across components and are within the bound of
    parity bits; with ``nearest``, values with very many of them name one of each two components
    where they meet, and are marked as not whole.

    The pairs of values that ``few`` classes hold are named once, as numbers; their sketches meet when
    they are verified, once per pair and not per value. The rows of other values are dealt to blocks,
    and each pair of blocks is one group of at most about two blocks' rows; groups follow each other
    sorted, so a task holds one group and one batch. A row moves once per block of its value, at most
    ``blocks`` times however many hold the value, and once if they fit into one block.
    """
    few = F.col("k") <= min(join.few, join.block)
    row = F.struct("set", "n", "component_id")
    rows = F.col("rows")
    ahead = F.transform(rows, lambda x: F.transform(F.filter(rows, lambda y: x["set"] < y["set"]), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    named_at_once = (
        open_.where(few).groupBy("value").agg(F.collect_list(row).alias("rows"))
        .select(F.explode(F.flatten(ahead)).alias("p")).select("p.x", "p.y")
        .where("x.component_id <> y.component_id").where(_may_link("x.n", "y.n", join))
        .select(F.lit(0).cast("long").alias("value"), F.col("x.set").alias("a"), F.col("y.set").alias("b"), F.lit(True).alias("whole"))
        .distinct()
    )
    many = open_.where(~few)
    drawn = sets.join(broadcast_if_small(many.select("set").distinct()), "set", "left_semi")
    dealt = (
        tiled(many, join)
        .join(drawn.select("set", "brief"), "set")
        .select("value", "i", "j", "block", "set", "n", "component_id", "brief")
        .repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")
    )

    def kernel(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held.column(c).to_numpy() for c in ("value", "i", "j")])
            edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])
            yield from groups(held, edges)
            held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from groups(held, np.array([0, held.num_rows]))

    def groups(held: pa.Table, edges: np.ndarray):
        for low, high in zip(edges, edges[1:]):
            group = held.slice(low, high - low)
            value, name = (group.column(c).to_numpy() for c in ("value", "set"))
            for left, right, whole in near_pairs(group, join, nearest):
                x, y = name[left], name[right]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[left]), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(x), whole))],
                    names=["value", "a", "b", "whole"],
                )

    return map_arrow(dealt, kernel, "value long, a long, b long, whole boolean").unionByName(named_at_once)


def with_set(docs: DataFrame, join: Join, text: str, column: str) -> DataFrame:
    """``docs`` and the fingerprint of each row's set, null for texts without words."""

    def kernel(batches):
        cache = Words()
        for batch in batches:
            found = shingle_sets(batch.column(text).to_pylist(), join.shingle, cache)
            names = pa.array([fingerprint(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, column])

    return map_arrow(docs, kernel, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def verified(
    pairs: DataFrame, sets: DataFrame, owners: DataFrame, picked: DataFrame, join: Join, repeats: bool = True
) -> DataFrame:
    """The pairs (a, b) of set names that link: first by parity bits, then on the whole sets.

    Sets are made again from the texts of the documents that ``owners`` (id, set) names, a set's
    own document each; only texts with a surviving pair are read beyond the scan. A null id in
    ``owners`` stands for any of the rows without an id. ``pairs`` is a stored table; ``repeats``
    tells whether ids may stand in several rows.
    """
    judged = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    drawn = sets.join(broadcast_if_small(judged), "set", "left_semi")
    side = lambda x: drawn.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def near(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")]
            keep = [
                hamming(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= join.difference(m + n)
                for m, n, x, y in zip(*columns, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    left = stored(map_arrow(sized, near, "a long, b long"), "near-pairs")
    wanted = left.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    ids = stored(owners.join(wanted, "set").select(F.col("id").alias("own"), "set"), "wanted")
    texts = picked.join(broadcast_if_small(ids.where("own is not null")), picked["id"] == F.col("own")).select("text", "set")
    unnamed = ids.where("own is null").select("set")
    if not unnamed.isEmpty():
        repeats = True
        without = with_set(picked.where("id is null").select("text"), join, "text", "set")
        texts = texts.unionByName(without.join(broadcast_if_small(unnamed), "set", "left_semi").select("text", "set"))

    def whole(batches):
        cache = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(shingle_sets(part.column("text").to_pylist(), join.shingle, cache))
                match = [len(s) > 0 and fingerprint(s) == k for s, k in zip(found, part.column("set").to_pylist(), strict=True)]
                bodies = pa.array([s.tobytes() for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("set"), bodies], names=["set", "body"]).filter(pa.array(match, pa.bool_()))

    made = map_arrow(texts, whole, "set long, body binary")
    bodies = stored(made.dropDuplicates(["set"]) if repeats else made, "sets")

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(join.denominator * both >= join.numerator * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = (
        left.join(bodies.select(F.col("set").alias("a"), F.col("body").alias("x")), "a")
        .join(bodies.select(F.col("set").alias("b"), F.col("body").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return stored(map_arrow(full, linked, "a long, b long"), "links")


def repeated(rows: DataFrame) -> bool:
    """Does any id stand in more than one row? Only then is it worth moving whole rows by id."""
    return not rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()


def labelled(docs: DataFrame, join: Join, id_column: str, text: str) -> DataFrame:
    """(id, set, n, component, least): a row per document, with its set's component (null for texts
    without words) and the smallest id there."""
    picked = _picked(docs, id_column, text)
    rows = stored(named(picked, join), "named")
    owners = stored(rows.where("set is not null").groupBy("set").agg(F.min("id").alias("id")), "classes")
    first = owners.select(F.col("id").alias("own"), F.col("set").alias("own_set")).where("own is not null")
    # A class is sketched from its smallest id, one that only rows without an id hold from those rows.
    chosen = picked.join(broadcast_if_small(first.select("own").distinct()), picked["id"] == F.col("own"), "left_semi")
    sets = sketched(chosen, join)
    repeats = repeated(rows)
    if repeats:
        sets = sets.dropDuplicates(["set"])
    unnamed = owners.where("id is null").select("set")
    if not unnamed.isEmpty():
        more = sketched(picked.where("id is null"), join, 1).join(unnamed, "set", "left_semi")
        sets = sets.unionByName(more.dropDuplicates(["set"]))
    sets = stored(sets, "sketches")
    where = stored(met(sets), "met")

    nodes = stored(where.select("set").distinct(), "nodes")
    parts = links = None
    for turn in range(join.stars + join.nearest + 1):
        open_ = still_open(where, parts, turn)
        if turn < join.stars:
            some = stored(stars(open_, join), "some-pairs")
        else:
            open_ = stored(gathered(open_, join), "open-groups")
            met_pairs = stored(crossing(open_, sets, join, nearest=turn < join.stars + join.nearest), "met-pairs")
            some = stored(met_pairs.select("a", "b").distinct(), "some-pairs")
        if not some.isEmpty():
            more = verified(some, sets, owners, picked, join, repeats)
            links = more if links is None else links.unionByName(more)
        if turn < join.stars:
            if links is not None:
                parts = stored(components(nodes, links, "set"), "components")
            continue
        # Values all of whose pairs were named are done; only the others meet again.
        again = met_pairs.where("not whole").select("value").distinct()
        if again.isEmpty():
            break
        where = stored(open_.join(again, "value", "left_semi").select("value", "set", "n"), "met-again")
        parts = stored(components(nodes, links, "set"), "components")
    if links is None:
        links = owners.select(F.col("set").alias("a"), F.col("set").alias("b")).limit(0)
    found = stored(components(sets.select("set"), links, "set"), "components")
    label = found.join(owners, "set").groupBy("component_id").agg(F.min("id").alias("least"))
    named_by = found.join(label, "component_id").select("set", F.col("component_id").alias("component"), "least")
    return rows.join(named_by, "set", "left").select("id", "set", "n", "component", "least")


def classes(docs: DataFrame, join: Join = Join(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    return labelled(docs, join, id_column, text).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.coalesce("least", "id").alias("component_id"),
    )


def keep_one(docs: DataFrame, join: Join = Join(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with the columns of ``docs``.

    Documents without words all stay, as they link with nothing, and so do rows with a null id. Rows
    that repeat an id are decided one by one: each goes or stays with its own component, and of
    several rows of one component that have its smallest id, the one with the smallest text stays.
    """
    name = fresh(docs)
    own, times, group, component = name("own"), name("times"), name("set"), name("component")
    found = labelled(docs, join, id_column, text).where("id is not null")
    stays = F.coalesce("least", "id") == F.col("id")
    kept = stored(
        found.groupBy(F.col("id").alias(own))
        .agg(F.count(F.lit(1)).alias(times), F.max(stays).alias("stays"))
        .where("stays").drop("stays"),
        "kept",
    )
    joined = docs.join(broadcast_if_small(kept), F.col(id_column).cast("long") == F.col(own))
    out = joined.where(F.col(times) == 1).select(docs.columns)
    several = kept.where(F.col(times) > 1)
    if not several.isEmpty():
        again = with_set(joined.where(F.col(times) > 1).select(*docs.columns, own), join, text, group)
        wordless = again.where(F.col(group).isNull()).select(docs.columns)
        places = (
            found.where(stays & F.col("set").isNotNull())
            .join(several.select(F.col(own).alias("id")), "id", "left_semi")
            .select(F.col("id").alias(own), F.col("set").alias(group), F.col("component").alias(component))
            .distinct()
        )
        row = name("row")
        first = (
            again.join(places, [own, group])
            .groupBy(component)
            .agg(F.min_by(F.struct(*docs.columns), F.col(text)).alias(row))
        )
        out = out.unionByName(wordless).unionByName(first.select(f"{row}.*"))
    return out.unionByName(docs.where(F.col(id_column).isNull()))
