"""Ranked lexical search by accumulator-limited term-at-a-time evaluation (operator 11).

All items are evaluated together, one class of terms after the other: class c holds the terms with
about 4**c documents, so an item's rarest terms come first. A class adds what its terms give to the
accumulators (item, document). After each class, an item whose k-th best partial score is above all
that its remaining terms could still add stops making accumulators: a document without one can no
longer come in. Its survivors are updated exactly by the remaining terms, and dropped once even
all remaining terms cannot lift them to the k-th partial score.

Documents with the same terms in the same numbers and the same length score alike, so they are one
class with a row count and its k smallest ids, the only ones that can be ranked. Per-document work
is a single scan that keeps terms of items only, recognised by a bitmap of fixed size (false
positives fall out in the join that follows). Postings are written once, one folder per class, so a
round reads its own class. Tables of item terms are broadcast only after they were counted.

Defined cases: null and empty texts hold no term (they count in no statistic, rank nowhere and find
nothing); repeated rows are documents of their own, and repeated items each get their own ranks;
a null document id ranks last among equal scores; items without a score above 0 have no rows; an
empty table on either side gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.llm.common import broadcast_if_small, map_arrow, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of the bitmap that recognises item terms while documents are scanned: 1 MB, always.
BITMAP_BITS = 1 << 23
_BUCKET = 1 << 15
#: Remembered verdicts of the bitmap in a task.
_KNOWN = 1 << 20
# Letters, digits and all bytes of longer code points stay (A-Z lower-cased); the rest separates.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Ranking:
    k: int = 10
    #: Fixed values of the scoring rule.
    length_share: int = 75
    saturation: int = 8
    #: A class of terms holds those with up to so many times the documents of the class before.
    class_factor: int = 4


def terms(text: bytes) -> list[bytes]:
    """The terms of an UTF-8 text, in order."""
    return text.translate(_TABLE).split()


class _Known(dict):
    """Is a term perhaps one of the items'? Verdicts are remembered, up to a bound."""

    def __init__(self, bitmap: dict[int, bytes]):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, term: bytes) -> bool:
        bucket, bit = divmod(zlib.crc32(term) % BITMAP_BITS, _BUCKET)
        bits = self.bitmap.get(bucket)
        verdict = bits is not None and bool(bits[bit >> 3] >> (bit & 7) & 1)
        if len(self) >= _KNOWN:
            self.clear()
        self[term] = verdict
        return verdict


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term, times) of every row of items, stored; ``item`` numbers the rows."""
    numbered = stored(
        items.select(F.col(item_id).alias("item_id"), F.col(text).alias("t")).withColumn("item", F.monotonically_increasing_id()),
        "items",
    )
    words = F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return stored(
        numbered.select("item", "item_id", F.explode(words).alias("term"))
        .groupBy("item", "item_id", "term")
        .agg(F.count(F.lit(1)).alias("times")),
        "item-terms",
    )


def bitmap(vocabulary: DataFrame) -> dict[int, bytes]:
    """Bits of the terms' crc32, in buckets of 4 KB, at most ``BITMAP_BITS`` altogether."""
    bit = F.crc32(F.col("term").cast("binary")) % BITMAP_BITS
    found = (
        vocabulary.select(F.floor(bit / _BUCKET).alias("bucket"), (bit % _BUCKET).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    return {r.bucket: bytes(r.bits) for r in found.collect()}


def forward(docs: DataFrame, wanted: dict[int, bytes], id_column: str, text: str) -> DataFrame:
    """(id, n, same, terms, times) of every document with a term: its terms that items may hold.

    ``same`` is a digest (128 bits) of all the other columns but the id.
    """
    picked = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def kernel(batches):
        known = _Known(wanted)
        for batch in batches:
            row, n, same, found, times = [], [], [], [], []
            for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                all_terms = terms(raw or b"")
                if not all_terms:
                    continue
                kept = sorted((t, c) for t, c in Counter(all_terms).items() if known[t])
                row.append(i)
                n.append(len(all_terms))
                found.append([t for t, _ in kept])
                times.append([c for _, c in kept])
                key = b"%d " % n[-1] + b" ".join(b"%b %d" % x for x in kept)
                same.append(hashlib.blake2b(key, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), pa.array(same, pa.binary()),
                    pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64())),
                ],
                names=["id", "n", "same", "terms", "times"],
            )

    schema = f"id {kind}, n long, same binary, terms array<string>, times array<long>"
    return stored(map_arrow(picked, kernel, schema), "forward")


def _impact() -> Column:
    """What a term with weight 1 gives, from its occurrences and the document's m."""
    return F.expr("(1000000000 * times) div (1000 * times + saturation * m)")


def bodies(rows: DataFrame, options: Ranking) -> DataFrame:
    """(doc, same, copies, m, first_id, terms, times): one row per class of equal documents."""
    total = rows.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    share, n_docs, n_terms = options.length_share, total.N, total.L or 1
    return stored(
        rows.groupBy("same")
        .agg(
            F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"), F.first("n").alias("n"),
            F.first("terms").alias("terms"), F.first("times").alias("times"),
        )
        .select(
            F.monotonically_increasing_id().alias("doc"), "same", "copies", "first_id", "terms", "times",
            F.expr(f"{100 - share}L + ({share}L * n * {n_docs}L) div {n_terms}L").alias("m"),
        ),
        "bodies",
    )


def _spread(found: DataFrame, options: Ranking) -> DataFrame:
    """One row per class of documents and term, with the term's impact."""
    return (
        found.select("doc", "copies", "m", F.explode(F.arrays_zip("terms", "times")).alias("x"))
        .select("doc", "copies", "m", F.col("x.terms").alias("term"), F.col("x.times").alias("times"), F.lit(options.saturation).cast("long").alias("saturation"))
        .select("doc", "copies", "term", _impact().alias("impact"))
    )


def weigh(wanted: DataFrame, found: DataFrame, options: Ranking, n_docs: int) -> DataFrame:
    """(term, class, w, top) of the items' terms that documents hold; ``top`` is the best impact."""
    counted = _spread(found, options).groupBy("term").agg(F.sum("copies").alias("df"), F.max("impact").alias("top"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1)))
    rank = F.floor(F.log(F.col("df").cast("double")) / F.log(F.lit(float(options.class_factor))) + 1e-9)
    return stored(
        counted.join(wanted, "term", "left_semi").select("term", rank.cast("int").alias("class"), weight.cast("long").alias("w"), "top"),
        "weights",
    )


def postings_of(found: DataFrame, weights: DataFrame, options: Ranking) -> DataFrame:
    """(doc, copies, term, impact, class) of the items' terms, stored in one folder per class."""
    rows = _spread(found, options).join(broadcast_if_small(weights.select("term", "class")), "term")
    return stored(rows, "postings", "class")


def plan_of(asked: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, class, term, weight, bound) of every term of an item that documents hold, stored."""
    weight = F.col("times") * F.col("w")
    rows = asked.join(weights, "term").select("item", "class", "term", weight.alias("weight"), (weight * F.col("top")).alias("bound"))
    return stored(rows, "plan")


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item, kth): the k-th best partial score of each item with so many documents."""
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    head = sums.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
    upto = head.withColumn("upto", F.sum("copies").over(Window.partitionBy("item").orderBy("at")))
    return upto.where(F.col("upto") >= k).groupBy("item").agg(F.max("score").alias("kth"))


def accumulate(plan: DataFrame, postings: DataFrame, classes: list[int], k: int) -> DataFrame | None:
    """(item, doc, copies, score): exact scores of every document that can be among an item's best.

    ``plan`` has (item, class, term, weight, bound): ``bound`` is what the term adds at most.
    """
    sums, shut = None, None
    for c in classes:
        own = plan.where(F.col("class") == c).select("item", "term", "weight")
        here = postings.where(F.col("class") == c).select("doc", "copies", "term", "impact")
        if shut is None:
            parts = [_created(own, here)]
        else:
            parts = [sums, _created(own.join(shut, "item", "left_anti"), here), _updated(sums, own.join(shut, "item", "left_semi"), here)]
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        both = both.groupBy("item", "doc").agg(F.max("copies").alias("copies"), F.sum("score").alias("score"))
        both = stored(both, "sums")
        # What can still come to an item: the classes after this one, of those that it has.
        rest = plan.where(F.col("class") > c).groupBy("item").agg(F.sum("bound").alias("rest"))
        state = (
            _kth(both, k).join(rest, "item", "left").select("item", "kth", F.coalesce("rest", F.lit(0)).alias("rest"))
        )
        state = stored(state, "state")
        sums = (
            both.join(broadcast_if_small(state), "item", "left")
            .where("kth is null or score + rest >= kth")
            .select("item", "doc", "copies", "score")
        )
        shut = state.where("rest < kth").select("item")
    return sums


def _created(own: DataFrame, postings: DataFrame) -> DataFrame:
    return postings.join(broadcast_if_small(own), "term").select(
        "item", "doc", "copies", (F.col("weight") * F.col("impact")).alias("score")
    )


def _updated(sums: DataFrame, own: DataFrame, postings: DataFrame) -> DataFrame:
    """What a class adds to accumulators that exist already."""
    asked = sums.select("item", "doc").join(broadcast_if_small(own), "item")
    held = postings.join(own.select("term").distinct(), "term", "left_semi")
    return asked.join(held, ["doc", "term"]).select("item", "doc", "copies", (F.col("weight") * F.col("impact")).alias("score"))


def rank(
    docs: DataFrame, items: DataFrame, options: Ranking = Ranking(),
    id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, id, score): the ``k`` best documents of every item."""
    k = options.k
    asked = item_terms(items, item_id, item_text)
    vocabulary = asked.select("term").distinct()
    rows = forward(docs, bitmap(vocabulary), id_column, text)
    found = bodies(rows, options)
    n_docs = int(found.agg(F.sum("copies")).first()[0] or 0)
    weights = weigh(vocabulary, found, options, n_docs)
    postings, plan = postings_of(found, weights, options), plan_of(asked, weights)
    classes = sorted(r[0] for r in weights.select("class").distinct().collect())
    named = asked.select("item", "item_id").distinct()
    if not classes:
        kinds = named.schema["item_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
        schema = f"item_id {kinds[0]}, rank int, `{id_column}` {kinds[1]}, score long"
        return docs.sparkSession.createDataFrame([], schema)
    sums = accumulate(plan, postings, classes, k)
    # The best k classes of equal documents hold the best k documents, with their smallest ids.
    firsts = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first_id"))
    best = (
        sums.where("score > 0")
        .join(found.select("doc", "same", "first_id"), "doc")
        .withColumn("at", F.row_number().over(firsts))
        .where(F.col("at") <= k)
        .select("item", "same", "score")
    )
    nth = Window.partitionBy("same").orderBy(F.asc_nulls_last("id"))
    members = rows.select("id", "same").withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "same", "nth")
    return (
        best.join(members, "same")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .join(named, "item")
        .select("item_id", "rank", F.col("id").alias(id_column), "score")
    )
