"""Bindings between documents: a value or count that one states must be what another holds.

A binding names two sides, each a (document, path). The value of a side is what the document's JSON
holds at the path, or a counted aggregate of a table's rows (``measured``) given under the same pair of
names. All sides of all bindings are looked up in one join and compared in one aggregate, so a
manifest that thousands of files refer to is parsed for its sides and never gathered.

Problems, one per binding: a side without a value; a count that is no whole number of zero or more, in
plain digits; a digest that is not 64 lower-case hex digits; two values that differ. Repeated bindings
are one; a binding with a null name is reported like any other, under an empty key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.chain import is_digest

TEXT, COUNT, DIGEST = "text", "count", "digest"


def measured(rows: DataFrame, document: str, counts: Mapping[str, Column]) -> DataFrame:
    """(document, path, value): named aggregates over the rows of each document, in one shuffle."""
    facts = rows.groupBy(F.col(document).cast("string").alias("document")).agg(
        *[measure.cast("string").alias(f"_{i}") for i, measure in enumerate(counts.values())]
    )
    pairs = [F.struct(F.lit(name).alias("path"), F.col(f"_{i}").alias("value")) for i, name in enumerate(counts)]
    return facts.select("document", F.inline(F.array(*pairs)))


def sides(bindings: DataFrame) -> DataFrame:
    """(binding, kind, side, document, path): both sides of every binding."""
    both = F.array(
        *[
            F.struct(F.lit(i).alias("side"), F.col(f"{s}_document").alias("document"), F.col(f"{s}_path").alias("path"))
            for i, s in enumerate(("left", "right"))
        ]
    )
    return bindings.select("binding", "kind", F.inline(both)).distinct()


def values(asked: DataFrame, documents: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """``asked`` with the value of each side, null where there is none.

    ``documents`` is (document, body), one row per document. Values from JSON are read only where a
    path starts with ``$``; all other paths name measures.
    """
    in_json = F.col("path").startswith("$")
    bodies = documents.select(F.col("document").alias("_d"), "body")
    found = (
        asked.where(in_json)
        .join(bodies, F.col("document") == F.col("_d"), "left")
        .select(*asked.columns, F.expr("get_json_object(body, path)").alias("value"))
    )
    rest = asked.where(~F.coalesce(in_json, F.lit(False)))
    if measures is None:
        return found.unionByName(rest.withColumn("value", F.lit(None).cast("string")))
    return found.unionByName(rest.join(measures.select("document", "path", "value"), ["document", "path"], "left"))


def problems(bindings: DataFrame, documents: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """``(rule_id, key, detail)`` of the bindings that do not hold.

    ``bindings`` is (binding, kind, left_document, left_path, right_document, right_path).
    """
    value = F.col("value")
    met = values(sides(bindings), documents, measures).groupBy("binding", "kind").agg(
        *[F.max(F.when(F.col("side") == i, value)).alias(name) for i, name in enumerate(("left", "right"))]
    )
    left, right = F.col("left"), F.col("right")

    def is_count(x: Column) -> Column:
        return x.rlike("^(0|[1-9][0-9]*)$")

    rule = (
        F.when(~F.coalesce(F.col("kind").isin(TEXT, COUNT, DIGEST), F.lit(False)), "binding_of_unknown_kind")
        .when(left.isNull(), "left_side_absent")
        .when(right.isNull(), "right_side_absent")
        .when((F.col("kind") == COUNT) & ~(is_count(left) & is_count(right)), "count_not_whole")
        .when((F.col("kind") == DIGEST) & ~(is_digest(left) & is_digest(right)), "digest_malformed")
        .when(left != right, "binding_differs")
    )
    said = F.concat_ws(" / ", F.coalesce(left, F.lit("-")), F.coalesce(right, F.lit("-")))
    return met.select(
        rule.alias("rule_id"), F.coalesce(F.col("binding").cast("string"), F.lit("")).alias("key"), said.alias("detail")
    ).where("rule_id is not null")
