"""Candidate files read line by line: what cannot be used is kept with its file and line number.

JSON lines and CSV with a header line in each file, plain or gzip. A line that does not parse, has
another number of fields, or a header that differs from the declared one is *corrupt*; lines that
parse have their aliases resolved and their fields checked. Both kinds of faults become violations
under ``file:line``; the other rows are the candidates. Nothing is dropped silently: accepted rows
and faulty lines together are all lines but headers and blank ones.

Line numbers need no pass over a whole file in one task: Spark tells where each block of a file
starts, lines are numbered within their block as they are read, and the blocks' line counts are summed
up. A quoted line break inside a CSV field is not supported and shows as corrupt lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungwise.session import written
from rungwise.sources.tables import CANDIDATE_ALIASES, normalise_candidates

CORRUPT = "_corrupt"
PLACE = ["file", "line"]
CORRUPT_LINE, OTHER_HEADER = "corrupt_line", "header_differs"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line under ``path``, counted from 1 within its file; stored."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Read once: numbers inside a block hold for this reading of it.
    raw = written(raw, "lines")
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(blocks.drop("n"), ["file", "block"]).select(
        "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value"
    )


def parse_json(lines: DataFrame) -> DataFrame:
    """All aliases as text, ``_corrupt`` for lines that are no JSON object. Other fields are ignored."""
    names = [a for aliases in CANDIDATE_ALIASES.values() for a in aliases]
    schema = ", ".join(f"`{n}` string" for n in names) + f", {CORRUPT} string"
    filled = lines.where(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT})
    row = filled.select(*PLACE, "value", parsed.alias("x")).select(*PLACE, "value", "x.*")
    # A scalar or a list is valid JSON, but no row.
    broken = F.col(CORRUPT).isNotNull() | ~F.trim("value").startswith("{")
    return row.withColumn(CORRUPT, F.when(broken, F.lit(CORRUPT_LINE)))


def parse_csv(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """Columns of ``header`` as text; the first line of each file must be that header."""
    schema = ", ".join(f"`{n}` string" for n in header) + f", {CORRUPT} string"
    options = {"columnNameOfCorruptRecord": CORRUPT, "escape": '"', "emptyValue": "", "nullValue": "\u0000"}
    parsed = F.from_csv("value", schema, options)
    row = lines.where(F.trim("value") != "").select(*PLACE, "value", parsed.alias("x")).select(*PLACE, "value", "x.*")
    first = F.col("line") == 1
    named = F.lit(True)
    for name in header:
        named = named & F.col(name).eqNullSafe(F.lit(name))
    fault = F.when(first, F.when(~named, OTHER_HEADER)).when(F.col(CORRUPT).isNotNull(), CORRUPT_LINE)
    return row.withColumn(CORRUPT, fault).where(~first | F.col(CORRUPT).isNotNull())


def split_candidates(parsed: DataFrame, outcomes: Sequence[str] = ("Yes", "No")) -> tuple[DataFrame, DataFrame]:
    """(candidates with their file and line, violations) of parsed lines.

    A line with several faults is several violations. Lines are judged once and stored with what was
    found, as candidates and violations are read from them apart.
    """
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in PLACE])
    cut = parsed.withColumn("value", F.when(F.col(CORRUPT).isNotNull(), F.substring("value", 1, 200)))
    judged = written(normalise_candidates(cut, outcomes, keep=[*PLACE, "value", CORRUPT]), "candidates")
    corrupt = judged.where(f"{CORRUPT} is not null").select(
        F.col(CORRUPT).alias("rule_id"), key.alias("key"), F.col("value").alias("detail")
    )
    rows = judged.where(f"{CORRUPT} is null").drop("value", CORRUPT)
    faulty = rows.select(F.explode("problems").alias("rule_id"), key.alias("key"), F.lit("").alias("detail"))
    return rows.where(F.size("problems") == 0).drop("problems"), corrupt.unionByName(faulty)


def read_candidates(
    spark: SparkSession, path: str, header: Sequence[str] | None = None, outcomes: Sequence[str] = ("Yes", "No")
) -> tuple[DataFrame, DataFrame]:
    """(candidates, violations) of the files under ``path``: CSV if a header is given, else JSON lines."""
    lines = numbered_lines(spark, path)
    parsed = parse_json(lines) if header is None else parse_csv(lines, header)
    return split_candidates(parsed, outcomes)
