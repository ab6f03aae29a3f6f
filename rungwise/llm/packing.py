"""Best-two-fit packing of documents into sequences of a fixed length (operator 13).

Every document is its ids and an end id. Longer ones are cut into pieces of the full length, the
remainder first. Pieces of one length are interchangeable, so the packing is decided on the counts
of the lengths 1 .. ``size``: a bin is filled greedily with the longest piece that fits; then its
smallest piece makes room for two pieces that fit the widened gap more tightly, if there are such.
As long as the pieces it used are left in the numbers it looked at, the next bin comes out the same,
so bins are made in runs of equal bins: few runs, however many documents. The driver sees one count
per length and returns a table of runs whose size depends on ``size`` alone.

Pieces are then numbered within their length without gathering a length anywhere: a task numbers
its own, the tasks' counts are summed up, and the number finds the run, the bin and the place in it.

Ids are those of the ``tokenizers`` library. Texts that hold only letters and signs on which the
split patterns of both libraries agree (``PLAIN``, tested for every code point) are encoded by the
same vocabulary through ``tiktoken``, which takes a third of the time; all other texts go through
``tokenizers``.

Defined cases: null and empty texts are the end id alone; repeated rows and null ids are documents
of their own; a document of exactly ``size`` ids fills a sequence; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rungwise.llm import bpe
from rungwise.llm.common import broadcast_if_small, map_arrow, stored

VOCABULARY = "byte_bpe_50k.json"
#: ASCII, Latin, Greek and Cyrillic letters and general punctuation.
PLAIN = re.compile("[\\x00-\\x7f\\xa0-ȳΑ-ΡΣ-ώЀ-џ‐-‧‰-⁞₠-₵]*")


@dataclass(frozen=True)
class Packing:
    size: int = 1024
    end_id: int = 2


@dataclass(frozen=True)
class Run:
    """``times`` equal bins; ``parts`` are (length, copies) in the order they lie in a bin."""

    times: int
    parts: tuple[tuple[int, int], ...]


_LIBRARY: dict[str, Tokenizer] = {}


def library(file: str) -> Tokenizer:
    if file not in _LIBRARY:
        own = Tokenizer.from_file(file)
        own.encode_special_tokens = True
        _LIBRARY[file] = own
    return _LIBRARY[file]


def encode_text(text: str | None, file: str, rank_file: str | None) -> list[int]:
    """Ids of a whole text; ``rank_file`` holds the same vocabulary as ranks, None to do without."""
    if not text:
        return []
    if rank_file and PLAIN.fullmatch(text):
        return bpe.encode_text(text, bpe.encoding(rank_file))
    own = library(file)
    if len(text) <= bpe.PART_CHARS:
        return own.encode(text, add_special_tokens=False).ids
    ids: list[int] = []
    for part, _ in bpe.parts(text):
        ids += own.encode(part, add_special_tokens=False).ids
    return ids


def pieces(
    docs: DataFrame, file: str, rank_file: str | None = None, options: Packing = Packing(),
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): the pieces of every document, stored.

    ``nth`` numbers the pieces of one length within the task ``part`` that wrote them. Both are
    frozen with the file: a task that runs again replaces all of its rows.
    """
    picked = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    size, end = options.size, options.end_id

    def kernel(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode_text(text, file, rank_file)
                ids.append(end)
                raw, at, k = np.array(ids, "<u4").tobytes(), 0, 0
                while at < len(ids):
                    stop = at + (len(ids) % size or size) if k == 0 else at + size
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * stop]))
                    at, k = stop, k + 1
            sizes = np.array(length, np.int64)
            nth = np.zeros(len(sizes), np.int64)
            order = np.argsort(sizes, kind="stable")
            values, first, counts = np.unique(sizes[order], return_index=True, return_counts=True)
            nth[order] = np.arange(len(sizes)) - np.repeat(first, counts) + np.repeat(seen[values], counts)
            seen[values] += counts
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(sizes), part, np.int32)), pa.array(nth),
                ],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return stored(map_arrow(picked, kernel, schema), "pieces")


def _greedy(left: np.ndarray, gap: int) -> tuple[dict[int, int], int]:
    """The longest piece that fits, again and again: copies by length, and the gap that stays."""
    taken: dict[int, int] = {}
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        longest = int(fits[-1])
        copies = min(int(left[longest]), gap // longest)
        left[longest] -= copies
        taken[longest] = copies
        gap -= copies * longest
    return taken, gap


def _tighter(left: np.ndarray, room: int, than: int) -> tuple[int, int] | None:
    """Two pieces of the largest sum within ``room`` and above ``than``; the longer one longest."""
    fits = np.flatnonzero(left[: room + 1])
    if not len(fits):
        return None
    longest = np.zeros(room + 1, np.int64)
    longest[fits] = fits
    np.maximum.accumulate(longest, out=longest)
    # The partner is the longest piece that fits beside the first and is not longer than it; the
    # next shorter one if the first is the last of its length.
    limit = np.minimum(room - fits, fits)
    limit -= (limit == fits) & (left[fits] < 2)
    other = longest[np.maximum(limit, 0)]
    total = np.where(other > 0, fits + other, 0)
    best = int(total.max())
    if best <= than:
        return None
    at = int(np.flatnonzero(total == best)[-1])
    return int(fits[at]), int(other[at])


def plan(counts: np.ndarray) -> list[Run]:
    """Best-two-fit over ``counts[length]`` pieces of each length up to ``len(counts) - 1``."""
    left, size, runs = counts.astype(np.int64), len(counts) - 1, []
    left[0] = 0
    while left.any():
        trial = left.copy()
        bin_, gap = _greedy(trial, size)
        looked = dict(bin_)
        smallest = min(bin_)
        pair = _tighter(trial, gap + smallest, smallest) if gap else None
        if pair:
            bin_[smallest] -= 1
            for length in pair:
                bin_[length] = bin_.get(length, 0) + 1
        used = {length: n for length, n in bin_.items() if n}
        times = min((int(left[l]) - max(n, looked.get(l, 0))) // n + 1 for l, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
        runs.append(Run(times, tuple(sorted(used.items(), reverse=True))))
    return runs


def places(runs: list[Run]) -> np.ndarray:
    """Rows (length, first number, copies, first bin, offset), sorted: where numbered pieces go."""
    rows, used, base = [], {}, 0
    for run in runs:
        at = 0
        for length, copies in run.parts:
            rows.append((length, used.get(length, 0), copies, base, at))
            used[length] = used.get(length, 0) + run.times * copies
            at += length * copies
        base += run.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(table: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces numbered within their length."""
    begin = np.searchsorted(table[:, 0], length, "left")
    low, high = begin, np.searchsorted(table[:, 0], length, "right")
    while np.any(high - low > 1):  # the last row of the length that starts at or before the number
        middle = (low + high) // 2
        right = (high - low > 1) & (table[np.minimum(middle, len(table) - 1), 1] <= number)
        shut = (high - low > 1) & ~right
        low, high = np.where(right, middle, low), np.where(shut, middle, high)
    first, copies, base, at = (table[low, c] for c in (1, 2, 3, 4))
    past = number - first
    return base + past // copies, at + past % copies * length


def pack(
    docs: DataFrame, file: str, rank_file: str | None = None, options: Packing = Packing(),
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences are numbered from 0 without gaps.
    """
    cut = pieces(docs, file, rank_file, options, id_column, text)
    kind = cut.schema["id"].dataType.simpleString()
    sums = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sums.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    counts = np.zeros(options.size + 1, np.int64)
    for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    table = places(plan(counts))
    numbered = cut.join(
        broadcast_if_small(starts.select(F.col("part").alias("p"), F.col("length").alias("l"), "before")),
        (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")),
    ).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))

    def kernel(batches):
        for batch in batches:
            where, offset = _place(table, batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(where), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(numbered, kernel, schema).withColumnRenamed("id", id_column)
