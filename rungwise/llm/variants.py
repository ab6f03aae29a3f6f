"""Spelling variants by a bit-sliced position index (operator 12).

Words of a block are laid out bit by bit: for every (position, letter) one bitset over the block
holds the words with that letter there. All words of the block then run through a recurrence on
whole bitsets at once. It tracks, letter by letter, the words without an error so far, those with
one replaced letter (same position), and those with one letter more (positions shifted by one):

    exact'    = exact & B[i][letter]
    replaced' = (replaced & B[i][letter]) | (exact & ~B[i][letter])
    longer'   = (longer | exact) & B[i+1][letter]

A shorter near word finds the longer one, so a shift the other way is not needed.

Blocks: of two near words with the shorter one of L letters, cut at fixed places into parts, all
parts but the one with the edit are equal. So words are dealt to one block for each part, keyed by L
and the other letters, once as the shorter and once as the longer word of a pair. Blocks start with
two parts; one of more than ``block_words`` words (counted first) is dealt again with its part cut
in two, and so on down to single letters, where the alphabet bounds a block. No block is a task's
or the driver's burden and no pair is missed. A pair counts in the one block whose part holds the
first letter after the common prefix, so blocks return counts and best words, not pairs.

Defined cases: null and empty texts hold no words; a null document id counts as an empty id text;
repeated rows count as often as they occur; letters are A-Z, a-z and U+00C0 to U+00FF, only A-Z are
lower-cased; ties for the form go to the word that is smallest by code points; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import broadcast_if_small, map_arrow, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: A task hands on its counts when it holds so many words or letters.
HELD_WORDS, HELD_LETTERS = 1 << 18, 1 << 24
#: Blocks are packed into one index up to so many words (and letters).
PACK_WORDS, PACK_LETTERS = 1024, 1 << 22


@dataclass(frozen=True)
class Spelling:
    min_letters: int = 7
    min_count: int = 2
    #: A form is so many times as frequent as its variant.
    factor: int = 10
    #: If this divides the crc32 of "id:run", the run loses a letter; 0 keeps all runs whole.
    drop_every: int = 31
    block_words: int = 4096


def words_of(doc_id, text: str, options: Spelling) -> Counter:
    """Occurrences of the words of one text."""
    found: Counter = Counter()
    head = b"" if doc_id is None else str(doc_id).encode()
    for run, n in Counter(RUN.findall(text)).items():
        if len(run) < options.min_letters:
            continue
        run = run.translate(_UPPER)
        if options.drop_every:
            h = zlib.crc32(head + b":" + run.encode())
            if h % options.drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < options.min_letters:
                    continue
        found[run] += n
    return found


def vocabulary(docs: DataFrame, options: Spelling = Spelling(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of the documents, stored. Counts are added up in the tasks first."""
    picked = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"))

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
        )

    def kernel(batches):
        held, letters = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.update(words_of(doc_id, text, options))
                    letters += len(text)
                if len(held) >= HELD_WORDS or (letters >= HELD_LETTERS and sum(map(len, held)) >= HELD_LETTERS):
                    yield batch_of(held)
                    held, letters = Counter(), 0
                elif letters >= HELD_LETTERS:
                    letters = 0
        yield batch_of(held)

    counted = map_arrow(picked, kernel, "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= options.min_count), "words")


def _dealt(rows: DataFrame, parts: Column) -> DataFrame:
    """One row per part of ``parts`` (array of its bounds in a word of ``short`` letters) and word."""
    over = F.length("word") - F.col("short")
    return (
        rows.withColumn("part", F.explode(parts))
        .withColumn("lo", F.col("part.lo").cast("int"))
        .withColumn("hi", F.col("part.hi").cast("int"))
        .withColumn(
            "key",
            F.xxhash64("short", "lo", "hi", F.expr("substring(word, 1, lo)"), F.substring("word", F.col("hi") + 1 + over, F.length("word"))),
        )
        .select("key", "short", "lo", "hi", "word", "n")
    )


def _halves(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2)
    return F.array(
        F.struct(lo.cast("long").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.cast("long").alias("hi"))
    )


def blocks(words: DataFrame, options: Spelling = Spelling()) -> list[DataFrame]:
    """Tables (key, short, lo, hi, word, n) of blocks of words that may be near, largest parts first."""
    size = F.length("word")
    rows = words.withColumn("short", F.explode(F.array(size - 1, size))).where(F.col("short") >= options.min_letters)
    rows = _dealt(rows, _halves(F.lit(0), F.col("short")))
    out = []
    while True:
        rows = stored(rows, "blocks")
        counts = rows.groupBy("key", "short", "lo", "hi").agg(F.count(F.lit(1)).alias("k"))
        # A part of one letter cannot be cut; the alphabet bounds its blocks.
        hot = stored(counts.where(f"k > {options.block_words} and hi - lo > 1").select("key", "short", "lo", "hi"), "large")
        if hot.isEmpty():
            return [*out, rows]
        small = broadcast_if_small(hot)
        out.append(rows.join(small, ["key", "short", "lo", "hi"], "left_anti"))
        rows = rows.join(small, ["key", "short", "lo", "hi"], "left_semi").drop("key")
        rows = _dealt(rows.withColumnsRenamed({"lo": "from", "hi": "to"}), _halves(F.col("from"), F.col("to")))


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)]).view(np.uint64)


def near_pairs(letters: np.ndarray, lengths: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of words with one edit between them, i of ``short`` letters.

    j has as many letters (a letter replaced; both orders come) or one more. ``letters`` holds one
    byte per letter, 0 beyond a word's end.
    """
    asks = np.flatnonzero(lengths == short)
    if not len(asks):
        return asks, asks
    lines = letters[asks]
    slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sets(position: int, wanted: np.ndarray) -> np.ndarray:
        """The bitset of every asked letter at a position."""
        if position not in slices:
            column = letters[:, position]
            alphabet = np.unique(column)
            rank = np.full(256, len(alphabet))
            rank[alphabet] = np.arange(len(alphabet))
            table = _bits(np.vstack([column == c for c in alphabet] + [np.zeros(len(column), bool)]))
            slices[position] = rank, table
        rank, table = slices[position]
        return table[rank[wanted]]

    exact = np.repeat(_bits(np.ones((1, len(letters)), bool)), len(asks), 0)
    replaced, longer = np.zeros_like(exact), np.zeros_like(exact)
    for i in range(short):
        here, ahead = sets(i, lines[:, i]), sets(i + 1, lines[:, i])
        longer = (longer | exact) & ahead
        replaced = (replaced & here) | (exact & ~here)
        exact &= here
        del slices[i]
    longer |= exact
    same, more = _bits((lengths == short)[None]), _bits((lengths == short + 1)[None])
    found = (replaced & same) | (longer & more)
    i, word = np.nonzero(found)
    flags = np.unpackbits(found[i, word][:, None].view(np.uint8), axis=1, bitorder="little")
    at, bit = np.nonzero(flags)
    return asks[i[at]], word[at] * 64 + bit


def _common(letters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Letters that two words have in common at the start."""
    same = np.zeros(len(i), np.int64)
    step = max(1, PACK_LETTERS // letters.shape[1])
    for at in range(0, len(i), step):
        differ = letters[i[at : at + step]] != letters[j[at : at + step]]
        same[at : at + step] = differ.argmax(1)
    return same


def compare(batch: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words of whole blocks with one ``short`` length."""
    short = batch.column("short")[0].as_py()
    words = batch.column("word").to_pylist()
    lengths = np.array([len(w) for w in words])
    width = short + 2  # room for the longer words and one position ahead
    letters = np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    key, lo, hi, n = (batch.column(c).to_numpy() for c in ("key", "lo", "hi", "n"))
    i, j = near_pairs(letters, lengths, short)
    kept = (key[i] == key[j]) & (lo[i] == lo[j]) & (hi[i] == hi[j])
    i, j = i[kept], j[kept]
    first = _common(letters, i, j)
    kept = (lo[i] <= first) & ((first < hi[i]) | ((first == short) & (hi[i] == short)))
    i, j = i[kept], j[kept]
    back = lengths[j] > short
    i, j = np.concatenate([i, j[back]]), np.concatenate([j, i[back]])
    # Latin-1 bytes order as code points do.
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[j], -n[j], i))
    word, start, count = np.unique(i[order], return_index=True, return_counts=True)
    best = j[order][start]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[k] for k in word], pa.string()), pa.array(count, pa.int64()),
            pa.array(n[best], pa.int64()), pa.array([words[k] for k in best], pa.string()),
        ],
        names=["word", "n_near", "best_n", "best"],
    )


def _packs(batches):
    """Tables of whole blocks of one length from sorted batches of rows."""
    held, rows, letters, last = [], 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(c).to_numpy() for c in ("short", "lo", "hi", "key")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([m[1:] != m[:-1] for m in marks], axis=0)
        new[0] = last is not None and any(m[0] != x for m, x in zip(marks, last, strict=True))
        begin = 0
        for at in np.flatnonzero(new):
            full = rows + at - begin >= PACK_WORDS or letters + (at - begin) * marks[0][at - 1] >= PACK_LETTERS
            if full or (marks[0][at] != (marks[0][at - 1] if at else last[0])):
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, rows, letters, begin = [], 0, 0, at
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
            rows += batch.num_rows - begin
            letters += (batch.num_rows - begin) * int(marks[0][-1])
        last = [m[-1] for m in marks]
    if held:
        yield pa.Table.from_batches(held)


def near(words: DataFrame, options: Spelling = Spelling()) -> DataFrame:
    """(word, n_near, best_n, best) of every word with near words; ``best`` is the most frequent."""

    def kernel(batches):
        for pack in _packs(batches):
            yield compare(pack)

    found = None
    for rows in blocks(words, options):
        dealt = rows.repartition("key").sortWithinPartitions("short", "lo", "hi", "key")
        part = map_arrow(dealt, kernel, "word string, n_near long, best_n long, best string")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("x")
    ).select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.w").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form reached. A form is ``factor`` times as frequent,
    so a chain is as long as the logarithm of the largest count."""
    at = links.select("word", F.col("form").alias("at"))
    step = links.select(F.col("word").alias("w"), F.col("form").alias("next"))
    done = None
    while True:
        at = stored(at.join(step, F.col("at") == F.col("w"), "left").select("word", "at", "next"), "roots")
        ended = at.where("next is null").select("word", F.col("at").alias("root"))
        done = ended if done is None else done.unionByName(ended)
        at = at.where("next is not null").select("word", F.col("next").alias("at"))
        if at.isEmpty():
            return done


def group(docs: DataFrame, options: Spelling = Spelling(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = vocabulary(docs, options, id_column, text)
    close = words.join(near(words, options), "word", "left").withColumn(
        "is_form", F.coalesce(F.col("best_n") >= options.factor * F.col("n"), F.lit(False))
    )
    close = stored(
        close.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("is_form"), F.col("best")).alias("form"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n"),
        ),
        "near",
    )
    led = roots(close.where("form is not null").select("word", "form"))
    return close.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
