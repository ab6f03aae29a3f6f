"""Quality rules: counts of a text, and its divergence from language references (operator 6).

References are gathered over all documents: per language the shares of character classes, and the
shares of its commonest words with the rest as one more share. A text's own shares are compared
with every language's by the Jensen-Shannon distance (square root of the divergence, base 2); the
smallest over the languages counts, so a wrong language tag does no harm. A comparison is made only
for texts long enough to have shares at all (``minimum_chars``, ``minimum_words``).

A language has a reference of its own only with enough words, so that a few rows cannot vouch for
themselves: ``language_words`` or a thousandth of all words, whichever is less, and a ten-thousandth
of all words in any case (so there are at most 10,000). The others are pooled into one reference, if
they have as many together. The distance alone says little of texts that hold no common word at all,
as the rest is most of a reference, too: a text's share of common words must also reach
``min_common`` of the reference's for one language, among those that let ``expected_common`` of them
be expected in a text of that length.

Scale: the first pass counts inside the tasks (the table of words is emptied whenever it reaches
``FLUSH`` entries, and sums meet in a shuffle), the second is a scan with the references of all
languages, 112 rows each, as a broadcast list of packed groups of ``group_languages``. A text is
compared with one group after the other; beyond ``HELD_GROUPS`` a task unpacks one at a time. The
driver collects references up to ``collected_rows``, counted first, and reads more in partitions.

Defined cases: null and empty texts have all counts 0, fail the base rule and are not kept; null
languages count as a language of their own called ''; repeated rows count as often as they occur;
ties between common words go to the smaller word; an empty table gives no rows; without any
reference the verdict is the base rule alone; other columns are ignored by ``judge``.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from rungwise.llm.common import map_arrow, stored

# The symbols of the base counts.
SYMBOLS = "#*$%&|<>"

CLASSES = (
    "vowel", "consonant", "upper", "digit", "space", "newline", "stop", "quote", "symbol", "other_ascii", "latin", "wide",
)
FLUSH = 200_000
#: The name under which languages of few words are pooled.
POOLED = "\uffff"
#: Texts of fewer words fail the base rule; the word comparison starts where that ends.
BASE_WORDS = 50
#: A task keeps at most so many groups of languages unpacked.
HELD_GROUPS = 8


@dataclass(frozen=True)
class Rules:
    common_words: int = 100
    group_languages: int = 64
    collected_rows: int = 200_000
    minimum_chars: int = 200
    minimum_words: int = BASE_WORDS
    max_char_distance: float = 0.3
    max_word_distance: float = 0.55
    language_words: int = 50_000
    min_common: float = 0.3
    expected_common: float = 8.0


def class_table() -> np.ndarray:
    """Class of each code point below 592; all later ones are ``wide``."""
    out = np.full(592, CLASSES.index("latin"), np.uint8)
    for i in range(128):
        c = chr(i)
        out[i] = CLASSES.index(
            "vowel" if c in "aeiouy" else "consonant" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit()
            else "newline" if c == "\n" else "space" if c in " \t\r\x0b\x0c" else "stop" if c in ".,;:!?" else "quote" if c in "'\"()-"
            else "symbol" if c in SYMBOLS else "other_ascii"
        )
    return out


TABLE = class_table()
_SPACE, _NEWLINE, _SYMBOL = (CLASSES.index(c) for c in ("space", "newline", "symbol"))


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = points[points < len(TABLE)]
    out = np.bincount(TABLE[small], minlength=len(CLASSES)).astype(np.int64)
    out[-1] += len(points) - len(small)
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    kinds = len(seen)
    if kinds == n:
        return 0
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    _, where, often = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    many = often[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= many
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def base_counts(text: str, words: list[bytes], classes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = int(classes.sum() - classes[_SPACE] - classes[_NEWLINE])
    return len(words), chars, int(classes[_SYMBOL]), duplicate_lines(text), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < BASE_WORDS or 100 * n_repeat_words > 50 * n_words


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, key, n, total): counts of the classes and of the commonest words per language
    of enough words, and of all others together."""
    picked = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))

    def kernel(batches):
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def emptied():
            rows = [(a, "word", w.decode(), n) for a, held in words.items() for w, n in held.items()]
            rows += [(a, "class", CLASSES[i], int(n)) for a, v in classes.items() for i, n in enumerate(v) if n]
            words.clear()
            classes.clear()
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "kind", "key", "n"])

        for batch in batches:
            for a, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x:
                    words.setdefault(a, Counter()).update(x.lower().encode().split())
                    classes[a] = classes.get(a, 0) + class_counts(x)
                    if sum(map(len, words.values())) > FLUSH:
                        yield emptied()
        yield emptied()

    counts = (
        map_arrow(picked, kernel, "lang string, kind string, key string, n long")
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    counts = voting(stored(counts, "language-counts"), rules)
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    # Only the best rows of each partition reach the window (the planner limits groups early).
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    top = counts.withColumn("place", place).where(F.col("place") <= rules.common_words).drop("place")
    return top.join(totals, ["lang", "kind"])


def voting(counts: DataFrame, rules: Rules) -> DataFrame:
    """``counts`` with the languages of too few words under one name, or without them if they have
    too few together."""
    mass = counts.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("mass"))
    every = mass.agg(F.sum("mass")).first()[0] or 0
    bar = max(min(rules.language_words, every / 1000), every / 10_000)
    own = mass.where(F.col("mass") >= bar).select("lang", F.lit(True).alias("votes"))
    # At most 10,000 languages reach a ten-thousandth of all words.
    named = counts.join(F.broadcast(own), "lang", "left")
    merged = (
        named.withColumn("lang", F.when(F.col("votes"), F.col("lang")).otherwise(F.lit(POOLED)))
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    pooled = mass.where(F.col("mass") < bar).agg(F.sum("mass")).first()[0] or 0
    return merged if pooled >= bar else merged.where(F.col("lang") != POOLED)


@dataclass
class Model:
    """References of some languages as arrays: classes (languages x classes), words (languages x
    words and the rest)."""

    classes: np.ndarray
    vocabulary: dict[bytes, int]
    members: list[np.ndarray]
    words: list[np.ndarray]


def models(found: DataFrame, rules: Rules) -> Iterator[Model]:
    """The references of every language that has words, ``group_languages`` at a time."""
    if found.count() <= rules.collected_rows:
        rows = iter(sorted(found.collect(), key=lambda r: r.lang))
    else:
        rows = found.orderBy("lang").toLocalIterator()
    held: list[list[Row]] = []
    for _, mine in groupby(rows, key=lambda r: r.lang):
        mine = list(mine)
        if any(r.kind == "word" for r in mine):
            held.append(mine)
        if len(held) == rules.group_languages:
            yield model(held)
            held = []
    if held:
        yield model(held)


def model(languages: list[list[Row]]) -> Model:
    """One group from the rows of each of its languages."""
    classes = np.zeros((len(languages), len(CLASSES)))
    vocabulary: dict[bytes, int] = {}
    members, words = [], []
    for i, rows in enumerate(languages):
        mine = sorted((r for r in rows if r.kind == "word"), key=lambda r: (-r.n, r.key))
        for r in (r for r in rows if r.kind == "class"):
            classes[i, CLASSES.index(r.key)] = r.n / r.total
        members.append(np.array([vocabulary.setdefault(r.key.encode(), len(vocabulary)) for r in mine], np.int64))
        shares = np.array([r.n for r in mine], float) / mine[0].total
        words.append(np.append(shares, max(0.0, 1 - shares.sum())))
    return Model(classes, vocabulary, members, words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``, between 0 and 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def distances(
    known: Model, classes: np.ndarray, counts: np.ndarray, rules: Rules = Rules()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest character and word distance of each text over the languages, and the largest ratio
    of its share of common words to the reference's (-1 where no language lets enough be expected).

    ``classes``: texts x classes; ``counts``: texts x (vocabulary and the rest).
    """
    n = len(classes)
    if not known.words or not n:
        return np.zeros(n), np.zeros(n), np.full(n, -1.0)
    shares = classes / np.maximum(1, classes.sum(1, keepdims=True))
    total = np.maximum(1, counts.sum(1, keepdims=True))
    by_char, by_word, common = np.ones(n), np.ones(n), np.full(n, -1.0)
    for i, member in enumerate(known.members):
        by_char = np.minimum(by_char, js_distance(shares, known.classes[i]))
        mine = counts[:, member] / total
        held, wanted = mine.sum(1), 1 - known.words[i][-1]
        mine = np.concatenate([mine, np.maximum(0, 1 - held)[:, None]], 1)
        by_word = np.minimum(by_word, js_distance(mine, known.words[i]))
        told = total[:, 0] * wanted >= rules.expected_common
        common = np.where(told, np.maximum(common, held / max(wanted, 1e-12)), common)
    return by_char, by_word, common


def judge(
    docs: DataFrame, known: Iterator[Model], rules: Rules = Rules(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, the base counts, base_failed, kept, char_distance, word_distance,
    common_ratio (these null where the text is too short to compare)."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, char_distance double, word_distance double, common_ratio double"
    step = 256

    packed = docs.sparkSession.sparkContext.broadcast([pickle.dumps(m) for m in known])

    def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        base, classes = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(CLASSES)))
        for i, x in enumerate(texts):
            x = x or ""
            classes[i] = own = class_counts(x)
            base[i] = base_counts(x, x.encode().split(), own)
        return base, classes

    def compared(texts: list[str | None], base: np.ndarray, classes: np.ndarray, group: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, rest = group.vocabulary, len(group.vocabulary)
        counts = np.zeros((len(texts), rest + 1))
        for i in np.flatnonzero(base[:, 0] >= rules.minimum_words):
            counts[i] = np.bincount([place.get(w, rest) for w in texts[i].lower().encode().split()], minlength=rest + 1)
        return distances(group, classes, counts, rules)

    def judged(ids: pa.Array, base: np.ndarray, classes: np.ndarray, by_char: np.ndarray, by_word: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
        failed = np.array([base_failed(int(r[0]), int(r[4])) for r in base], bool)
        long_c, long_w = classes.sum(1) >= rules.minimum_chars, base[:, 0] >= rules.minimum_words
        far = (long_c & (by_char > rules.max_char_distance)) | (long_w & (by_word > rules.max_word_distance))
        told = long_w & (common >= 0)
        far |= told & (common < rules.min_common)
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & ~far),
             pa.array(by_char, mask=~long_c), pa.array(by_word, mask=~long_w), pa.array(common, mask=~told)],
            names=["id", *names, "base_failed", "kept", "char_distance", "word_distance", "common_ratio"],
        )

    def kernel(batches):
        blobs = packed.value
        held = [pickle.loads(b) for b in blobs] if len(blobs) <= HELD_GROUPS else None
        for batch in batches:
            starts = range(0, batch.num_rows, step)
            found = [counted(batch.column(1).slice(at, step).to_pylist()) for at in starts]
            # Without any reference all distances are 0.
            far = 1.0 if blobs else 0.0
            near = [np.stack([np.full(len(base), x) for x in (far, far, -1.0)]) for base, _ in found]
            for group in held if held is not None else map(pickle.loads, blobs):
                for k, at in enumerate(starts):
                    texts = batch.column(1).slice(at, step).to_pylist()
                    by_char, by_word, common = compared(texts, *found[k], group)
                    near[k] = np.stack([np.minimum(near[k][0], by_char), np.minimum(near[k][1], by_word), np.maximum(near[k][2], common)])
            for k, at in enumerate(starts):
                yield judged(batch.column(0).slice(at, step), *found[k], *near[k])

    return map_arrow(picked, kernel, schema).withColumnRenamed("id", id_column)


def assess(
    docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """References over all documents, then every document against them."""
    found = stored(references(docs, rules, text, lang), "references")
    return judge(docs, models(found, rules), rules, id_column, text)
