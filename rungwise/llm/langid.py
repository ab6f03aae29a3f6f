"""Language identification by segmentation-marginalised unigrams (operator 4).

The pieces are those of a fixed public vocabulary (a SentencePiece file whose path is a parameter).
Each language has its own piece probabilities. A word's likelihood is the sum over all its
segmentations into pieces, found by the forward algorithm; a text's is the product over its words
(maximal runs of letters, lower-cased, with the vocabulary's word mark in front), as pieces never
span words. Probabilities are fitted by expectation maximisation (forward-backward expected piece
counts) on the words of a bounded, stratified sample of labelled rows: ``rows_per_language``, those
with the smallest hash of their id.

The kernel scores each distinct word of a task once, all languages at once, in NumPy over whole
groups of words; a text is then a weighted sum. The cache of words is emptied at ``CACHE_WORDS``.

Defined cases: text that is null or holds no letter gives ``und`` with score 0; rows with a null
language or an id held out are never learned from; no learned language gives ``und`` throughout;
words beyond ``MAX_WORD`` letters are scored in stretches of that length; letters outside the
vocabulary have a small fixed share; ties go to the smaller language code; repeated rows are
learned from as often as they are sampled; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungwise.llm.common import broadcast_if_small, held_out, map_arrow

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # the vocabulary's sign for the start of a word
MAX_WORD = 30
CACHE_WORDS = 200_000
_LETTERS = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Training:
    rows_per_language: int = 400
    max_languages: int = 256
    iterations: int = 3
    #: Pseudo-count spread over all pieces, in the proportions of all languages together.
    prior: float = 2000.0
    unknown: float = 1e-7


class Pieces:
    """The vocabulary as sorted 64-bit substring hashes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        hashes = np.array([self._hash(t) for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.longest = min(16, max(map(len, texts)))
        self.n = len(texts)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def grid(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Words in order of falling length as (order, lengths, spans); a span (start, end, rows,
        pieces) says which words hold which piece there."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        width = int(lengths[0])
        points = np.zeros((len(words), width), np.uint64)
        for row, i in enumerate(order):
            w = words[i]
            points[row, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        points += np.uint64(1)
        spans = []
        with np.errstate(over="ignore"):
            for start in range(width):
                h = np.zeros(len(words), np.uint64)
                for end in range(start + 1, min(width, start + self.longest) + 1):
                    alive = int(np.searchsorted(-lengths, -end, "right"))
                    if not alive:
                        break
                    h = h[:alive] * _BASE + points[:alive, end - 1]
                    place = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
                    rows = np.flatnonzero(self.hashes[place] == h)
                    if end == start + 1:
                        # Every single letter has a step, if only the unknown one.
                        pieces = np.where(self.hashes[place] == h, place, self.n)
                        spans.append((start, end, np.arange(alive), pieces))
                    elif len(rows):
                        spans.append((start, end, rows, place[rows]))
        return order, lengths, spans


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def stretches(word: str) -> list[str]:
    marked = MARK + word
    return [marked[i : i + MAX_WORD] for i in range(0, len(marked), MAX_WORD)]


def forward(grid, probabilities: np.ndarray) -> np.ndarray:
    """alpha[end, word, language]: summed probability of all segmentations of the first letters.

    ``probabilities`` has a row per piece and a last one for unknown letters.
    """
    order, lengths, spans = grid
    alpha = np.zeros((int(lengths[0]) + 1, len(order), probabilities.shape[1]))
    alpha[0] = 1
    for start, end, rows, found in spans:
        alpha[end, rows] += alpha[start, rows] * probabilities[found]
    return alpha


def word_scores(words: list[str], vocabulary: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    cut = [stretches(w) for w in words]
    flat = [s for c in cut for s in c]
    grid = vocabulary.grid(flat)
    order, lengths, _ = grid
    alpha = forward(grid, probabilities)
    out = np.empty((len(flat), probabilities.shape[1]))
    out[order] = np.log(np.maximum(alpha[lengths, np.arange(len(order))], 1e-300))
    if len(flat) == len(words):
        return out
    return np.add.reduceat(out, np.cumsum([0] + [len(c) for c in cut[:-1]]), axis=0)


def expected_counts(stretched: list[str], weights: np.ndarray, vocabulary: Pieces, share: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language's words (forward-backward), with a last unknown row."""
    out = np.zeros(vocabulary.n + 1)
    for at in range(0, len(stretched), 20_000):
        grid = vocabulary.grid(stretched[at : at + 20_000])
        order, lengths, spans = grid
        weight = weights[at : at + 20_000][order]
        alpha = forward(grid, share[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(len(order))] = 1
        total = np.maximum(alpha[lengths, np.arange(len(order))], 1e-300)
        # Spans come by start, so going backwards every beta[end] is complete when it is used.
        for start, end, rows, found in reversed(spans):
            step = share[found] * beta[end, rows]
            np.add.at(out, found, weight[rows] * alpha[start, rows] * step / total[rows])
            beta[start, rows] += step
    return out


def sample(docs: DataFrame, options: Training, id_column: str, text: str, lang: str) -> list[tuple[str, str]]:
    """(lang, text) of the sample: the rows with the smallest hash per language, fewer of each beyond
    ``max_languages`` languages but at least one. Ids alone pass through the first window, and only
    ``rows_per_language`` of each partition reach it."""
    ids = docs.where(F.col(lang).isNotNull() & ~held_out(id_column)).select(
        F.col(id_column).alias("_id"), F.col(lang).alias("_lang")
    )
    languages = ids.select("_lang").distinct().count()
    each = min(options.rows_per_language, max(1, options.rows_per_language * options.max_languages // max(1, languages)))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = ids.withColumn("_place", place).where(F.col("_place") <= each).select("_id", "_lang").distinct()
    rows = docs.join(broadcast_if_small(chosen), (F.col(id_column) == F.col("_id")) & (F.col(lang) == F.col("_lang")))
    # Repeated ids come back with all their rows.
    picked = rows.select("_id", "_lang", F.col(text).alias("_text")).withColumn("_place", place).where(F.col("_place") <= each)
    return [(r[0], r[1]) for r in picked.select("_lang", "_text", "_id").orderBy(F.xxhash64("_id"), "_id").collect() if r[1]]


@dataclass
class Model:
    languages: list[str]
    probabilities: np.ndarray
    prior: np.ndarray


def fit(rows: list[tuple[str, str]], vocabulary: Pieces, options: Training = Training()) -> Model:
    counts: dict[str, Counter] = {}
    docs = Counter()
    for lang, text in rows:
        found = words_of(text)
        if found:
            counts.setdefault(lang, Counter()).update(s for w in found for s in stretches(w))
            docs[lang] += 1
    languages = sorted(counts)
    held = {a: (sorted(counts[a]), np.array([counts[a][w] for w in sorted(counts[a])], float)) for a in languages}
    share = np.full(vocabulary.n + 1, 1 / (vocabulary.n + 1))
    shares = {a: share for a in languages}
    for _ in range(options.iterations):
        found = {a: expected_counts(*held[a], vocabulary, shares[a]) for a in languages}
        common = sum((c / max(c.sum(), 1) for c in found.values()), np.zeros(vocabulary.n + 1)) + 1e-6
        common /= common.sum()
        for a, c in found.items():
            c = c + options.prior * common
            c[-1] = 0
            shares[a] = np.append(c[:-1] / c.sum() * (1 - options.unknown), options.unknown)
    table = np.stack([shares[a] for a in languages], 1) if languages else np.zeros((vocabulary.n + 1, 0))
    prior = np.array([np.log(docs[a] / sum(docs.values())) for a in languages])
    return Model(languages, table, prior)


def predict(docs: DataFrame, known: Model, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (the posterior probability of lang_pred)."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((known.languages, known.probabilities, known.prior))

    def kernel(batches):
        languages, probabilities, prior = shared.value
        vocabulary = pieces(path)
        cache: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [words_of(x) for x in part.column(1).to_pylist()]
                if len(cache) > CACHE_WORDS:
                    cache, scores = {}, scores[:0]
                new = sorted({w for ws in texts for w in ws if w not in cache}, key=len) if languages else []
                for b in range(0, len(new), 8192):
                    group = new[b : b + 8192]
                    cache.update(zip(group, range(len(cache), len(cache) + len(group)), strict=True))
                    scores = np.concatenate([scores, word_scores(group, vocabulary, probabilities)])
                best, sure = [], []
                for ws in texts:
                    if not ws or not languages:
                        best.append("und")
                        sure.append(0.0)
                        continue
                    total = scores[[cache[w] for w in ws]].sum(0) + prior
                    k = int(total.argmax())
                    best.append(languages[k])
                    sure.append(float(1 / np.exp(np.maximum(total - total[k], -700)).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=["id", "lang_pred", "score"])

    return map_arrow(picked, kernel, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def identify(
    docs: DataFrame, options: Training = Training(), path: str | None = None,
    id_column: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Fit on the sample, predict every whole text: id, held_out, lang_pred, score."""
    path = path or public_tokenizers.path(VOCABULARY)
    known = fit(sample(docs, options, id_column, text, lang), pieces(path), options)
    found = predict(docs, known, path, id_column, text)
    return found.select(id_column, held_out(id_column).alias("held_out"), "lang_pred", "score")
