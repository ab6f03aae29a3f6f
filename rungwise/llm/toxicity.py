"""Toxic passages by maximum-scoring segments (operator 9).

Words (runs of letters, lower-cased) and their beginnings of 3 to 7 letters get log-odds between
toxic and clean labelled documents with an informative Dirichlet prior: pseudo-counts in the
proportions of both classes together, so rare ones stay near 0. A word that fewer than ``support``
learned documents hold gets the score of its longest beginning that has as many, so inflected and
compound forms of a stem count without having been seen. A constant drift makes an average clean
word negative. The linear-time scan of Ruzzo and Tompa returns every maximal scoring segment of a
text. Their scores follow an extreme value law with the decay ``rate`` that solves
sum p(w) exp(rate * s(w)) = 1 over clean words and a factor fitted to the best segments of clean
documents, so a segment gets an expected number of equally good ones by chance (E-value), and
segments below ``e_value`` are the significant ones. A text's evidence is the sum of -log10 E over
them, and -log10 E of its best segment, significant or not; a logistic curve over both, fitted to
labelled documents with equal weight of the classes, turns them into a probability.

Only rows that are not held out are learned from, at most ``rows`` labelled ones, those with the
smallest hash of their id, one row of each id; the table of words keeps the ``vocabulary`` ones
farthest from 0. All documents are then scored in one scan.

Defined cases: null and empty texts have no segment and get the probability of no evidence; an id
with several labels counts as toxic if at least half of them say so; null labels and ids are not
learned from; without labels of both classes every score is 0; of rows that repeat an id one is
learned from, that with the smallest hash of its text; ties between words go to the smaller word; an
empty table gives no rows; extra columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import held_out, map_arrow, stored

_LETTERS = regex.compile(r"\p{L}+")
FLUSH = 200_000
CACHE_WORDS = 300_000
#: Letters of the beginnings of words that are counted beside the words.
STEMS = range(3, 8)
#: Chance scores are counted in steps of 1 / SCORE_STEPS.
SCORE_STEPS = 50
#: -log10 E of a segment that says nothing.
NOTHING = -1.0


@dataclass(frozen=True)
class Training:
    rows: int = 20_000
    #: Weight of the Dirichlet prior, as a share of all words counted, and at least in words.
    prior_share: float = 0.03
    prior: float = 500.0
    vocabulary: int = 250_000
    drift: float = 1.0
    e_value: float = 0.1
    #: Words and beginnings of fewer documents have no score of their own.
    support: int = 6


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    rate: float = 1.0
    log_factor: float = 0.0
    e_value: float = 0.1
    curve: tuple[float, ...] | None = None
    #: Scores of words looked up before.
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def of(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= CACHE_WORDS:
                self.memo.clear()
            units = [word, *reversed(beginnings(word))]
            found = self.memo[word] = next((self.scores[u] for u in units if u in self.scores), 0.0)
        return found


def beginnings(word: str) -> list[str]:
    """The beginnings of a word that are shorter than it, marked by a sign that no word holds."""
    return [word[:n] + "+" for n in STEMS if n < len(word)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score), left to right (Ruzzo and Tompa)."""
    before = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    for k in np.flatnonzero(scores > 0):
        start, end, left, right = int(k), int(k) + 1, before[k], before[k + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(r - m)) for a, b, m, r in stack]


def spans(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text and where they stand."""
    found = list(_LETTERS.finditer(text)) if text else []
    return [m.group().lower() for m in found], [m.span() for m in found]


def word_scores(words: list[str], known: Model) -> np.ndarray:
    return np.array([known.of(w) for w in words]) - known.drift


def log_e(score: np.ndarray, n_words: int, known: Model) -> np.ndarray:
    """Natural log of the E-value of a segment's score in a text of ``n_words``."""
    return known.log_factor + np.log(max(n_words, 1)) - known.rate * score


def passages(words: list[str], known: Model) -> list[tuple[int, int, float, float]]:
    """The significant segments: (first word, past the last, score, log of the E-value)."""
    if not words or not known.scores:
        return []
    found = segments(word_scores(words, known))
    if not found:
        return []
    logs = log_e(np.array([s for *_, s in found]), len(words), known)
    return [(*f, float(e)) for f, e in zip(found, logs, strict=True) if e <= np.log(known.e_value)]


def evidence(words: list[str], known: Model) -> tuple[float, float]:
    """The sum of -log10 E over the significant segments, and -log10 E of the best segment, at least
    ``NOTHING``, which texts without a segment get."""
    found = segments(word_scores(words, known)) if words and known.scores else []
    if not found:
        return 0.0, NOTHING
    own = -log_e(np.array([s for *_, s in found]), len(words), known) / np.log(10)
    return float(own[own >= -np.log10(known.e_value)].sum()), float(max(NOTHING, own.max()))


def features(amount: np.ndarray, best: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(np.maximum(amount, 0)), np.clip(best, NOTHING, 6)], -1)


def probability(words: list[str], known: Model) -> float:
    if known.curve is None:
        return 0.0
    amount, best = evidence(words, known)
    x = known.curve[0] + features(np.array(amount), np.array(best)) @ np.array(known.curve[1:])
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def text_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def sample(docs: DataFrame, labels: DataFrame, options: Training, id_column: str, text: str) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled ids; written once, then read by each step."""
    chosen = (
        labels.where(F.col(id_column).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_column))
        .groupBy(F.col(id_column).alias("_id"))
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(options.rows)
    )
    rows = docs.join(F.broadcast(chosen), F.col(id_column) == F.col("_id"))
    rows = rows.select(F.col("_id").cast("string").alias("id"), F.col(text).alias("text"), F.col("_toxic").alias("toxic"))

    best = F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), "text"))
    return stored(rows.groupBy("id").agg(best.alias("row")).select("row.*"), "toxic-sample")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, clean, toxic): in how many sampled documents of each class a word or beginning occurs."""

    def kernel(batches):
        held = (Counter(), Counter())

        def emptied():
            words = sorted(held[0].keys() | held[1].keys())
            out = [pa.array(words, pa.string()), *(pa.array([h[w] for w in words], pa.int64()) for h in held)]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "clean", "toxic"])

        for batch in batches:
            for x, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(text_words(x))
                held[y].update(words.union(*map(beginnings, words)))
                if len(held[0]) + len(held[1]) > FLUSH:
                    yield emptied()
        yield emptied()

    counts = map_arrow(rows.select("text", "toxic"), kernel, "word string, clean long, toxic long")
    return counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(rows: DataFrame, options: Training = Training()) -> Model:
    """The model of the sampled rows. The driver gets the kept words and one number per document."""
    counts = stored(word_counts(rows), "toxic-words")
    n0, n1 = counts.where(~F.col("word").endswith("+")).agg(F.sum("clean"), F.sum("toxic")).first()
    if not n0 or not n1:
        return Model()
    a0 = max(float(options.prior), options.prior_share * (n0 + n1))
    alpha = a0 * (F.col("clean") + F.col("toxic")) / float(n0 + n1)
    odds = lambda y, n: F.log((y + alpha) / F.greatest(F.lit(0.5), n + a0 - y - alpha))
    delta = odds(F.col("toxic"), float(n1)) - odds(F.col("clean"), float(n0))
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    scored = counts.where(F.col("clean") + F.col("toxic") >= options.support).select("word", delta.alias("delta"), (delta / spread).alias("z"))
    # Shrink by certainty: a log-odds of less than its own error counts for little.
    kept = scored.orderBy(F.desc(F.abs("z")), "word").limit(options.vocabulary).collect()
    known = Model(
        {r.word: float(r.delta * r.z**2 / (r.z**2 + 4)) for r in kept}, options.drift, e_value=options.e_value
    )
    # The decay of chance scores over the words of clean documents.
    chance = score_counts(rows, known).collect()
    shares = np.array([r.n for r in chance], float)
    known.rate = decay(shares / max(1.0, shares.sum()), np.array([r.step for r in chance], float) / SCORE_STEPS)
    clean = best_segments(rows.where("toxic = 0"), known).collect()
    with np.errstate(under="ignore"):
        mass = sum(r.n_words * np.exp(-known.rate * r.best) for r in clean)
    known.log_factor = float(np.log(max(len(clean), 1) / max(mass, 1e-300)))
    found = amounts(rows, known).collect()
    x = features(np.array([r.amount for r in found]), np.array([r.best for r in found]))
    known.curve = curve(x, np.array([r.toxic for r in found], float))
    return known


def decay(shares: np.ndarray, values: np.ndarray) -> float:
    """The positive root of sum shares * exp(rate * values) = 1, or 1 if no value is positive."""
    if not (values[shares > 0] > 0).any() or shares @ values >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda t: np.log((shares * np.exp(np.minimum(t * values, 700))).sum())
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return float(high)


def score_counts(rows: DataFrame, known: Model) -> DataFrame:
    """(step, n): how often each score, less the drift, is that of a word of a clean document."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def kernel(batches):
        held: Counter = Counter()
        for batch in batches:
            for x in batch.column("text").to_pylist():
                words = text_words(x)
                if words:
                    steps, often = np.unique(np.rint(word_scores(words, shared.value) * SCORE_STEPS).astype(np.int64), return_counts=True)
                    held.update(dict(zip(steps.tolist(), often.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["step", "n"])

    counts = map_arrow(rows.where("toxic = 0").select("text"), kernel, "step long, n long")
    return counts.groupBy("step").agg(F.sum("n").alias("n")).orderBy("step")


def best_segments(rows: DataFrame, known: Model) -> DataFrame:
    """(n_words, best): words and best segment's score of each text that has words."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def kernel(batches):
        for batch in batches:
            texts = [w for w in map(text_words, batch.column("text").to_pylist()) if w]
            best = [max((s for *_, s in segments(word_scores(w, shared.value))), default=0.0) for w in texts]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, texts), pa.int64()), pa.array(best, pa.float64())], names=["n_words", "best"])

    return map_arrow(rows.select("text"), kernel, "n_words long, best double")


def amounts(rows: DataFrame, known: Model) -> DataFrame:
    """(toxic, amount, best) of each learned document."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def kernel(batches):
        for batch in batches:
            found = [evidence(text_words(x), shared.value) for x in batch.column("text").to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], names=["toxic", "amount", "best"])

    return map_arrow(rows.select("toxic", "text"), kernel, "toxic int, amount double, best double")


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Intercept and slopes of a logistic regression by damped Newton steps, the classes weighing
    the same and the slopes lightly penalised."""
    design = np.concatenate([np.ones((len(x), 1)), x], 1)
    weight = np.where(y == 1, 0.5 / max(1.0, (y == 1).sum()), 0.5 / max(1.0, (y == 0).sum())) * len(y)
    penalty = np.array([1e-3] + [ridge] * x.shape[1])
    loss = lambda w: weight @ (np.logaddexp(0, design @ w) - y * (design @ w)) + penalty @ w**2 / 2
    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (weight * (y - p)) - penalty * w
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty), gradient)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def find(docs: DataFrame, known: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, score, and its significant passages (start and end in code points,
    score, log10 of the E-value)."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log10_e", pa.float64())])

    def kernel(batches):
        own = shared.value
        for batch in batches:
            scores, all_found = [], []
            for x in batch.column(1).to_pylist():
                words = text_words(x)
                found = passages(words, own)
                scores.append(probability(words, own))
                if found:
                    places = spans(x)[1]
                    found = [
                        {"start": places[a][0], "end": places[min(b, len(places)) - 1][1], "score": s, "log10_e": e / np.log(10)}
                        for a, b, s, e in found if a < len(places)
                    ]
                all_found.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(all_found, pa.list_(passage))], names=["id", "score", "passages"]
            )

    schema = f"id {kind}, score double, passages array<struct<start:int,end:int,score:double,log10_e:double>>"
    return map_arrow(picked, kernel, schema).withColumnRenamed("id", id_column)


def score(
    docs: DataFrame, labels: DataFrame, options: Training = Training(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, held_out, score, predicted, passages."""
    known = fit(sample(docs, labels, options, id_column, text), options)
    found = find(docs, known, id_column, text)
    return found.select(
        id_column, held_out(id_column).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages",
    )


def keep_clean(
    docs: DataFrame, labels: DataFrame, options: Training = Training(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents not predicted toxic, with the columns of ``docs``; one scan, no join."""
    known = fit(sample(docs, labels, options, id_column, text), options)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def kernel(batches):
        own = shared.value
        for batch in batches:
            clean = [probability(text_words(x), own) < 0.5 for x in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, kernel, docs.schema)
