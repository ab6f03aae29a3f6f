"""Personal data: exact patterns plus a character BiLSTM-CRF (operator 3).

``base_spans`` finds e-mail addresses, IPv4 addresses, card and phone numbers by the contract's
patterns, in time linear in the text. The tagger is a bidirectional LSTM over characters whose
outputs, with learned transitions, are decoded by a conditional random field. It is trained in
NumPy on windows of a bounded sample, labelled with the base spans, and adds spans of its own where
it is sure and no base span stands.

Every span of the tagger must hold a digit or an @, so text farther than ``CONTEXT`` characters
from one can only be tagged as nothing and is not fed to it. The rest is cut into windows that
overlap by half. Each window is decoded by itself; spans that touch a window's edge inside the text
are left to the neighbour, and the text's whole list is then reconciled at once by weighted interval
scheduling: the set of non-overlapping spans with the largest sum of lengths times certainties.

Defined cases: null and empty texts have no spans; without any text with a digit or an @ there is
nothing to train on and base spans are all; a text of any length is processed in windows, a batch of
them at a time; repeated rows are independent; ties in reconciling go to the earlier end; an empty
table gives no rows; extra columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Characters around a digit or an @ that the tagger sees.
CONTEXT = 40
WINDOW = 128
ANCHOR = re.compile(r"[0-9@]+")

# The contract's patterns. Possessive runs and the look-behind find the same leftmost
# matches without trying the rest of a run that has failed.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    if not text or not ANCHOR.search(text):
        return []
    out = [("email", *m) for m in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- windows ------------------------------------------------------------------------------------

PAD, OTHER_LETTER, OTHER = 0, 1, 2
SYMBOLS = 3 + 128
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k; 2 + 2k continues it


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = np.where((points >= 0xC0) & (points < 0x2000), OTHER_LETTER, OTHER)
    return np.where(points < 128, points + 3, wide)


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping (start, end) pieces of the text that lie near a digit or an @."""
    out, low, high = [], None, 0
    edges = [(max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)) for m in ANCHOR.finditer(text)]
    for a, b in [*edges, (None, None)]:
        if low is not None and (a is None or a > high):
            at = low
            while high - at > WINDOW:
                out.append((at, at + WINDOW))
                at += WINDOW // 2
            out.append((max(low, min(at, high - WINDOW)) if high - low > WINDOW else low, high))
            low = None
        if a is not None:
            low, high = (a, b) if low is None else (low, max(high, b))
    return out


def tags_of(size: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags, done = np.zeros(size, np.int8), 0
    for kind, a, b in spans:
        if a >= done:
            k = KINDS.index(kind)
            tags[a], tags[a + 1 : b], done = 1 + 2 * k, 2 + 2 * k, b
    return tags


# --- the tagger ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Training:
    windows: int = 2_000
    hidden: int = 16
    epochs: int = 8
    batch: int = 64
    rate: float = 0.04
    seed: int = 7
    certainty: float = 0.9


def forbidden() -> np.ndarray:
    """Penalty of transitions that would continue a span that has not begun."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for before in range(TAGS):
            if before not in (inside, inside - 1):
                out[before, inside] = -1e4
    return out


def start_weights(options: Training) -> dict[str, np.ndarray]:
    r, h = np.random.default_rng(options.seed), options.hidden
    p = {}
    for d in "fb":
        p["x" + d] = r.normal(0, 0.3, (SYMBOLS, 4 * h))
        p["x" + d][:, h : 2 * h] += 1.0  # remember by default
        p["h" + d] = r.normal(0, 0.3, (h, 4 * h))
    p["o"], p["ob"], p["t"] = r.normal(0, 0.3, (2 * h, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run_lstm(wx: np.ndarray, wh: np.ndarray, x: np.ndarray, live: np.ndarray, backwards: bool):
    """Hidden states (window, step, unit) of one direction, and what its gradient needs."""
    n, steps, h = x.shape[0], x.shape[1], wh.shape[0]
    hid, cell = np.zeros((n, h)), np.zeros((n, h))
    out, kept = np.zeros((n, steps, h)), [None] * steps
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        z = wx[x[:, t]] + hid @ wh
        ifo, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        i, f, o = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h :]
        new = f * cell + i * g
        tc = np.tanh(new)
        m = live[:, t, None]
        kept[t] = (hid, cell, i, f, o, g, tc)
        hid, cell = o * tc * m, new * m
        out[:, t] = hid
    return out, kept


def lstm_gradient(wx, wh, x, live, backwards, kept, dout):
    n, steps, h = x.shape[0], x.shape[1], wh.shape[0]
    dwx, dwh = np.zeros_like(wx), np.zeros_like(wh)
    dh, dc = np.zeros((n, h)), np.zeros((n, h))
    for t in range(steps) if backwards else range(steps - 1, -1, -1):
        hid, cell, i, f, o, g, tc = kept[t]
        m = live[:, t, None]
        dh = (dh + dout[:, t]) * m
        dn = dc * m + dh * o * (1 - tc * tc)
        dz = np.concatenate([dn * g * i * (1 - i), dn * cell * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - g * g)], 1)
        np.add.at(dwx, x[:, t], dz)
        dwh += hid.T @ dz
        dh, dc = dz @ wh.T, dn * f
    return dwx, dwh


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def crf_marginals(e: np.ndarray, t: np.ndarray, live: np.ndarray):
    """Log partition, tag marginals and expected transitions of each window (forward-backward)."""
    n, steps, k = e.shape
    alpha, beta = np.zeros((n, steps, k)), np.zeros((n, steps, k))
    alpha[:, 0] = e[:, 0]
    for s in range(1, steps):
        new = _log_sum(alpha[:, s - 1, :, None] + t, 1) + e[:, s]
        alpha[:, s] = np.where(live[:, s, None] > 0, new, alpha[:, s - 1])
    for s in range(steps - 2, -1, -1):
        new = _log_sum(t + (e[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
        beta[:, s] = np.where(live[:, s + 1, None] > 0, new, 0)
    z = _log_sum(alpha[:, -1], 1)
    marginals = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
    pairs = np.zeros((k, k))
    for s in range(1, steps):
        joint = alpha[:, s - 1, :, None] + t + (e[:, s] + beta[:, s])[:, None, :] - z[:, None, None]
        pairs += (np.exp(joint) * live[:, s, None, None]).sum(0)
    return z, marginals, pairs


def emissions(p: dict, x: np.ndarray, live: np.ndarray):
    f, kf = run_lstm(p["xf"], p["hf"], x, live, False)
    b, kb = run_lstm(p["xb"], p["hb"], x, live, True)
    both = np.concatenate([f, b], 2)
    return both @ p["o"] + p["ob"], both, kf, kb


def loss_and_gradient(p: dict, x: np.ndarray, live: np.ndarray, y: np.ndarray):
    e, both, kf, kb = emissions(p, x, live)
    t = p["t"] + forbidden()
    z, marginals, pairs = crf_marginals(e, t, live)
    n, steps = x.shape
    rows = np.arange(n)[:, None]
    gold = (e[rows, np.arange(steps), y] * live).sum() + (t[y[:, :-1], y[:, 1:]] * live[:, 1:]).sum()
    seen = np.zeros_like(pairs)
    np.add.at(seen, (y[:, :-1], y[:, 1:]), live[:, 1:])
    de = marginals
    de[rows, np.arange(steps), y] -= live
    de /= n
    h = p["hf"].shape[0]
    dboth = de @ p["o"].T
    g = {"o": np.einsum("ntd,ntk->dk", both, de), "ob": de.sum((0, 1)), "t": (pairs - seen) / n}
    g["xf"], g["hf"] = lstm_gradient(p["xf"], p["hf"], x, live, False, kf, dboth[:, :, :h])
    g["xb"], g["hb"] = lstm_gradient(p["xb"], p["hb"], x, live, True, kb, dboth[:, :, h:])
    return (z.sum() - gold) / n, g


def padded(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pieces))
    x, live = np.zeros((len(pieces), steps), np.int64), np.zeros((len(pieces), steps))
    for i, piece in enumerate(pieces):
        x[i, : len(piece)], live[i, : len(piece)] = piece, 1
    return x, live


def train(examples: list[tuple[str, np.ndarray]], options: Training = Training()) -> dict | None:
    """Weights from (text, tags) windows by Adam; None without examples."""
    if not examples:
        return None
    p = start_weights(options)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    data = [(coded(text), tags.astype(np.int64)) for text, tags in examples]
    order, step = np.random.default_rng(options.seed), 0
    for _ in range(options.epochs):
        places = order.permutation(len(data))
        for at in range(0, len(data), options.batch):
            chosen = [data[i] for i in places[at : at + options.batch]]
            x, live = padded([c for c, _ in chosen])
            y, _ = padded([t for _, t in chosen])
            _, g = loss_and_gradient(p, x, live, y)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= options.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def viterbi(e: np.ndarray, t: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    n, steps, _ = e.shape
    score, back = e[:, 0], np.zeros(e.shape, np.int64)
    finals = score.copy()
    for s in range(1, steps):
        each = score[:, :, None] + t
        back[:, s] = each.argmax(1)
        score = each.max(1) + e[:, s]
        finals = np.where((lengths > s)[:, None], score, finals)
    paths = []
    for i in range(n):
        path = np.zeros(lengths[i], np.int64)
        path[-1] = finals[i].argmax()
        for s in range(lengths[i] - 1, 0, -1):
            path[s - 1] = back[i, s, path[s]]
        paths.append(path)
    return paths


def runs(path: np.ndarray) -> list[tuple[str, int, int]]:
    out, s = [], 0
    while s < len(path):
        if path[s] == 0:
            s += 1
            continue
        kind, end = (path[s] - 1) // 2, s + 1
        while end < len(path) and path[end] == 2 + 2 * kind:
            end += 1
        out.append((KINDS[kind], s, end))
        s = end
    return out


def tagged(p: dict, pieces: list[np.ndarray]) -> list[list[tuple[str, int, int, float]]]:
    """Spans of each piece with their certainty: the mean marginal of their tags."""
    x, live = padded(pieces)
    e = emissions(p, x, live)[0]
    t = p["t"] + forbidden()
    marginals = crf_marginals(e, t, live)[1]
    out = []
    for i, path in enumerate(viterbi(e, t, live.sum(1).astype(np.int64))):
        sure = marginals[i, np.arange(len(path)), path]
        out.append([(k, a, b, float(sure[a:b].mean())) for k, a, b in runs(path)])
    return out


def reconciled(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The non-overlapping spans with the largest sum of length times certainty."""
    found = sorted(set(found), key=lambda s: (s[2], s[1], s[0]))
    ends = np.array([s[2] for s in found])
    best, chosen = [0.0], []
    for i, (_, a, b, sure) in enumerate(found):
        before = int(np.searchsorted(ends[:i], a, "right"))
        gain = best[before] + (b - a) * sure
        take = gain > best[i]
        chosen.append(before if take else None)
        best.append(gain if take else best[i])
    out, i = [], len(found)
    while i:
        if chosen[i - 1] is None:
            i -= 1
        else:
            out.append(found[i - 1])
            i = chosen[i - 1]
    return out[::-1]


def plausible(kind: str, span: str) -> bool:
    """Could the text be of its kind at all? Keeps, say, a number with a wrong checksum out."""
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "email":
        return span.count("@") == 1 and not span.startswith("@") and not span.endswith("@")
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:[.:][0-9]{1,3}){3}", span))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def added(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int, float]], least: float):
    """Sure and plausible spans of the tagger without line breaks that overlap no base span.

    Base spans of different kinds may overlap: they are joined to stretches, searched by halving."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(base, key=lambda x: x[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    out = []
    for kind, a, b, sure in found:
        if sure >= least and plausible(kind, text[a:b]) and "\n" not in text[a:b] and free(a, b):
            out.append((kind, a, b))
    return out


def all_spans(texts: list[str | None], p: dict | None, options: Training, batch: int = 256):
    """For each text (base spans, all spans). Windows of all texts are tagged ``batch`` at a time."""
    base = [base_spans(x) for x in texts]
    if p is None:
        return [(b, b) for b in base]
    held: list[list] = [[] for _ in texts]
    jobs: list[tuple[int, int, int]] = []

    def flush():
        pieces = [coded(texts[i][a:b]) for i, a, b in jobs]
        for (i, a, b), spans in zip(jobs, tagged(p, pieces), strict=True):
            for kind, s, e, sure in spans:
                whole_left, whole_right = s > 0 or a == 0, a + e < b or b == len(texts[i])
                if whole_left and whole_right:
                    held[i].append((kind, a + s, a + e, sure))
        jobs.clear()

    for i, x in enumerate(texts):
        for a, b in windows(x) if x else ():
            jobs.append((i, a, b))
            if len(jobs) >= batch:
                flush()
    if jobs:
        flush()
    out = []
    for x, b, h in zip(texts, base, held, strict=True):
        more = added(x, b, reconciled(h), options.certainty) if h else []
        out.append((b, sorted(b + more, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


# --- Spark --------------------------------------------------------------------------------------


def examples(docs: DataFrame, options: Training, id_column: str = "doc_id", text: str = "text") -> list:
    """At most ``windows`` labelled windows, those with the smallest hash of (id, place)."""
    picked = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"))

    def kernel(batches):
        for batch in batches:
            ids, starts, pieces, tags = [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x and ANCHOR.search(x):
                    marks = tags_of(len(x), base_spans(x))
                    for a, b in windows(x):
                        ids.append(i)
                        starts.append(a)
                        pieces.append(x[a:b])
                        tags.append(marks[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(starts, pa.int64()), pa.array(pieces, pa.string()), pa.array(tags, pa.binary())],
                names=["id", "start", "piece", "tags"],
            )

    found = map_arrow(picked, kernel, "id string, start long, piece string, tags binary")
    rows = found.orderBy(F.xxhash64("id", "start"), "id", "start", "piece").limit(options.windows).collect()
    return [(r.piece, np.frombuffer(bytes(r.tags), np.int8)) for r in rows]


def find(
    docs: DataFrame, weights: dict | None, options: Training = Training(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (all spans), n_added."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def kernel(batches):
        for batch in batches:
            found = all_spans(batch.column(1).to_pylist(), shared.value, options)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([joined(every) for _, every in found], pa.string())
            more = pa.array([len(every) - len(base) for base, every in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans, more], names=names)

    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_arrow(picked, kernel, schema).withColumnRenamed("id", id_column)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by <KIND> of the first."""
    out, at, end = [], 0, 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = end = max(end, b)
    return text if not spans else "".join([*out, text[at:]])


def mask(
    docs: DataFrame, options: Training = Training(), id_column: str = "doc_id", text: str = "text", length: str = "n_chars"
) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``length``, if there is such a column and
    a text is changed, counted anew."""
    weights = train(examples(docs, options, id_column, text), options)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at, size_at = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def kernel(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = [every for _, every in all_spans(texts, shared.value, options)]
            columns = list(batch.columns)
            new = [masked(x, s) for x, s in zip(texts, spans, strict=True)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size_at is not None:
                sizes = batch.column(size_at).to_pylist()
                columns[size_at] = pa.array([len(n) if s else old for n, s, old in zip(new, spans, sizes, strict=True)], batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, kernel, docs.schema)


def detect(docs: DataFrame, options: Training = Training(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the sample, then find personal data in every whole text."""
    return find(docs, train(examples(docs, options, id_column, text), options), options, id_column, text)
