from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from rungwise.llm import pii

TEXTS = [
    "mail a.b%c@x-y.co.uk, b@c and @d.e x@y..z q@@r.s a@b.c@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9999.1.1.1 12.34.56.78.",
    "4111 1111 1111 1111 4111111111111112 1-2-3 0000 0000 0000 4111-1111-1111-1111 5",
    "+1 (017) 555-7713 +12 +1234567890123456 +4.9.1.2.3.4.5.6.7. call +49 30 901820) ++1 234567890",
    "no data here",
    "+1 4111111111111111 and 10.0.0.1@host.example.com\n4111111111111111",
    "x" * 5000 + "@" + "y" * 5000 + ".z",
]


def slow(text):
    """The contract's patterns as they are written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == slow(text)


def test_base_spans_of_random_texts():
    r = np.random.default_rng(2)
    for _ in range(400):
        text = "".join(r.choice(list("ab@.+-() 0123456789\n%_é"), 60))
        assert pii.base_spans(text) == slow(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "+1" + " " * 400_000, "@" * 100_000, "1." * 200_000):
        pii.base_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_windows_cover_everything_near_an_anchor_and_overlap():
    text = "a" * 300 + "12@" + "b" * 500 + "9" * 400 + "c" * 100
    found = pii.windows(text)
    covered = set()
    for a, b in found:
        assert 0 <= a < b <= len(text) and b - a <= pii.WINDOW
        covered |= set(range(a, b))
    for m in pii.ANCHOR.finditer(text):
        assert set(range(max(0, m.start() - pii.CONTEXT), min(len(text), m.end() + pii.CONTEXT))) <= covered
    assert pii.windows("no anchor") == []


def test_gradient_of_the_tagger():
    p, r = pii.start_weights(pii.Training(hidden=3)), np.random.default_rng(1)
    x, live = pii.padded([r.integers(3, 131, 6), r.integers(3, 131, 9)])
    y, _ = pii.padded([np.array([0, 1, 2, 2, 0, 3]), np.array([0, 0, 5, 6, 6, 0, 0, 7, 8])])
    loss, g = pii.loss_and_gradient(p, x, live, y)
    for k in p:
        place = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        q = {a: b.copy() for a, b in p.items()}
        q[k][place] += 1e-5
        assert (pii.loss_and_gradient(q, x, live, y)[0] - loss) / 1e-5 == pytest.approx(g[k][place], rel=1e-3, abs=1e-5)


def test_reconciling_is_the_best_set_of_apart_spans():
    found = [("email", 0, 10, 0.9), ("ip", 5, 12, 0.99), ("card", 12, 20, 0.5), ("card", 12, 20, 0.5), ("phone", 9, 13, 0.99)]
    got = pii.reconciled(found)
    best, spans = 0, sorted(set(found))
    for mask in range(1 << len(spans)):
        some = [s for k, s in enumerate(spans) if mask >> k & 1]
        if all(a[2] <= b[1] or b[2] <= a[1] for a in some for b in some if a is not b):
            best = max(best, sum((s[2] - s[1]) * s[3] for s in some))
    assert sum((s[2] - s[1]) * s[3] for s in got) == pytest.approx(best)


def trained_rows(n=300):
    r = np.random.default_rng(0)
    rows = []
    for i in range(n):
        ip = ".".join(str(v) for v in r.integers(1, 255, 4))
        data = [f"u{i}@mail{i % 9}.example.com", ip, "4111111111111111", f"+1 (01{i % 10}) 555-{1000 + i}", f"version {i % 9}.0"][i % 5]
        rows.append((i, "some words before it " + data + " and some words after it", i, "x"))
    return rows


def test_tagger_learns_and_the_table_keeps_base_spans(spark):
    rows = trained_rows() + [(900, None, 0, "x"), (901, "", 0, "x"), (902, "words " * 40_000 + "b@c.de", 0, "x"), (0, "a@b.cd", 0, "x"), (None, "a@b.cd", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    options = pii.Training(windows=300)
    weights = pii.train(pii.examples(df, options), options)
    hit = total = 0
    for text, tags in pii.examples(df, options)[:200]:
        want = {(k, a, b) for k, a, b in pii.runs(tags.astype(np.int64))}
        got = {s[:3] for s in pii.tagged(weights, [pii.coded(text)])[0]}
        hit, total = hit + len(want & got), total + len(want)
    assert hit / total > 0.8
    got = pii.find(df, weights, options).collect()
    assert len(got) == len(rows)
    for (doc_id, text, *_), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id,))), strict=True):
        assert r.doc_id == doc_id
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        if doc_id in (0, None):
            continue
        base = slow(text or "")
        r = by_id[doc_id]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    hidden = {r.doc_id: r for r in pii.mask(df, options).collect()}
    assert hidden[902].text == "words " * 40_000 + "<EMAIL>" and hidden[902].n_chars == 240_007
    assert hidden[900].text is None and hidden[4].text == rows[4][1] and hidden[4].n_chars == 4


def test_no_example_at_all(spark):
    df = spark.createDataFrame([(1, "plain")], "doc_id long, text string")
    assert [(r.spans, r.n_added) for r in pii.detect(df).collect()] == [("", 0)]
    assert pii.detect(df.limit(0)).count() == 0 and pii.mask(df).collect()[0].text == "plain"


def test_added_spans_overlap_no_base_span():
    """Against comparing every span with every other; base spans of two kinds may overlap."""
    r = np.random.default_rng(5)
    text = "1" * 3000
    for _ in range(50):
        base = sorted(("ip", int(a), int(a + k)) for a, k in zip(r.integers(0, 2900, 30), r.integers(1, 60, 30)))
        found = [("phone", int(a), int(a + k), 1.0) for a, k in zip(r.integers(0, 2900, 90), r.integers(9, 15, 90))]
        want = [(k, a, b) for k, a, b, _ in found if not any(x < b and a < y for _, x, y in base)]
        assert pii.added(text, base, found, 0.5) == want
    many = [("ip", 20 * k, 20 * k + 10) for k in range(20_000)]
    near = [("phone", 20 * k + 10, 20 * k + 20, 1.0) for k in range(20_000)]
    assert len(pii.added("1" * 400_000, many, near, 0.5)) == 20_000
