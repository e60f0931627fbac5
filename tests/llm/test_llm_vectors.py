"""Codes of vectors and hard negatives against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from quillstone.llm import common, hard_negatives, vector_codes
from quillstone.llm.vectors import limit
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id long, n long"
INF, NAN = float("inf"), float("nan")


def rows(n: int, width: int, seed: int, spread: float = 0.4, copies: int = 3):
    rng = random.Random(seed)
    some = [[round(rng.uniform(-spread, spread), 2) for _ in range(width)] for _ in range(max(n // copies, 1))]
    return [(i, rng.choice(some), rng.choice([0, 1, 1, 1, 2, None]), "x", -i, i) for i in range(n)]


def odd(width: int):
    ok = [0.25] * width
    return [
        (1000, None, 1, None, None, None), (1001, [NAN] + ok[1:], 1, "a", 1, 1), (1002, [None] + ok[1:], 1, "a", 1, 1), (1003, [INF] + ok[1:], 2, "a", 1, 1), (1004, [-INF] + ok[1:], 2, "a", 1, 1),
        (1005, [], 1, "a", 1, 1), (1006, ok + ok, 1, "a", 1, 1), (None, ok, 1, "a", 1, 1), (1007, ok, None, "a", 1, 1), (1008, ok, 2, "a", 1, 1), (1008, ok, 2, "a", 1, 1), (1050, [1e30] + ok[1:], 1, "a", 1, 1),
    ]


def whole_numbers(v, width):
    top = limit(width)
    return [max(-top, min(top, math.floor(256 * float(np.float32(x))))) for x in v]


def kept(data, width):
    return [r for r in data if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def codes(data, width, parts, entries, rounds):
    """By the definition, in whole numbers."""
    data = sorted(kept(data, width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [whole_numbers(r[1], width) for r in data]
    w = width // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            of = {}
            for v in cut:
                of.setdefault(near(p, v[p])[1], []).append(v[p])
            for e, xs in of.items():
                new[p][e] = [sum(x) // len(xs) for x in zip(*xs)]
        books = new
    out = []
    for r, v in zip(data, cut):
        best = [near(p, v[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), r[2]))
    by_label = {}
    for _, _, d, label in out:
        by_label[label] = by_label.get(label, 0) + d
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((a, b, c, by_label[d]) for a, b, c, d in out), key=str), digest


@pytest.mark.parametrize("n,sent", [(90, 1 << 20), (90, 0), (5, 1 << 20), (0, 1 << 20)])
def test_codes(spark, monkeypatch, n, sent):
    """sent 0: the errors by label are shuffled, not sent."""
    monkeypatch.setattr(common, "SENT_VALUES", sent)
    data = rows(n, 8, n) + (odd(8) if n else [])
    got, books = vector_codes.compress(spark.createDataFrame(data, SCHEMA), parts=4, entries=6, rounds=2)
    want, digest = codes(data, 8, 4, 6, 2)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=str) == want
    assert (books.sha256() if books else hashlib.sha256(b"").hexdigest()) == digest


def test_only_odd_vectors_and_odd_lengths(spark):
    got, books = vector_codes.compress(spark.createDataFrame([r for r in odd(8) if r[0] in (1000, 1001, 1002, 1003, 1005)] + [(7, [0.5] * 6, 1, "a", 1, 1)], SCHEMA), parts=4)
    assert books is None and got.columns == ["vec_id", "label", "code", "error", "label_error"] and not got.collect()


@pytest.mark.parametrize("top", [3, 300, 5000, 1 << 20, 1 << 27])
def test_screening_is_exact(top):
    """Large components are rounded in float32; the nearest entry is the exact one all the same, and float32 alone is not enough."""
    rng = np.random.default_rng(top)
    entries = rng.integers(-top, top + 1, (4, 64, 4))
    entries[:, 32:] = entries[:, :32] + rng.integers(-1, 2, (4, 32, 4))  # near ties, and ties
    entries[:, 40] = entries[:, 7]
    books = vector_codes.Codebooks(entries)
    cut = entries[:, rng.integers(0, 64, 3000)] + rng.integers(-2, 3, (4, 3000, 4))
    gap = cut[:, :, None, :] - entries[:, None, :, :]
    want = (gap * gap).sum(3).argmin(2)
    assert (books.nearest(cut) == want).all()
    scores, radius = books.screened(cut)
    exact = (entries * entries).sum(2)[:, None, :] - 2 * np.einsum("prw,pew->pre", cut, entries)
    assert (np.abs(scores.astype(np.float64) - exact) <= radius[:, :, None]).all()
    if top >= 1 << 20:
        assert (scores.argmin(2) != want).any()


def negatives(data, width, anchor, k, m, lower, upper):
    one = {}
    for r in kept(data, width):
        if r[0] is not None and r[2] is not None:
            one[r[0]] = min(one.get(r[0], (r[2], r[1])), (r[2], r[1]))
    v = {i: (label, whole_numbers(x, width)) for i, (label, x) in one.items()}
    out = []
    for a in (i for i in v if anchor(i)):
        score = {i: sum(x * y for x, y in zip(v[a][1], c)) for i, (_, c) in v.items()}
        order = sorted(v, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][0] == v[a][0] and i != a][:k]:
            hard = [i for i in order if v[i][0] != v[a][0] and lower * score[p] <= 100 * score[i] <= upper * score[p]][:m]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,block,big", [(160, 1 << 15, False), (160, 7, False), (60, 7, True), (0, 7, False)])
def test_negatives(spark, monkeypatch, n, block, big):
    """Ties, copies, hot labels, scores beyond one number with the rank, and many blocks give what a plain sort gives."""
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    monkeypatch.setattr(hard_negatives, "TILE", 64)
    data = rows(n, 8, n + 1, 9e4 if big else 0.4) + (odd(8) if n else [])
    got = hard_negatives.mine(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 5 == 0, positives=4, negatives=3, lower=50, upper=95)
    want = negatives(data, 8, lambda i: i % 5 == 0, 4, 3, 50, 95)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want
    assert want or not n


def test_one_label_and_no_anchor(spark):
    df = spark.createDataFrame([(i, [0.5, float(i)], 1, "a", 1, 1) for i in range(20)], SCHEMA)
    assert not hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect()
    assert not hard_negatives.mine(df, F.col("vec_id") < 0).collect()


def test_limits_are_exact():
    p = np.array([-(10**15) - 7, -3, -1, 0, 1, 2, 19, 20, 21, 199, 10**15 + 7], np.int64)
    least, most = hard_negatives.limits(p, 50, 95)
    for x, a, b in zip(p.tolist(), least.tolist(), most.tolist(), strict=True):
        assert a == -((-50 * x) // 100) and b == (95 * x) // 100
