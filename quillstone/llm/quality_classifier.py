"""Positive-unlabelled quality classifier.

Features of a whole text are shares of bytes and of byte classes, gathered with
numpy. The model is linear and minimises the non-negative unbiased risk
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with the logistic loss, from trusted
positives and unlabelled texts. pi, the share of positives among the unlabelled, is
estimated from those two alone (best-bin estimation: the least ratio, with its
error bound, of the unlabelled's to the positives' share above a score's threshold,
for scores that tell the two apart and that were learnt on other rows). No label
but the trusted positives' is looked at. The model is fitted on a bounded sample on
the driver, and its weights (a few KB) go to the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, text_bytes
from .quality_rules import text_counts

#: Rows that the model is fitted on, at most: trusted positives, and unlabelled texts.
POSITIVES, UNLABELLED = 6_000, 12_000
_RATES = 10
WIDTH = 256 + _RATES


def features(column: pa.Array, start: int, end: int) -> np.ndarray:
    """A row of WIDTH features for each text: root shares of its bytes, and rates; an empty text: zeros."""
    n = end - start
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, (column.offset + start) * 8)
    size = np.diff(offsets)
    raw = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if size.sum() else np.zeros(0, np.uint8)
    shares = np.bincount(np.repeat(np.arange(n) << 8, size) + raw, minlength=n << 8).reshape(n, 256) / np.maximum(size, 1)[:, None]
    c = text_counts(column, start, end)
    words = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["word_chars"], 1)
    rates = [
        np.minimum(c["n_symbols"] / words, 3),
        np.minimum(c["n_marks"] / words, 3),
        np.minimum(c["n_bare_marks"] / words, 1),
        c["n_repeat_words"] / words,
        c["n_same"] / words,
        np.minimum(c["n_dup_lines"] / words * 10, 1),
        c["n_upper"] / chars,
        c["n_digits"] / chars,
        np.minimum(c["word_chars"] / words, 20) / 10,
        np.minimum(np.log1p(c["n_words"]), 10) / 10,
    ]
    return np.concatenate([np.sqrt(shares), np.stack(rates, 1)], 1).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The least, over thresholds, of the unlabelled's share above one over the positives', where its confidence bound is least."""
    bound = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    at = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), at, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at, "left") / len(unlabelled)
    k = int(np.argmin((u + bound) / p))
    return float(u[k] / p[k])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, kept within 0.02 and 0.98; 0.5 where there are too few rows to tell.

    Rows of each half are scored by a model that tells positives from unlabelled ones of the other half.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    found = []
    for k in (0, 1):
        p, u = positive[k::2], unlabelled[k::2]
        model = _descend(p, u, lambda sp, su: ((sp - 1) / len(sp), su / len(su)), 0.0, 150, 0.05, max(1e-3, 3 / len(p)))  # noqa: B023
        found.append(best_bin(model.score(positive[1 - k :: 2]), model.score(unlabelled[1 - k :: 2])))
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Full-batch Adam on the non-negative risk; where its negative part falls below 0, that part alone is raised again.

    Weights decay by `decay`, or by more where positives are few (3 over their number).
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), np.zeros(WIDTH), 0.0, prior)

    def slopes(sp: np.ndarray, su: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the risk by each row's z, from the rows' scores."""
        tiny = 1e-12
        negative = -np.log(1 - su + tiny).mean() + prior * np.log(1 - sp + tiny).mean()
        if negative >= 0:
            return prior * (sp - 1) / len(sp) - prior * sp / len(sp), su / len(su)
        return prior * sp / len(sp), -su / len(su)

    model = _descend(positive, unlabelled, slopes, float(np.log(prior / (1 - prior))), steps, rate, max(decay, 3 / len(positive)))
    return Model(model.mean, model.scale, model.weights, model.bias, prior)


def _descend(positive: np.ndarray, unlabelled: np.ndarray, slopes, bias: float, steps: int, rate: float, decay: float) -> Model:
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-2
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w, b = np.zeros(WIDTH), bias
    m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w.astype(np.float32) + b, u @ w.astype(np.float32) + b
        dp, du = slopes(1 / (1 + np.exp(-zp.astype(np.float64))), 1 / (1 + np.exp(-zu.astype(np.float64))))
        g = np.append(dp.astype(np.float32) @ p + du.astype(np.float32) @ u + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, float(b), 0.5)


def _rows(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """Features of the documents of these (bounded) ids, on the driver, in an order that does not depend on their arrival.

    An id that repeats counts once, with the least of its texts, so rows are bounded as ids are.
    """
    df = docs.select(doc_id, text).join(F.broadcast(ids), doc_id, "left_semi").groupBy(doc_id).agg(F.min(text).alias(text))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = text_bytes(batch.column(0))
        rows = [r.tobytes() for a, b in slices(column) for r in features(column, a, b)]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    got = sorted(bytes(r.x) for r in arrow_map(df.select(text), run, "x binary").toLocalIterator())
    return np.frombuffer(b"".join(got), np.float32).reshape(len(got), WIDTH)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", learn_from=None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """learn_from: a condition on doc_id for the rows whose labels (and texts) may be used; None: all.

    At most positives trusted rows (label 1) and unlabelled rows are used, those
    first by a hash of the id; labels of the unlabelled are not looked at. Without
    positives, or without any text, every score is 0.5.
    """
    ok = F.lit(True) if learn_from is None else learn_from
    trusted = labels.select(doc_id, label).where(ok & F.col(doc_id).isNotNull() & (F.col(label) == 1)).select(doc_id).distinct()
    p = _rows(docs, trusted.orderBy(F.xxhash64(doc_id), doc_id).limit(positives), doc_id, text)
    web = docs.select(doc_id).where(ok & F.col(doc_id).isNotNull()).orderBy(F.xxhash64(F.lit(1), doc_id), doc_id).limit(unlabelled).distinct()
    u = _rows(docs, web, doc_id, text)
    return fit(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The keep columns and the score (0 to 1, higher: better) of each whole text.

    A null text counts as an empty one, which has a score too. Columns not in keep
    are left out; equal rows give equal rows.
    """
    kept = df = docs.select(*keep, docs[text].alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = text_bytes(batch.column(batch.num_columns - 1))
        values = np.concatenate([model.score(features(column, a, b)) for a, b in slices(column)])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], names=[*batch.schema.names[:-1], name])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return arrow_map(df, run, f"{types}, {name} double")


def reject_low_quality(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs (all columns, whatever their names) without the rows that score below least."""
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc"), F.col(text).alias("__t"))
    return score(whole, model, "__t", ("__doc",), "__quality").where(F.col("__quality") >= least).select("__doc.*")
