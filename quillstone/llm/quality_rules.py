"""Quality rules as a learned decision list.

Statistics of each whole text come from flat numpy arrays. Sequential covering
learns from labelled statistics: a rule is grown condition by condition
(attribute <= or > threshold) on two thirds of what is not covered yet, pruned
from its end on the other third, and kept while it is right often enough. The
list then is one ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, inside_text, mix, per_text, slices, span_hashes, text_bytes, window_hashes

#: The symbols counted.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_bare_marks", "n_same")
#: What rules may test: a name, and its numerator and denominator.
ATTRIBUTES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "bare_marks_per_word": ("n_bare_marks", "n_words"),
    "same_as_last": ("n_same", "n_words"),
}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _UPPER, _MARK, _DIGIT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"!?"), _table(b"0123456789")


def text_counts(column: pa.Array, start: int, end: int) -> dict[str, np.ndarray]:
    """COUNTS of the texts column[start:end] (large_binary)."""
    w = Words(column, start, end)
    raw, off = w.raw, w.offsets
    n = w.counts()
    out = {"n_words": n, "word_chars": per_text(w.inside & ((raw & 0xC0) != 0x80), off)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK), ("n_digits", _DIGIT)):
        out[name] = per_text(table[raw], off)
    bare = (w.ends - w.starts == 1) & (_SYMBOL[raw[w.starts]] > 0) if len(w) else np.zeros(0, bool)
    out["n_bare_marks"] = per_text(bare, w.first)
    # lines: those with a word, less the distinct ones
    breaks = np.flatnonzero(raw == 10)
    line_start, line_end = np.sort(np.append(off[:-1], breaks + 1)), np.sort(np.append(off[1:], breaks))
    words_before = np.searchsorted(w.starts, np.stack([line_start, line_end]))
    has = words_before[0] < words_before[1]
    line_start, line_end = line_start[has], line_end[has]
    text = np.searchsorted(off, line_start, "right") - 1
    out["n_dup_lines"] = np.bincount(text, minlength=len(n)) - _distinct(text, span_hashes(raw, line_start, line_end), len(n))
    # five-word windows met twice or more in their text
    words, doc = w.hashes(), w.doc_of()
    same = np.zeros(len(w), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out["n_same"] = per_text(same, w.first)
    windows = window_hashes(words, 5)
    again = np.zeros(len(w), bool)
    if len(windows):
        at = np.flatnonzero(inside_text(w.first, 5))
        key = mix(windows[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.append(same, False) | np.append(False, same)]]
        for k in range(5):
            again[twice + k] = True
    out["n_repeat_words"] = per_text(again, w.first)
    return out


def _distinct(text: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))[: len(t)]
    return np.bincount(t[new], minlength=n)


def with_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns and COUNTS of each text; a null text counts as an empty one."""
    kept = df.select(*keep, df[text].alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = text_bytes(batch.column(batch.num_columns - 1))
        parts = [text_counts(column, a, b) for a, b in slices(column)]
        counts = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], names=[*batch.schema.names[:-1], *COUNTS])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return arrow_map(kept, run, ", ".join([*types, *(f"{c} bigint" for c in COUNTS)]))


@dataclass(frozen=True)
class Rule:
    """A row that meets every (attribute, "<=" or ">", threshold) is rejected."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    right: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.conditions:
            out = out & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, value in self.conditions:
            out &= x[name] <= value if sign == "<=" else x[name] > value
        return out


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """FOIL's gain of going from p0 of p0 + n0 to p of p + n."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    rule: list[tuple[str, str, float]] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and bad[live].any() and not bad[live].all():
        p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
        best = (1e-9, None)
        for name in x:
            v, b = x[name][live], bad[live]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
            mid = (v[cut] + v[cut + 1]) / 2
            for sign, g in (("<=", _gain(p, n, p0, n0)), (">", _gain(p0 - p, n0 - n, p0, n0))):
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), (name, sign, float(mid[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= Rule((best[1],), 0, 0).holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least: int = 2) -> list[Rule]:
    """Sequential covering of the bad rows; no rows or no bad ones: no rules.

    A rule stays if, over all rows not yet covered, it covers least bad ones or
    more at this precision or better. The first that does not ends the list.
    """
    x = {k: np.asarray(v, float) for k, v in x.items()}
    bad, rules = np.asarray(bad, bool), []
    rng = np.random.default_rng(seed)
    open_ = np.ones(len(bad), bool)
    while len(rules) < most_rules and bad[open_].sum() >= least:
        at = rng.permutation(np.flatnonzero(open_))
        grow, prune = at[: len(at) * 2 // 3], at[len(at) * 2 // 3 :]
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        if not conditions:
            break

        def worth(k: int, conditions=conditions, prune=prune) -> float:
            hit = Rule(tuple(conditions[:k]), 0, 0).holds({c: v[prune] for c, v in x.items()})
            p, n = int(bad[prune][hit].sum()), int((~bad[prune][hit]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        hit = Rule(tuple(conditions[:keep]), 0, 0).holds(x) & open_
        rule = Rule(tuple(conditions[:keep]), int(hit.sum()), int(bad[hit].sum()))
        if rule.right < least or rule.right < precision * rule.covered:
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def attributes(df: DataFrame) -> DataFrame:
    """df with ATTRIBUTES; 0 where the denominator is 0."""
    return df.withColumns({k: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0)) for k, (n, d) in ATTRIBUTES.items()})


def verdict(rules: list[Rule]) -> Column:
    """The first rule that a row meets, from 1; 0: none."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The labels of at most rows documents, the same ones on every run (by a hash of the id), one for each id."""
    ids = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("__label"))
    ids = ids.orderBy(F.xxhash64(doc_id), doc_id).limit(rows)  # bounded: it may be broadcast
    return docs.join(F.broadcast(ids), doc_id)


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = 20_000, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> list[Rule]:
    """Learn on a sample of at most rows labelled documents (label 0: bad); their counts come to the driver, nothing else."""
    sample = labelled_sample(docs.select(doc_id, text), labels.select(doc_id, label), rows, doc_id, label)
    sample = sample.groupBy(doc_id).agg(F.min(text).alias(text), F.min("__label").alias("__label"))  # an id that repeats counts once, with the least of its texts
    table = attributes(with_counts(sample, text, ("__label",)).where("n_words > 0")).select("__label", *ATTRIBUTES).toPandas()
    table = table.sort_values(list(table.columns))  # the order of arrival does not count
    return learn({k: table[k].to_numpy() for k in ATTRIBUTES}, table["__label"].to_numpy() == 0)


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns, COUNTS, ATTRIBUTES, base_failed, rule (the first met; 0: none) and kept.

    A null or empty text has no words, so it fails the base test. Other columns
    are left out, so theirs may have any name; equal rows give equal rows.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = attributes(with_counts(docs, text, keep)).withColumns({"base_failed": base, "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
