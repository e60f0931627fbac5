"""What a question about one dimension gets to read of a filing: routed sections, whole if they fit, else their most relevant parts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import paragraphs, water_fill

# The sections of each dimension in order, characters that a context may have, size of a part.
ROUTES = {
    "moatDurability": ("business", "risk-factors"),
    "ownerEarningsQuality": ("financial-statements", "mda"),
    "capitalAllocation": ("mda", "financial-statements"),
    "debtSustainability": ("financial-statements", "mda"),
    "insiderAlignment": ("proxy",),
    "cyclicalityAwareness": ("risk-factors", "mda"),
}
CEILING, PART = 100_000, 4_000
#: Characters that a task holds before they leave.
HELD = 1 << 24
ELIDED = "\n\n[… non-relevant content omitted …]"


def relevance(part: str, terms: tuple[str, ...]) -> float:
    """Sum over terms of 1 + ln(occurrences)."""
    low = part.lower()
    return sum(1 + math.log(n) for t in terms if (n := low.count(t)))


def _selected(text: str, terms: tuple[str, ...], part: int, whole: bool) -> tuple[list[str], list[int]]:
    parts = paragraphs(text, part)
    ranked = list(range(len(parts))) if whole else sorted(range(len(parts)), key=lambda i: (-relevance(parts[i], terms), i))
    return parts, ranked


def assemble(sources: list[tuple[str, str]], terms: tuple[str, ...], ceiling: int = CEILING, part: int = PART) -> str:
    """(name, text) of a few sections as one text under headings.

    All of it if it fits. Else a section of more than half the ceiling is cut into
    parts in order of relevance; the ceiling is shared out among the sections so
    that small ones are met in full, and each takes the parts that still fit, put
    back in the order of the text with marks where something is left out.
    """
    sources = [(n, t) for n, t in sources if t]
    if sum(len(t) for _, t in sources) <= ceiling:
        return "\n\n---\n\n".join(f"### {n} ({len(t):,} chars)\n\n{t}" for n, t in sources)
    cut = [(n, t, *_selected(t, terms, part, len(t) <= ceiling // 2)) for n, t in sources]
    sizes = [sum(map(len, parts)) for _, _, parts, _ in cut]
    shares = sizes if sum(sizes) <= ceiling else water_fill(sizes, ceiling)
    out = []
    for (name, text, parts, ranked), share in zip(cut, shares, strict=True):
        took, left = [], share
        for i in ranked:
            if len(parts[i]) <= left:
                took.append(i)
                left -= len(parts[i])
        body, last = "", -1
        for i in sorted(took):
            body += (ELIDED + "\n\n" if last >= 0 and i > last + 1 else "") + parts[i]
            last = i
        body += ELIDED if 0 <= last < len(parts) - 1 else ""
        if share > 0:
            note = f"{len(body):,} of {len(text):,} chars, selected" if len(body) < len(text) else f"{len(text):,} chars"
            out.append(f"### {name} ({note})\n\n{body}")
    return "\n\n---\n\n".join(out)


def routed(sections: list[dict], route: tuple[str, ...]) -> list[tuple[str, str]]:
    """(section, text) of one filing's sections that a route names or that these are bundled with, each at its first place; empty ones are left out."""
    place: dict[str, tuple[int, int]] = {}
    for at, name in enumerate(route):
        for x in sections:
            if x["section"] == name:
                for k, s in enumerate([name, *(x["bundled"] or [])]):
                    place[s] = min(place.get(s, (at, k)), (at, k))
    found = sorted((place[x["section"]], x["section"], x["text"]) for x in sections if x["section"] in place and x["section"] is not None and x["text"])
    return [(s, t) for _, s, t in found]


def contexts(sections: DataFrame, key: str, terms: dict[str, tuple[str, ...]], routes: dict[str, tuple[str, ...]] | None = None, ceiling: int = CEILING) -> DataFrame:
    """key, dimension, sources (the names used, joined) and context, for every key and dimension that has a routed section.

    sections: key, section, text, bundled (sections whose text stands in this one's
    place, or null). A routed section brings those it is bundled with; each counts
    once, at its first place. A filing has a few sections, which is what is gathered,
    once for all dimensions: a text is shuffled once. Rows without a key are left out.
    """
    routes = routes or ROUTES
    g = sections.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("section", "text", "bundled")).alias("__s"))

    def made(batch: pa.RecordBatch) -> Iterator[tuple[int, str, str, str]]:
        for i, filing in enumerate(batch.column("__s")):
            rows = filing.as_py()
            for dimension, route in routes.items():
                found = routed(rows, route)
                if found:
                    yield i, dimension, ", ".join(n for n, _ in found), assemble(found, terms.get(dimension, ()), ceiling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in made(batch):
                out.append(row)
                size += len(row[3])
                if size >= HELD:  # texts leave as they are made
                    yield _batch(batch, key, out)
                    out, size = [], 0
            if out:
                yield _batch(batch, key, out)

    kind = sections.schema[key].dataType.simpleString()
    return g.select(key, "__s").mapInArrow(run, f"`{key}` {kind}, dimension string, sources string, context string")


def _batch(batch: pa.RecordBatch, key: str, rows: list[tuple[int, str, str, str]]) -> pa.RecordBatch:
    at, dimension, sources, context = zip(*rows)
    return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), *(pa.array(c, pa.string()) for c in (dimension, sources, context))], names=[key, "dimension", "sources", "context"])
