"""The part of a chunk that answers a query; short descriptions."""

from __future__ import annotations

import re

from .tokens import estimate, head

# What a full stop may follow without ending a sentence.
ABBREVIATIONS = "Inc Corp Co Ltd LLC LP L.P PLC plc S.A N.V A.G Pte Pty U.S U.K No vs etc approx f/k/a d/b/a".split()


def terms_of(query: str) -> list[str]:
    parts = (t.strip(".,%$-") for t in re.split(r"[^a-z0-9.,%$-]+", query.lower()))
    return [t for t in parts if len(t) > 2]


def _weight(line: str, terms: list[str]) -> int:
    low = line.lower()
    return sum((3 if any(c.isdigit() for c in t) else 1) for t in terms if t in low)


def _table_top(lines: list[str], at: int) -> tuple[int, list[str]] | None:
    """For a line of a table: where its grid starts, and its caption (up to three lines) and header."""
    if not lines[at].startswith("|"):
        return None
    top = at
    while top and lines[top - 1].startswith("|"):
        top -= 1
    rule = next((i for i in range(top, at + 1) if re.fullmatch(r"\|[\s|-]*---[\s|-]*\|?", lines[i])), None)
    if rule is None:
        return None
    first = top
    while first and top - first < 3 and lines[first - 1].strip() and not lines[first - 1].startswith("|"):
        first -= 1
    return top, lines[first : rule + 1]


def snippet(text: str, query: str, most: int = 500) -> tuple[str, bool]:
    """The window around the best three lines (terms with digits count threefold) within the budget, under its table's header if it starts inside one; and whether that header was put before it."""
    lines, terms = text.split("\n"), terms_of(query)
    weights = [_weight(line, terms) for line in lines]
    sums = [sum(weights[i : i + 3]) for i in range(len(lines))]
    best = max(range(len(lines)), key=lambda i: (sums[i], -i))
    if sums[best] <= 0:
        return head(text, most), False
    table = _table_top(lines, best)
    top, header = table or (0, [])
    budget = max(50, most - estimate("\n".join(header)))
    cost = [estimate(line) for line in lines]
    lo = hi = best
    used = cost[best]
    forward = True
    blocked = 0
    while used < budget and blocked < 2:
        nxt = hi + 1 if forward else lo - 1
        possible = nxt < len(lines) if forward else nxt >= (top if table else 0)
        if possible:
            if used + cost[nxt] > budget:
                break
            used += cost[nxt]
            lo, hi = (lo, nxt) if forward else (nxt, hi)
            blocked = 0
        else:
            blocked += 1
        forward = not forward
    body = "\n".join(lines[lo : hi + 1])
    above = bool(header) and lo > top
    return head("\n".join([*header, body]) if above else body, most), above


def summary(text: str | None, most: int = 300) -> str | None:
    """One or two sentences; abbreviations end none; cut at `most` characters with an ellipsis."""
    clean = re.sub(r"\s+", " ", text or "").strip()
    if not clean:
        return None
    ends = []
    for m in re.finditer(r"[.!?](?= |$)", clean):
        before = clean[ends[-1] if ends else 0 : m.start()]
        if m[0] == "." and re.search(rf"(?<!\w)(?:{'|'.join(map(re.escape, ABBREVIATIONS))})$", before):
            continue
        if ends and m.end() > most:
            break
        ends.append(m.end())
        if len(ends) == 2:
            break
    out = clean[: ends[-1]] if ends else clean
    return out if len(out) <= most else out[: most - 1].rstrip() + "…"
