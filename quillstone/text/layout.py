"""HTML to ordered blocks: headings, paragraphs, tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import row_by_row

BLOCK_TAGS = frozenset("address article aside blockquote body center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section ul br".split())
HIDDEN = frozenset(("script", "style", "head", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MOST_HEADING = 200


def fold(s: str) -> str:
    return re.sub(r"\s+", " ", s.replace(" ", " ")).strip()


class _Layout(HTMLParser):
    """Inline text gathers; a block tag ends it. A table is one block with its grid of cells; tables within it add to no grid."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.text: list[str] = []
        self.bold_chars = self.chars = 0
        self.stack: list[tuple[str, bool]] = []
        self.hidden = 0
        self.heading = 0
        self.tables = 0
        self.grid: list[list[str]] = []
        self.cell: list[str] | None = None

    def flush(self) -> None:
        s = fold("".join(self.text))
        if s:
            bold = self.chars > 0 and self.bold_chars >= self.chars
            kind = "heading" if is_heading(s, self.heading > 0, bold) else "para"
            self.blocks.append({"kind": kind, "text": s, "rows": None})
        self.text, self.bold_chars, self.chars = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.flush()
                self.grid = []
        elif self.tables == 1 and tag == "tr":
            self.grid.append([])
        elif self.tables == 1 and tag in ("td", "th"):
            if not self.grid:
                self.grid.append([])
            self.cell = []
        elif not self.tables and tag in BLOCK_TAGS:
            self.flush()
        if tag in VOID:
            return
        style = (dict(attrs).get("style") or "").lower()
        weight = re.search(r"font-weight:\s*(bold|[6-9]00)", style)
        self.stack.append((tag, tag in ("b", "strong") or bool(weight)))
        if re.fullmatch("h[1-6]", tag):
            self.heading += 1

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "table" and self.tables:
            if self.tables == 1:
                self._end_table()
            self.tables -= 1
        elif self.tables == 1 and tag in ("td", "th") and self.cell is not None:
            self.grid[-1].append(fold("".join(self.cell)))
            self.cell = None
        elif not self.tables and tag in BLOCK_TAGS:
            self.flush()
        if re.fullmatch("h[1-6]", tag) and self.heading:
            self.heading -= 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if self.hidden:
            return
        if self.tables:
            if self.tables == 1 and self.cell is not None:
                self.cell.append(data)
            return
        self.text.append(data)
        n = len(data.strip())
        self.chars += n
        if any(b for _, b in self.stack):
            self.bold_chars += n

    def _end_table(self) -> None:
        if self.cell is not None:
            self.grid[-1].append(fold("".join(self.cell)))
            self.cell = None
        captions, rows = [], []
        for row in map(compact_row, self.grid):
            if len(row) == 1 and not rows:
                captions.append(row[0])
            elif row:
                rows.append(row)
        if rows:
            self.blocks.append({"kind": "table", "text": fold(" ".join(" ".join(r) for r in rows)), "rows": rows, "captions": captions})
        else:
            self.blocks += [{"kind": "para", "text": c, "rows": None} for c in captions]
        self.grid = []

    def close(self):
        super().close()
        if self.tables:
            self._end_table()
        self.flush()


def is_heading(s: str, in_heading: bool, bold: bool) -> bool:
    """Up to 200 characters, and in a heading tag, all bold or all capitals."""
    capitals = len(s) >= 4 and s == s.upper() and re.search("[A-Z]", s) is not None
    return len(s) <= MOST_HEADING and (in_heading or bold or capitals)


def compact_row(cells: list[str]) -> list[str]:
    """Cells that hold only '$' or '(' join the next one, only ')' or '%' the one before; empty ones go."""
    out, lead = [], ""
    for c in cells:
        if c in ("$", "(", "($", "$("):
            lead += c
        elif c and re.fullmatch(r"[)%]+", c) and out:
            out[-1] += c
        elif c:
            out.append(lead + c)
            lead = ""
    return out


def is_data(row: list[str]) -> bool:
    """A row with a number past its first cell."""
    return any(re.search(r"\d", c) and not re.fullmatch(r"(19|20)\d\d", c) for c in row[1:])


def table_markdown(rows: list[list[str]], captions: list[str] = ()) -> str:
    """Captions, at most three header rows joined by column, a rule, and the data rows."""
    width = max(map(len, rows))
    n = 0
    while n < min(3, len(rows)) and not is_data(rows[n]):
        n += 1
    head = [""] * width
    for row in rows[:n]:
        pad = [""] * (width - len(row)) + row  # short header rows stand over the last columns
        head = [fold(f"{a} {b}") for a, b in zip(head, pad, strict=True)]
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([*captions, line(head), "|" + " --- |" * width, *map(line, rows[n:])])


def layout(html: str | None) -> list[dict]:
    """Blocks in order: kind (heading, para, table), text, markdown."""
    p = _Layout()
    p.feed(html or "")
    p.close()
    for b in p.blocks:
        b["markdown"] = table_markdown(b["rows"], b.get("captions", [])) if b["kind"] == "table" else ("## " if b["kind"] == "heading" else "") + b["text"]
    return p.blocks


def markdown_blocks(text: str | None) -> list[dict]:
    """Paragraphs of a markdown text; tables whole; short NOTE, ITEM or capital lines are headings."""
    out = []
    for part in re.split(r"\n\s*\n", text or ""):
        s = part.strip()
        if not s:
            continue
        if s.startswith("|") or "\n|" in s:
            out.append({"kind": "table", "text": fold(s.replace("|", " ")), "markdown": s})
        else:
            head = len(s) < MOST_HEADING and (re.match(r"(?i)(note|item)\s+\d", s) is not None or s.startswith("#") or (s == s.upper() and re.search("[A-Z]", s) is not None))
            out.append({"kind": "heading" if head else "para", "text": fold(s.lstrip("# ")), "markdown": s})
    return out


def blocks(pages: DataFrame, key: list[str], html: str, markdown: bool = False) -> DataFrame:
    """A row for each block of each document: key, ordinal, kind, text, markdown. One pass, no shuffle."""
    make = markdown_blocks if markdown else layout
    fields = pages.select(*key).schema.fields
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    kinds = {"ordinal": pa.int32(), "kind": pa.string(), "text": pa.string(), "markdown": pa.string()}

    def rows(html: str | None, *_) -> Iterator[tuple]:
        return ((i, b["kind"], b["text"], b["markdown"]) for i, b in enumerate(make(html)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from row_by_row(batch, rows, kinds)

    return pages.select(*key, F.col(html)).mapInArrow(run, f"{types}, ordinal int, kind string, text string, markdown string")
