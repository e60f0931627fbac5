"""Secret scans with ownership frequency over the whole corpus.

A regular-expression pass finds candidates in every text. Hashes of the
candidates are then counted over all documents by distinct repositories and
owners: what many owners carry is a copied example, what one owner carries looks
live. Spans of the base kinds always stay; spans of the added kinds (PEM keys,
JSON web tokens, vendor tokens, credentials in URLs, bearer headers) join them
where their value is not a widely copied example.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialise

#: The base kinds in order, then the added ones; the group that holds the secret, and its least length.
KINDS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    # its lines (of 20 characters or more, the last of any length before the end mark), so that prose after a header is no key
    "pem": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s*(?:Proc-Type|DEK-Info): [^\n]*)*(?:\s*[A-Za-z0-9+/=]{20,})+(?:\s*[A-Za-z0-9+/=]+(?=\s*-----END))?(?:\s*-----END [A-Z ]{0,20}PRIVATE KEY-----)?", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    "vendor": (r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 16),
    "url": (r"://[A-Za-z0-9._~-]{1,64}:([^\s/@:]{6,128})@", 1, 6),
    "bearer": (r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)", 1, 20),
}
BASE = ("assign", "access", "hex")
#: A text without any of these has no candidate (RE2, one pass in C++).
_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{32}|PRIVATE KEY-----|eyJ|gh[pousr]_|xox[abprs]-|sk_live_|AIza|://[A-Za-z0-9._~-]+:|[Bb]earer\x20"
_FLAGS = {"assign": re.ASCII | re.IGNORECASE}
_COMPILED = {k: (re.compile(p, _FLAGS.get(k, re.ASCII)).finditer, g, n) for k, (p, g, n) in KINDS.items()}
_ORDER = {k: i for i, k in enumerate(KINDS)}

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.binary()), ("base", pa.bool_())])


def candidates(text: str) -> list[tuple[str, int, int, bytes, bool]]:
    """(kind, start, end, hash of the secret, whether of a base kind), by start, then kind; code points, end exclusive."""
    out = []
    for kind, (find, group, least) in _COMPILED.items():
        for m in find(text):
            secret = m[group]
            if len(secret) >= least:
                out.append((kind, m.start(), m.end(), hashlib.sha256(secret.encode("utf-8", "surrogatepass")).digest()[:16], kind in BASE))
    return sorted(out, key=lambda x: (x[1], _ORDER[x[0]]))


def find(docs: DataFrame, repository: Column, owner: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: the keep columns, __repository, __owner and __found (its candidates). A null text counts as empty."""
    kept = docs.select(*keep, F.coalesce(repository.cast("string"), F.lit("")).alias("__repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("__owner"), docs[text].alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1)
        maybe = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
        found = [[dict(zip(("kind", "start", "end", "secret", "base"), x, strict=True)) for x in candidates(texts[i].as_py())] if m else [] for i, m in enumerate(maybe)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(_SPAN))], names=[*batch.schema.names[:-1], "__found"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    spans = "array<struct<kind: string, start: bigint, end: bigint, secret: binary, base: boolean>>"
    return arrow_map(kept, run, f"{types}, __found {spans}")


def scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """find(), written once with __row (its number), which so means the same row wherever it is used."""
    return materialise(find(docs, repository, owner, text, keep).withColumn("__row", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """secret, n_repositories, n_owners: over how many distinct ones each candidate's hash is spread.

    Distinct triples are taken first (combined before the shuffle), so a secret
    that a third of all documents hold does not meet in one task.
    """
    each = scanned.select(F.explode("__found.secret").alias("secret"), "__repository", "__owner").distinct()
    return each.groupBy("secret").agg(F.count_distinct("__repository").alias("n_repositories"), F.count_distinct("__owner").alias("n_owners"))


def classify(scanned: DataFrame, repositories: int = 4, owners: int = 3) -> DataFrame:
    """For each scanned row: its columns, spans (base ones, and added ones that look live), n_live and n_copied.

    A secret in at least this many repositories and of at least this many owners
    is a widely copied example; any other looks live.
    """
    copied = ownership(scanned).where((F.col("n_repositories") >= repositories) & (F.col("n_owners") >= owners)).select("secret", F.lit(True).alias("copied"))
    each = scanned.select("__row", F.posexplode("__found").alias("at", "span")).select("__row", "at", "span", F.col("span.secret").alias("secret"))
    judged = each.join(copied, "secret", "left").withColumn("live", F.col("copied").isNull())
    stays = F.col("span.base") | F.col("live")
    by_row = judged.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.when(stays, F.struct("at", F.col("span.kind").alias("kind"), F.col("span.start").alias("start"), F.col("span.end").alias("end"), "live")))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    empty = F.array().cast("array<struct<at: int, kind: string, start: bigint, end: bigint, live: boolean>>")
    some = scanned.where(F.size("__found") > 0).join(by_row, "__row")
    none = scanned.where(F.size("__found") == 0).withColumns({"spans": empty, "n_live": F.lit(0).cast("bigint"), "n_copied": F.lit(0).cast("bigint")})
    return some.unionByName(none)  # texts without a candidate take part in no join


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digest(classified: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns, n_assign, n_access, n_hex, base_sha256, spans (joined), n_live and n_copied."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("__found", lambda x: x["base"])
    count = {f"n_{k}": F.size(F.filter("__found", _of_kind(k))).cast("bigint") for k in BASE}
    joined = F.array_join(F.transform("spans", text), ",")
    sha = F.sha2(F.array_join(F.transform(base, text), ","), 256)
    return classified.select(*keep, *(v.alias(k) for k, v in count.items()), sha.alias("base_sha256"), joined.alias("spans"), "n_live", "n_copied")


def redact(docs: DataFrame, repository: Column, owner: Column, text: str = "text", marker: str = "[SECRET]", **limits: int) -> DataFrame:
    """docs with every span that stays replaced by marker; all rows and all columns are kept.

    Overlapping spans are replaced as one. n_chars, where docs has it, follows the text.
    """
    names = docs.columns
    # rows without a candidate go straight through; only the few others are written and judged
    args = (docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc"), repository.alias("__r"), owner.alias("__o"), F.col(f"`{text}`").alias("__t")), F.col("__r"), F.col("__o"), "__t", ("__doc",))
    each = find(*args)
    with_secrets = materialise(each.where(F.size("__found") > 0).withColumn("__row", F.monotonically_increasing_id()), "secrets")
    found = classify(with_secrets, **limits)
    changed = found.select("__doc", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"), F.col(f"__doc.`{text}`").alias("__t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [cut(t, a, b, marker) for t, a, b in zip(*(batch.column(k).to_pylist() for k in (3, 1, 2)), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bool(a) for a in batch.column(1).to_pylist()]), pa.array(new, pa.string())], names=["__doc", "__cut", "__new"])

    walked = arrow_map(changed, run, T.StructType([T.StructField("__doc", changed.schema["__doc"].dataType), T.StructField("__cut", T.BooleanType()), T.StructField("__new", T.StringType())]))
    out = {c: F.col(f"__doc.`{c}`") for c in names} | {text: F.col("__new")}
    if "n_chars" in names and "n_chars" != text:
        out["n_chars"] = F.when(F.col("__cut"), F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    clean = each.where(F.size("__found") == 0).select("__doc.*")
    return clean.unionByName(walked.select(*(v.alias(c) for c, v in out.items())))


def cut(text: str | None, starts: list[int], ends: list[int], marker: str) -> str | None:
    """text with marker in place of each span, in one walk; overlapping spans are one."""
    if not starts:
        return text
    out, at = [], 0
    for a, b in sorted(zip(starts, ends, strict=True)):
        if a >= at:
            out += [text[at:a], marker]
        at = max(at, b)
    return "".join([*out, text[at:]])
