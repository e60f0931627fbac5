"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import common, decontamination, exchange, license_scan, lm_scoring, packing, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def crc(i) -> int:
    return zlib.crc32(("" if i is None else str(i)).encode())


WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def every(docs_rows, odd_rows):
    return [*odd_rows, *((r[0] + 1000, *r[1:]) for r in docs_rows)]


@pytest.fixture(scope="module")
def docs(spark, every, schema):
    common.tuned(spark, 64)
    return spark.createDataFrame(every, schema).repartition(3)


@pytest.fixture(scope="module")
def none(spark, schema):
    return spark.createDataFrame([], schema)


def same(df, want):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


# --- shared parts


def test_words_and_hashes():
    texts = ["", "a b", " x\n\x0by ", "\xa0é q", "a b"]
    w = common.Words(common.text_bytes(pa.array(texts)), 0, 5)
    assert w.counts().tolist() == [len(WORD.findall(t)) for t in texts]
    words = [bytes(w.buf[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert words == [x for t in texts for x in WORD.findall(t)]
    h = w.hashes()
    assert (h[:2] == h[-2:]).all() and len(set(h.tolist())) == len(set(words))
    assert common.inside_text(w.first, 2).tolist() == [True, False, True, False, True, False, True]
    for n in (2, 9, 50):
        x = np.arange(200, dtype=np.uint64) % np.uint64(7)
        runs = common.window_hashes(common.mix(x), n)
        assert len(set(runs.tolist())) == 7 and (runs[:-7] == runs[7:]).all()


def test_slices():
    c = common.text_bytes(pa.array(["ab", "", "c" * 100, "d"]))
    assert [b - a for a, b in common.slices(c, 3)] == [2, 1, 1] or sum(b - a for a, b in common.slices(c, 3)) == 4
    assert list(common.slices(common.text_bytes(pa.array([], pa.string())))) == []


# --- 1 licences


def dice(a, b):
    x, y = license_scan.bigrams(decontamination.words_of(a)), license_scan.bigrams(decontamination.words_of(b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_licenses(spark, docs, none):
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()}
    lines = {(r.doc_id, name) for r in docs.collect() for line in (r.text or "").split("\n") for name, t in license_scan.TEMPLATES if len(line) < 2000 and dice(line, t) >= license_scan.DICE}
    assert lines and lines <= got
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        words = decontamination.words_of(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        best = max(dice(b" ".join(words).decode(), t) for n, t in license_scan.TEMPLATES if n == r.license)
        assert abs(best - r.dice) < 1e-12 and r.dice >= license_scan.DICE
    whole = spark.createDataFrame([(i, f"intro prose here\n{t}\nmore prose there") for i, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in license_scan.scan(whole).collect()} >= {(i, n) for i, (n, _) in enumerate(license_scan.TEMPLATES)}
    assert license_scan.scan(none).count() == 0


# --- 2 rules


def plain_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_rules(spark, docs, none, every):
    out = quality_rules.apply_rules(docs, [])
    want = []
    for r in every:
        n = plain_counts(r[1])
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want.append((r[0], *n, failed, not failed))
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), want)
    assert quality_rules.apply_rules(none, []).count() == 0
    clash = docs.withColumns({"n_words": F.lit("x"), "rule": F.lit(1), "__text": F.lit(2)})
    assert quality_rules.apply_rules(clash, []).where("kept").count() == sum(w[-1] for w in want)


def test_covering():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(4000), "b": rng.random(4000), "c": rng.random(4000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= r.holds(x)
    assert len(rules) >= 2 and (hit == bad).mean() > 0.98
    assert quality_rules.learn(x, np.zeros(4000, bool)) == [] and quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_ordered_verdict(spark):
    rules = [quality_rules.Rule((("a", ">", 1.0), ("b", "<=", 2.0)), 1, 1), quality_rules.Rule((("a", ">", 0.0),), 1, 1)]
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (0.0, 0.0)], "a double, b double")
    assert [r.v for r in df.select(quality_rules.verdict(rules).alias("v")).collect()] == [1, 2, 0]


# --- 3 packing


def plain_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def test_packing(spark):
    rng = np.random.default_rng(3)
    lengths = [*rng.integers(0, 120, 700).tolist(), 64, 64, 500, 129, None]
    df = spark.createDataFrame([(i, None if n is None else int(n)) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    rows = packing.pack(df, sizes=(32, 64, 128)).collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.chunk, r.start, r.n_tokens))
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.bin_used, r.bin_size))
    for i, n in enumerate(lengths):
        parts = sorted(by_doc[i])
        assert [p[1] for p in parts] == [128 * k for k in range(len(parts))] and sum(p[2] for p in parts) == (n or 0)
    for parts in bins.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
        used = sum(p[1] for p in parts)
        assert {(p[2], p[3]) for p in parts} == {(used, next(s for s in (32, 64, 128) if s >= used))}
    # a single size: as many bins as best-fit decreasing, item by item
    items = [n for n in lengths[:700] if n]
    p = packing.plan(Counter(items), (128,))
    assert p.bins[:, 1].sum() == plain_best_fit(items, 128) and (p.bins[:, 2] * p.bins[:, 1]).sum() == sum(items)
    assert packing.plan(Counter(items), (32, 64, 128)).cost <= p.cost
    assert packing.pack(df.where("false")).count() == 0 and len(packing.plan({}).bins) == 0


def test_pack_texts(docs, every):
    out = packing.pack_texts(docs.withColumn("n_tokens", F.lit("clash")), sizes=(64, 1024))
    words = sum(len(w) + 1 for r in every if (w := WORD.findall(r[1] or "")))
    assert out.agg(F.sum("n_tokens")).first()[0] == words and out.where("chunk = 0").count() == len(every)


# --- 4 decontamination


def plain_contained(every, items):
    out = []
    for r in every:
        words = decontamination.words_of(r[1])
        for i, t in items:
            own = decontamination.words_of(t)
            n = min(5, len(own))
            q = set(decontamination.shingles_of(own, n)) if n else set()
            if q and len(q & set(decontamination.shingles_of(words, n))) / len(q) >= 0.8:
                out.append((r[0], i))
    return out


def test_decontamination(spark, docs, none, every):
    said = every[3][1].split()
    items = [(1, " ".join(said[10:40])), (2, " ".join([*said[10:28], "OTHER", *said[29:60]])), (3, None), (4, ""), (5, "Word1, WORD2!"), (6, " ".join(said[5:20]) + " nothing of this at all is there or was"), (7, "w0x0"), *((100 + k, every[k][1][:400]) for k in range(14, 60, 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_contained(every, [(i, t) for i, t in items])
    assert {i for _, i in want} >= {1, 2, 5, 7} and 6 not in {i for _, i in want}
    same(decontamination.contained(docs.withColumn("item_id", F.lit(1)), bench).select("doc_id", "item_id"), want)
    clean = [r for r in every if not plain_contained([r], items)]
    same(decontamination.drop_contaminated(docs, bench).select("doc_id", F.length("text")), [(r[0], None if r[1] is None else len(r[1])) for r in clean])
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns
    assert decontamination.contained(none, bench).count() == 0 and decontamination.contained(docs, bench.where("false")).count() == 0
    # a benchmark that is too large to be sent: the same by joins
    same(decontamination.contained(docs.withColumns({"item_id": F.lit(1), "h": F.lit(2)}), bench, block_bytes=0).select("doc_id", "item_id"), want)
    shares = lambda df: sorted((r.doc_id or -1, r.item_id, round(r.containment, 9)) for r in df.collect())
    assert shares(decontamination.contained(docs, bench, block_bytes=0)) == shares(decontamination.contained(docs, bench))
    # hashes that are equal by chance change nothing: pairs are verified on words
    assert shares(decontamination.contained(docs, bench, block_bytes=0, hash_bits=9)) == shares(decontamination.contained(docs, bench))
    same(decontamination.drop_contaminated(docs, bench, block_bytes=0).select("doc_id", F.length("text")), [(r[0], None if r[1] is None else len(r[1])) for r in clean])
    assert decontamination.contained(none, bench, block_bytes=0).count() == 0 and decontamination.contained(docs, bench.where("item_id = 3"), block_bytes=-1).count() == 0


# --- 5 classifier


def test_classifier(spark, docs_rows, none, schema):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(900):
        text = " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60))
        good = i % 4 > 0
        rows.append((i, text if good else text.replace(" ", "%%% "), "en", "s", 1))
        if i % 5 < 3:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, schema)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_classifier.train(docs, lab, learn_from=~common.held_out("doc_id", 3, 1))
    again = quality_classifier.train(docs.repartition(7), lab, learn_from=~common.held_out("doc_id", 3, 1))
    assert (model.weights == again.weights).all()
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    right = [(got[i] >= 0.5) == (i % 4 > 0) for i in range(900) if crc(i) % 3 == 1]
    assert np.mean(right) > 0.95
    flipped = lab.withColumn("quality", F.when(common.held_out("doc_id", 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_classifier.train(docs, flipped, learn_from=~common.held_out("doc_id", 3, 1)).weights == model.weights).all()  # held-out labels are not looked at
    assert quality_classifier.score(none, model).count() == 0
    blank = quality_classifier.train(none, lab.where("false"))
    assert 0 <= quality_classifier.score(docs, blank).first().score <= 1


def test_classifier_odd(docs, every):
    model = quality_classifier.train(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    scores = quality_classifier.score(docs, model)
    assert scores.count() == len(every) and scores.where("score is null or score < 0 or score > 1").count() == 0
    kept = quality_classifier.reject_low_quality(docs.withColumns({"score": F.lit(1), "__doc": F.lit(2)}), model)
    assert kept.columns == [*docs.columns, "score", "__doc"]


# --- 6 secrets


def plain_spans(text):
    t = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secrets(spark, docs, none, every):
    tricky = ["password=token=abcdefghij", "ééé PASSWORD : 'a1b2c3d4e5'", "api_key=short apikey: longenough1", "AKIAAKIAAKIAAKIA1", "secret=\"x\" f" + "0" * 40 + "f", None, ""]
    more = spark.createDataFrame([(9000 + i, t, "en", "z", 0) for i, t in enumerate(tricky)], docs.schema)
    both, rows = docs.union(more), [*every, *((9000 + i, t) for i, t in enumerate(tricky))]
    out = secret_scan.digest(secret_scan.classify(secret_scan.scan(both, F.col("source"), F.col("source"))))
    want = []
    for r in rows:
        s = plain_spans(r[1])
        n = Counter(k for k, *_ in s)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((r[0], n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest()))
    same(out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), want)
    assert secret_scan.digest(secret_scan.classify(secret_scan.scan(none, F.col("source"), F.col("source")))).count() == 0


def test_ownership(spark):
    ghp = "ghp_" + "a1B2" * 9
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    rows = [(i, f"key {ghp} here", f"r{i}", f"o{i}") for i in range(6)] + [(10, f"tok {jwt}", "r1", "o1"), (11, f"tok {jwt}", "r1", "o1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    got = {r.doc_id: (r.spans, r.n_live, r.n_copied) for r in secret_scan.digest(secret_scan.classify(secret_scan.scan(df, F.col("repo"), F.col("owner")))).collect()}
    assert got[0] == ("", 0, 1)  # copied all over: an example
    assert got[10] == (f"jwt:4:{4 + len(jwt)}", 1, 0)
    clean = {r.doc_id: r.text for r in secret_scan.redact(df, F.col("repo"), F.col("owner")).collect()}
    assert clean[10] == "tok [SECRET]" and ghp in clean[3]


def test_redact_keeps_rows(docs, every):
    out = secret_scan.redact(docs.withColumns({"spans": F.lit(1), "__row": F.lit(2)}), F.col("source"), F.col("source"))
    rows = out.collect()
    assert len(rows) == len(every) and out.columns == [*docs.columns, "spans", "__row"]
    text = next(r for r in rows if r.doc_id == 9)
    assert text.text == "[SECRET] [SECRET] [SECRET]" and text.n_chars == len(text.text)


# --- 7 substrings


def plain_cut(rows, window):
    first = {}
    split = [(r[0] if r[0] is not None else math.inf, (r[1] or "").encode().split()) for r in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, math.inf), i)
    out = []
    for r, (i, w) in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 21, 3000])
def test_substrings(docs, every, chunk_bytes):
    out = substring_dedup.cut_repeats(docs, chunk_bytes=chunk_bytes, fan_bits=2)
    want = plain_cut(every, 50)
    assert sum(w[2] for w in want) > 300
    same(out.select("doc_id", "n_words", "n_removed", "kept_sha256"), want)


def test_substrings_periodic(spark, none):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):  # few words, long runs and periods: the hardest for a parse
        w = []
        while len(w) < 120:
            w += [str(rng.integers(3))] * int(rng.integers(1, 30)) if rng.random() < 0.5 else ["a", "b"] * int(rng.integers(1, 20))
        rows.append((int(rng.integers(1000)), " ".join(w)))
    rows += [(2000, "x " * 500), (2001, "x " * 60), (2002, "x " * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (50, 7):
        same(substring_dedup.cut_repeats(df, window=window, chunk_bytes=2000).select("doc_id", "n_words", "n_removed", "kept_sha256"), plain_cut(rows, window))
    assert substring_dedup.cut_repeats(none).count() == 0


# --- 8 tokens


def test_tokens(docs, every, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in every]
    same(token_counts.count_tokens(docs.withColumn("n_tokens", F.lit(1)), MODEL), want)
    assert token_counts.count_tokens(none, MODEL).count() == 0


def test_pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.PieceCounter(MODEL)
    rng = np.random.default_rng(2)
    parts = ["a", "b", " ", "  ", "\n", "▁", "th", "é", "語", "\U0001f600", "\0", "\t", "&", "<s>", "\r", "    "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000)] + ["ab" * 3000, "aaaa" * 2000, " " * 3000, None, ""]
    assert own.count(texts) == [len(sp.encode(t or "")) for t in texts]


def test_long_pieces():
    """Unspaced texts far beyond a word: letters alone, syllables, base64, runs and a text of one character over and over, next to short ones."""
    import base64

    sentencepiece = pytest.importorskip("sentencepiece")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.PieceCounter(MODEL)
    rng = np.random.default_rng(5)
    pick = lambda parts, n: "".join(rng.choice(parts, n))
    syllables = ["the", "ing", "ed", "er", "tion", "qu", "an", "re", "st", "on", "é", "ß", "ñ", "語"]
    texts = [pick(list("abcdefghijklmnopqrstuvwxyz"), 100_000), pick(syllables, 30_000), base64.b64encode(rng.bytes(60_000)).decode(), "ab" * 50_000, "a" * 100_000, "ä語" * 20_000, "short one", " " * 20_000]
    texts += [pick(syllables + [" "], 300) for _ in range(50)]
    assert own.count(texts) == [len(sp.encode(t)) for t in texts]


# --- 9 SimHash


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(ids, fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(docs, every, none):
    fps = [plain_fingerprint(r[1]) for r in every]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(every, fps, plain_groups([r[0] for r in every], fps), strict=True)]
    same(simhash.grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id"), want)
    assert simhash.grouped(none).count() == 0
    kept = simhash.dedup(docs.withColumn("fp", F.lit(1)))
    assert kept.count() == len({c for *_, c in want}) and kept.columns == [*docs.columns, "fp"]
    # ids may be texts: the least of each group stays, a null only where there is no other
    named = docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("%08d", "doc_id")))
    ids = sorted(r.doc_id or "" for r in simhash.dedup(named).select("doc_id").collect())
    assert ids == sorted("" if r.doc_id is None else f"{r.doc_id:08d}" for r in kept.select("doc_id").collect())
    some = docs.sparkSession.createDataFrame([("a", "one two three four"), ("b", "one two three four"), (None, "one two three four")], "doc_id string, text string")
    assert [r.doc_id for r in simhash.dedup(some).collect()] == ["a"]


@pytest.mark.parametrize("block", [2048, 16])
def test_links(spark, block):
    rng = np.random.default_rng(4)
    fps = set()
    for _ in range(30):  # clusters and chains around each centre
        x = int(rng.integers(1 << 63)) | int(rng.integers(2)) << 63
        for _ in range(int(rng.integers(1, 60))):
            fps.add(x)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(nodes, block)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    want = plain_groups(list(range(len(fps))), fps)
    got = {}
    assert all(got.setdefault(roots.get(f, f), c) == c for f, c in zip(fps, want, strict=True)) and len(got) == len(set(want))


def test_components(spark):
    path = [(i + 1, i) for i in range(200)]
    rng = np.random.default_rng(1)
    perm = rng.permutation(201)
    e = spark.createDataFrame([(int(perm[a]), int(perm[b])) for a, b in path] + [(1000, 999), (999, 1000), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(e).collect()}
    assert all(got.get(int(x), 0) == 0 for x in perm) and got[1000] == 999


# --- 10 language model


def test_scores(docs, every, none):
    rows = {}
    out = lm_scoring.score(docs.withColumns({"score": F.lit(1), "keep": F.lit(2)}), ~common.held_out("doc_id", 7, 2), chunk_bytes=4000, fan_bits=2)
    counts = Counter()
    split = [(r[0], (r[1] or "").encode().lower().split()) for r in every]
    for i, w in split:
        if crc(i) % 7 != 2:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, w in split:
        t = [*w, None]
        want[i, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)] += 1
    rows = out.collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm_scoring.score(none, F.lit(True)).count() == 0
    unlearned = lm_scoring.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in unlearned)


def learned(spark, texts, **limits):
    """(tree of spellings, Top) of these training texts."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select(F.struct("doc_id").alias("keep"), F.lit(True).alias("train"), "text")
    chunks = common.materialise(lm_scoring._chunks(rows, 100), "t")
    words = Counter(w for t in texts for w in t.split())
    top = lm_scoring.Top(sum(words.values()), len(words), len(texts), sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values()))
    return lm_scoring.train(chunks, **limits), top


def test_spellings_sum_to_one(spark):
    """All words of two letters over three, their spellings and what is longer: probabilities of a proper distribution."""
    tree, top = learned(spark, ["ab ab ba", "ab c", "abc abc ab", "b"], least=0.01)
    assert top.words == 9
    words = [bytes(x) for k in (1, 2, 3, 4, 5) for x in np.array(np.meshgrid(*[list(b"abc")] * k)).reshape(k, -1).T.astype(np.uint8)]
    lengths, data = np.array([len(w) for w in words]), np.frombuffer(b"".join(words), np.uint8)
    spelled = tree.score(lengths, data)
    assert 0.1 < (10**spelled).sum() <= 1 + 1e-6
    rowsum = np.exp(tree.logs.astype(np.float64) * np.log(10)).sum(1)
    assert np.allclose(rowsum, 1, atol=1e-4)


class BruteTree:
    """The suffix tree over words from its definition, on dictionaries."""

    def __init__(self, texts, tree, top, least, weights):
        self.top, self.weights = top, weights
        self.after, self.spelling = {(): Counter()}, lambda w: np.round(tree.score(np.array([len(w.encode())]), np.frombuffer(w.encode(), np.uint8)) * 1024) / 1024
        for t in texts:
            seq = ["<s>", *t.split(), None]
            for i in range(1, len(seq)):
                for k in range(min(i, 2) + 1):
                    self.after.setdefault(tuple(seq[i - k : i]), Counter())[seq[i]] += 1
        self.states = {()}
        for ctx, nxt in self.after.items():
            n = sum(nxt.values())
            if ctx and n >= least:
                gain, w = 0, weights[len(ctx) - 1]
                for x, c in nxt.items():
                    p = self.p(x, ctx[1:])
                    gain += c * round(math.log((c - 1 + w * p) / ((n - 1 + w) * p)) * lm_scoring._NAT)
                if gain > 0:
                    self.states.add(ctx)

    def p(self, x, ctx):
        if not ctx:
            return 10**self.top.end if x is None else 10 ** float(self.top.score(np.array([self.after[()][x]]), self.spelling(x))[0])
        nxt, w = self.after.get(ctx, Counter()), self.weights[len(ctx) - 1]
        return (nxt[x] + w * self.p(x, ctx[1:])) / (sum(nxt.values()) + w)

    def state(self, before):
        return next(tuple(before[len(before) - k :]) for k in (2, 1, 0) if k <= len(before) and tuple(before[len(before) - k :]) in self.states)

    def score(self, text):
        seq = ["<s>", *text.split(), None]
        return sum(math.log10(self.p(seq[i], self.state(seq[:i]))) for i in range(1, len(seq)))


@pytest.mark.parametrize("fan_bits", (1, 8))
def test_scores_by_words_before_them(spark, fan_bits):
    rng = np.random.default_rng(3)
    chain = {w: rng.choice(list("abcdefgh"), 3) for w in "abcdefgh"}

    def text(n):
        out = [str(rng.choice(list("abcdefgh")))]
        while len(out) < n:
            out.append(str(rng.choice(chain.get(out[-1], list("abcdefgh")))) if rng.random() < 0.9 else str(rng.choice(["x", "yy", "zzz", "Ä"])))
        return " ".join(out)

    texts = [text(int(rng.integers(1, 60))) for _ in range(80)] + ["", "a b c a b c a b c"] * 3
    held = [text(30) for _ in range(30)] + ["never seen words", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + held)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in lm_scoring.score(df, F.col("doc_id") < len(texts), chunk_bytes=300, weights=(4.0, 2.0), fan_bits=fan_bits).collect()}
    tree, top = learned(spark, texts)
    brute = BruteTree(texts, tree, top, lm_scoring.MIN_COUNT, (4.0, 2.0))
    assert sum(len(c) == 1 for c in brute.states) > 4 and sum(len(c) == 2 for c in brute.states) > 4
    assert len(brute.states) < sum(sum(c.values()) >= lm_scoring.MIN_COUNT for c in brute.after.values())
    for i, t in enumerate(texts + held):
        assert abs(got[i] - brute.score(t)) < 1e-4, t
    # after any context the known words, the end and what is left for unseen words sum to 1
    known = [None, *top_words(texts)]
    unseen = 1 - sum(brute.p(x, ()) for x in known)
    assert 0 < unseen < 0.1
    for ctx in list(brute.states) + [("a", "zzz"), ("never",)]:
        weight = 1.0
        for k in range(1, len(ctx) + 1):
            weight *= brute.weights[k - 1] / (sum(brute.after.get(ctx[len(ctx) - k :], Counter()).values()) + brute.weights[k - 1])
        assert abs(sum(brute.p(x, ctx) for x in known) + weight * unseen - 1) < 1e-9
    # word order counts, and contexts help on held-out texts against the empty context alone
    mixed = [" ".join(rng.permutation(t.split())) for t in held[:30]]
    assert sum(map(brute.score, held[:30])) > sum(map(brute.score, mixed)) + 50
    alone = sum(math.log10(brute.p(x, ())) for t in held[:30] for x in [*t.split(), None])
    assert sum(got[len(texts) + i] for i in range(30)) > alone + 50


def top_words(texts):
    return sorted({w for t in texts for w in t.split()})


@pytest.mark.parametrize("wide", (False, True))
def test_exchange_over_many_levels(spark, wide):
    rng = np.random.default_rng(0)
    held = {c << 33: np.unique(rng.integers(0, 400, int(rng.integers(0, 120)))).astype(np.uint64) for c in range(37)}
    held[5] = np.zeros(0, np.uint64)
    held = {c: rng.permutation(k) for c, k in held.items()}
    # wide keys: eight share their first 64 bits
    keys = {c: common.mix(k // np.uint64(8) if wide else k) for c, k in held.items()}
    more = {c: (k % np.uint64(8)).astype(np.uint32) if wide else None for c, k in held.items()}
    vals = {c: (common.mix(k) % np.uint64(50)).astype(np.int64) - 20 for c, k in held.items()}
    for how, reduce in (("sum", sum), ("min", min)):
        for bits in (1, 2, 8):
            batches = [exchange.ask(c, keys[c], vals[c], bits, more[c]) for c in keys]
            rows = spark.createDataFrame(pa.Table.from_batches(batches)).select("node", "part", "n", "keys", "more", "vals")
            got = {r.chunk: bytes(r.hits) for r in exchange.reduce_keys(rows, how, len(keys), bits).collect()}
            by_key = {}
            for c in keys:
                for k, v in zip(held[c].tolist(), vals[c].tolist(), strict=True):
                    by_key.setdefault(k, []).append(v)
            assert set(got) == {c for c in keys if len(keys[c])}
            for c in keys:
                assert exchange.answered(got.get(c), keys[c], more[c]).tolist() == [reduce(by_key[k]) for k in held[c].tolist()]


# --- scores on held-out rows, clashing names, nothing to look for


def test_classifier_on_held_out_rows(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs, labels = common.documents(spark, sf), common.documents(spark, sf, "labels")
    mine = ~common.held_out("doc_id", 3, 1)
    model = quality_classifier.train(docs, labels, learn_from=mine)
    rows = quality_classifier.score(docs, model).join(labels, "doc_id").where(~mine).select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    share = labels.where(mine).agg(F.avg("quality")).first()[0]
    assert abs(model.prior - share) < 0.1  # found without a look at label 0
    swapped = labels.withColumn("quality", F.when(F.col("quality") == 1, 1).otherwise(F.lit(None)))
    again = quality_classifier.train(docs, swapped, learn_from=mine)
    assert again.prior == model.prior and np.array_equal(again.weights, model.weights)


def test_prior_from_scores_alone():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        make = lambda n, good: (rng.normal(0, 1, (n, quality_classifier.WIDTH)) + (np.arange(quality_classifier.WIDTH) < 5) * (3 if good else 0)).astype(np.float32)
        n = 3000
        unlabelled = np.concatenate([make(int(n * share), True), make(n - int(n * share), False)])
        assert abs(quality_classifier.estimate_prior(make(1500, True), rng.permutation(unlabelled)) - share) < 0.06
    assert quality_classifier.estimate_prior(np.zeros((3, 2)), np.zeros((100, 2))) == 0.5


def test_clashing_names_and_nothing_to_find(spark, docs, none):
    clash = docs.withColumns({c: F.lit(1) for c in ("license", "dice", "first_word", "__row", "secret", "spans", "copied", "id", "mark", "ranges", "kept", "chunk", "hits", "node")})
    assert license_scan.scan(clash).count() == license_scan.scan(docs).count() and license_scan.scan(none).count() == 0
    assert license_scan.scan(docs, templates=()).count() == 0 and license_scan.scan(docs, templates=(("none", " .,"),)).count() == 0
    plain = secret_scan.digest(secret_scan.classify(secret_scan.scan(docs, F.col("source"), F.col("source"))))
    same(secret_scan.digest(secret_scan.classify(secret_scan.scan(clash, F.col("source"), F.col("source")))), [tuple(r) for r in plain.collect()])
    same(substring_dedup.cut_repeats(clash, fan_bits=2).select("doc_id", "n_removed"), [tuple(r) for r in substring_dedup.cut_repeats(docs, fan_bits=2).select("doc_id", "n_removed").collect()])
    assert substring_dedup.cut_repeats(none).count() == 0 and packing.pack_texts(none).count() == 0
    assert secret_scan.redact(none, F.col("source"), F.col("source")).count() == 0 and simhash.dedup(none).count() == 0
    assert secret_scan.redact(clash, F.col("source"), F.col("source")).columns == clash.columns
