"""Language-model scores by a probabilistic suffix tree over words.

A text is a stream of words and one end. Contexts are the words before a token:
none, one (at the first word: the text's start) or two. A context may be a state
if it was seen MIN_COUNT times in training, whatever the corpus' size, so the
tree grows with the corpus. It is one if its next-token distribution diverges
from its suffix's: the training tokens after it, each predicted with itself left
out, must be likelier under its own counts smoothed into its suffix than under
the suffix alone. A token is scored in the longest suffix of what comes before it
that is a state; its distribution is smoothed into its suffix's, that into the
empty context's.

The empty context has the words by their counts (absolute discounting); what the
discounts free goes to the words' spellings, so unseen words have a probability
too, and all probabilities after any context sum to 1. Spellings are a suffix tree
of their own, over bytes inside the word, of a bounded size: contexts of up to
DEPTH bytes that make up at least LEAST of the training bytes. It is the last
fallback and the only part that is broadcast.

Nothing else is brought to one place. Texts go in chunks (about CHUNK_BYTES of
text, whole texts only). A chunk asks once for each distinct word, run of two
words and, after frequent runs, run of three, and once for each context's
divergence; exchange.py sums over all chunks. Counts and sums are integers, so
the scores do not depend on the order of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, in_chunks, materialise, mix, slices, span_hashes, text_bytes
from .exchange import FAN_BITS, ROWS, answered, ask, distinct, pack, reduce_keys, unpack, unzipped, zipped

#: The spelling tree: bytes of context, share of the training bytes.
DEPTH, LEAST = 3, 1e-4
#: Its symbols: bytes, and bytes that no word has as the word end, the start and (in grams) nothing.
WORD_END, START, NOTHING = 0x20, 0x09, 0x0A
_NEVER = [START, *range(0x0A, 0x0E)]
_N = 256
CHUNK_BYTES = 4 << 20
SMOOTH = 4.0
#: Least training count of a context; weight of the suffix in contexts of one and of two words.
MIN_COUNT = 4
WEIGHTS = (256.0, 32.0)
#: Divergence sums are integers of 1 / 64 nat.
_NAT = 64
#: log10 probabilities of spellings are kept to 1 / 1024.
_SPELL = 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Runs of words and contexts have keys of 56 bits (words of 64): of 10^13 runs one in 10^4 shares its key.
_KEY = np.uint64(0xFFFFFFFFFFFFFF00)
_END, _START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def _joined(words: pa.Array) -> bytes:
    """large_binary words, each with a space after it (no word has one)."""
    off = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    if not len(words):
        return b""
    data = np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]]
    out = np.full(len(data) + len(words), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[off[1:] - off[0] + np.arange(len(words))] = False
    out[inside] = data
    return out.tobytes()


_CHUNKS = "chunk bigint, docs int, keep array<{keep}>, lens binary, train binary, n int, ids binary, words binary, counts binary"


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of some texts: number of words of each, the words' numbers in order, and the distinct words."""
    parts, lens = [], []
    for c, d in slices(column):  # word edges of 2 MB at a time
        w = Words(column, c, d, lower=True)
        size = w.ends - w.starts
        off = np.append(0, np.cumsum(size))
        take = np.repeat(w.starts - off[:-1], size) + np.arange(off[-1])
        parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(w.buf[take].tobytes())]).dictionary_encode())
        lens.append(w.counts())
    coded = pa.chunked_array(parts, parts[0].type).unify_dictionaries()
    return np.concatenate(lens), np.concatenate([p.indices.to_numpy(zero_copy_only=False) for p in coded.chunks]).astype(np.int64), coded.chunk(0).dictionary


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs has (keep, train, text). A row for each chunk: its texts as numbers of its distinct words (frequent ones first), and those."""
    keep_type = docs.schema["keep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for number, batch in enumerate(in_chunks(batches, 2, chunk_bytes), first):
            kept, trained = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            lens, index, words = _coded(text_bytes(batch.column(2)))
            order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            index = place[index]
            counts = np.bincount(index[np.repeat(trained, lens)], minlength=len(words)).astype(np.int64)
            planes = np.ascontiguousarray(index.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
            text = _joined(words.take(pa.array(order)))
            one = lambda x, t: pa.array([x], t)
            columns = [
                one(number, pa.int64()), one(len(lens), pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), one(lens.astype(np.int32).tobytes(), pa.binary()), one(trained.tobytes(), pa.binary()),
                one(len(index), pa.int32()), one(zipped(planes), pa.binary()), one(zipped(text), pa.binary()), one(pack(counts), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "docs", "keep", "lens", "train", "n", "ids", "words", "counts"])

    return docs.mapInArrow(run, _CHUNKS.format(keep=keep_type))


def _spell(lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of each word (its bytes, then the word end): the symbol, its word, its place in the word."""
    n = lengths + 1
    word = np.repeat(np.arange(len(n), dtype=np.int32), n)
    start = np.cumsum(n) - n
    place = np.arange(int(n.sum()), dtype=np.int32) - start.astype(np.int32)[word]
    symbol = np.full(len(word), WORD_END, np.uint8)
    symbol[place < lengths.astype(np.int32)[word]] = data
    return symbol, word, place


def _before(symbol: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The symbol k places before: the start is before a word's first symbol, nothing before that."""
    out = np.full(len(symbol), NOTHING, np.uint8)
    out[k:] = symbol[: len(symbol) - k]
    out[place == k - 1] = START
    out[place < k - 1] = NOTHING
    return out


def _slices_of_words(lengths: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of words of about so many bytes, and of their bytes."""
    ends = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        start = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, start + limit, "right")))
        yield a, b, start, int(ends[b - 1])
        a = b


def _read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lengths, bytes on end and (where the batch has them) training counts of a chunk's words."""
    text = np.frombuffer(unzipped(batch.column("words")[i].as_py()), np.uint8)
    ends = np.flatnonzero(text == 0x20)
    lengths = np.diff(ends, prepend=-1) - 1
    counts = unpack(batch.column("counts")[i].as_py(), len(lengths)) if "counts" in batch.schema.names else None
    return lengths, text[text != 0x20], counts


class Chunk:
    """A chunk's texts as one sequence of numbers: start, words, end of each text; its distinct words, pairs and what they ask."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.number = batch.column("chunk")[i].as_py()
        self.lengths, self.data, _ = _read(batch, i)
        v = self.distinct = len(self.lengths)
        self.end, self.start = v, v + 1
        self.lens = np.frombuffer(batch.column("lens")[i].as_py(), np.int32).astype(np.int64)
        n = self.lens + 2
        off = np.cumsum(n) - n
        size = batch.column("n")[i].as_py()
        ids = np.ascontiguousarray(np.frombuffer(unzipped(batch.column("ids")[i].as_py()), np.uint8).reshape(4, size).T).view(np.int32).ravel()
        self.seq = np.full(int(n.sum()), self.end, np.int32)
        self.seq[off] = self.start
        inner = self.seq == self.end
        inner[off + n - 1] = False
        self.seq[inner] = ids
        self.trained = np.repeat(np.frombuffer(batch.column("train")[i].as_py(), bool), n)
        #: Where tokens (words and ends) are; and from the second token of a text on.
        is_token = np.ones(len(self.seq), bool)
        is_token[off] = False
        self.token = np.flatnonzero(is_token)
        is_token[off + 1] = False
        self.later = np.flatnonzero(is_token)
        self.first_token, self.off = off - np.arange(len(n)), off
        code = self.seq[self.token - 1].astype(np.int64) * (v + 2) + self.seq[self.token]
        pairs, of = distinct(code)
        self.pair_counts = np.bincount(of[self.trained[self.token]], minlength=len(pairs)).astype(np.int64)
        self.first, self.second = pairs // (v + 2), pairs % (v + 2)
        self.pair = np.full(len(self.seq), -1, np.int32)
        self.pair[self.token] = of
        self.hashes = _word_hashes(self.lengths, self.data)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of the tokens' values by text (each has one token at least, its end)."""
        return np.add.reduceat(values, self.first_token) if len(values) else np.zeros(0)

    def pair_hashes(self) -> np.ndarray:
        return mix(mix(self.hashes[self.first] + _A) * _A + self.hashes[self.second]) & _KEY

    def take_pairs(self, totals: bytes, hits: bytes | None, texts: int) -> None:
        """totals: training counts of the words, the end and the start over the corpus; pair_totals: of the pairs."""
        self.totals = np.append(unpack(totals, self.distinct), [texts, texts])
        self.pair_totals = answered(hits, self.pair_hashes())

    def find_triples(self, least: int) -> None:
        """triple: their first two words as a pair, then their last; at: where they end, of: which one is there."""
        self.at = self.later[self.pair_totals[self.pair[self.later - 1]] >= least]
        v = self.distinct
        triples, self.of = distinct(self.pair[self.at - 1].astype(np.int64) * (v + 2) + self.seq[self.at])
        self.above, self.last = triples // (v + 2), triples % (v + 2)
        self.triple_counts = np.bincount(self.of[self.trained[self.at]], minlength=len(triples)).astype(np.int64)
        #: The pair of a triple's last two words, which is one of the chunk's.
        self.suffix = np.zeros(len(triples), np.int64)
        self.suffix[self.of] = self.pair[self.at]

    def ask_triples(self) -> tuple[np.ndarray, np.ndarray]:
        return mix(mix(self.pair_hashes()[self.above] + _B) * _A + self.hashes[self.last]) & _KEY, self.triple_counts

    def take_triples(self, hits: bytes | None) -> None:
        self.triple_totals = answered(hits, self.ask_triples()[0])

    def distributions(self, root: np.ndarray, weights: tuple[float, float]) -> None:
        """From the logs of each number's probability in the empty context: those of pairs after their first word, of triples after their pair."""
        self.root = root
        self.pair_p = _smoothed(self.pair_totals, self.totals[self.first], root[self.second], weights[0])
        self.triple_p = _smoothed(self.triple_totals, self.pair_totals[self.above], self.pair_p[self.suffix], weights[1])

    def contexts(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The words (start included) and the pairs that may be states."""
        after = np.zeros(self.distinct + 2, bool)
        after[self.first] = True
        pairs = np.zeros(len(self.first), bool)
        pairs[self.above] = True
        return np.flatnonzero(after & (self.totals >= least)), np.flatnonzero(pairs)

    def ask_gains(self, least: int, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the contexts, and this chunk's part of their gains in 1 / 64 nat."""
        words, pairs = self.contexts(least)
        gain = _gains(self.first, self.pair_counts, self.pair_totals, self.totals[self.first], self.root[self.second], weights[0], self.distinct + 2)
        more = _gains(self.above, self.triple_counts, self.triple_totals, self.pair_totals[self.above], self.pair_p[self.suffix], weights[1], len(self.first))
        keys = np.concatenate([mix(self.hashes[words] ^ _B), mix(self.pair_hashes()[pairs] ^ _B)])
        return keys & _KEY, np.concatenate([gain[words], more[pairs]])

    def score(self, hits: bytes | None, least: int, weights: tuple[float, float]) -> np.ndarray:
        """log10 probability of each text."""
        words, pairs = self.contexts(least)
        got = answered(hits, self.ask_gains(least, weights)[0])
        word_state, pair_state = np.zeros(self.distinct + 2, bool), np.zeros(len(self.first), bool)
        word_state[words], pair_state[pairs] = got[: len(words)] > 0, got[len(words) :] > 0
        p = np.zeros(len(self.seq))
        p[self.token] = np.where(word_state[self.seq[self.token - 1]], self.pair_p[self.pair[self.token]], self.root[self.seq[self.token]])
        long = pair_state[self.above[self.of]]
        p[self.at[long]] = self.triple_p[self.of[long]]
        return self.per_text(p[self.token]) / np.log(10)


def _word_hashes(lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Of the distinct words, the end and the start."""
    ends = np.cumsum(lengths)
    return np.concatenate([span_hashes(data, ends - lengths, ends), [_END, _START]])


def _smoothed(own: np.ndarray, count: np.ndarray, suffix: np.ndarray, weight: float) -> np.ndarray:
    """log of (own + weight * suffix's probability) / (count + weight); suffix's as a log, as a long unseen word's may be too small for a float."""
    out = np.log(weight) + suffix
    seen = own > 0
    out[seen] = np.log(own[seen] + weight * np.exp(suffix[seen]))
    return out - np.log(count + weight)


def _gains(context: np.ndarray, own: np.ndarray, total: np.ndarray, count: np.ndarray, suffix: np.ndarray, weight: float, size: int) -> np.ndarray:
    """Of each context: how much likelier own training tokens are in it than in its suffix, each with itself left out of the context's counts."""
    seen = own > 0
    own, total, count, suffix, context = (x[seen] for x in (own, total, count, suffix, context))
    each = np.round((_smoothed(total - 1, count - 1, suffix, weight) - suffix) * _NAT) * own
    return np.bincount(context, weights=each, minlength=size).astype(np.int64)


#: Distinct grams that a task holds before it passes them on.
_GRAMS = 1 << 20


def _grams(chunks: DataFrame, depth: int) -> DataFrame:
    """gram (depth symbols before, and the symbol, a byte each), n: over all training words. Combined in the task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, data, counts = _read(batch, i)
                for a, b, x, y in _slices_of_words(lengths):
                    symbol, word, place = _spell(lengths[a:b], data[x:y])
                    gram = symbol.astype(np.int64)
                    for k in range(1, depth + 1):
                        gram |= _before(symbol, place, k).astype(np.int64) << (8 * k)
                    some, of = distinct(gram)
                    n = np.bincount(of, weights=counts[a:b][word], minlength=len(some)).astype(np.int64)
                    both, of = distinct(np.concatenate([held[0], some]))
                    held = both, np.bincount(of, weights=np.concatenate([held[1], n]), minlength=len(both)).astype(np.int64)
                if len(held[0]) > _GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["gram", "n"])
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["gram", "n"])

    every = chunks.select("words", "counts").mapInArrow(run, "gram bigint, n bigint")
    return every.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tree:
    """codes: by context length the retained contexts (the nearest symbol lowest); rows: their row in logs (log10 probabilities); row 0 is the empty context."""

    codes: tuple[np.ndarray, ...]
    rows: tuple[np.ndarray, ...]
    logs: np.ndarray

    @cached_property
    def longer(self) -> np.ndarray:
        """By a context's row and the symbol before it the row of the longer context, or -1 (every suffix of a context is one)."""
        out = np.full(self.logs.shape, -1, np.int32)
        above, codes = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for k, (code, row) in enumerate(zip(self.codes, self.rows, strict=True)):
            out[above[np.searchsorted(codes, code & ((1 << (8 * k)) - 1))], code >> (8 * k)] = row
            above, codes = row, code
        return out

    def score(self, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
        """log10 probability of each word with its word end, after a word's start."""
        out = np.zeros(len(lengths))
        for a, b, x, y in _slices_of_words(lengths):
            symbol, word, place = _spell(lengths[a:b], data[x:y])
            state = np.zeros(len(symbol), np.int32)
            at = state
            for k in range(1, len(self.codes) + 1):
                at = np.where(at >= 0, self.longer[at, _before(symbol, place, k)], -1)
                state = np.where(at >= 0, at, state)
            out[a:b] = np.bincount(word, weights=self.logs[state, symbol], minlength=b - a)
        return out


def _grow(levels: list[tuple[np.ndarray, np.ndarray]], smooth: float = SMOOTH) -> Tree:
    """levels: for each context length (0 first) the contexts in order and their counts of next symbols."""
    seen = np.ones(_N)
    seen[_NEVER] = 1e-300  # no symbols that follow
    root = levels[0][1][0] + seen
    table = np.log(root)[None] - np.log(root.sum())
    codes, rows, tests = [], [], []
    above_codes, above_rows = np.zeros(1, np.int32), np.zeros(1, np.int64)
    for k, (code, counts) in enumerate(levels[1:], 1):
        suffix = code & np.int32((1 << (8 * (k - 1))) - 1)
        slot = np.minimum(np.searchsorted(above_codes, suffix), max(len(above_codes) - 1, 0))
        ok = above_codes[slot] == suffix if len(above_codes) else np.zeros(len(code), bool)
        code, counts, above = code[ok], counts[ok], above_rows[slot[ok]]
        n = counts.sum(1, keepdims=True)
        below = (counts + smooth * np.exp(table[above])) / (n + smooth)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(counts > 0, counts * (np.log(below) - table[above]), 0).sum(1)
        tests.append((gain > 0.5 * (counts > 0).sum(1) * np.log(np.maximum(n[:, 0], 2)), above))
        rows.append(np.arange(len(table), len(table) + len(code)))
        codes.append(code)
        table = np.concatenate([table, np.log(np.maximum(below, 1e-300))])
        above_codes, above_rows = code, rows[-1]
    # a suffix of a retained context stays
    need = np.zeros(len(table), bool)
    for (retained, above), row in reversed(list(zip(tests, rows, strict=True))):
        need[row] |= retained
        need[above[need[row]]] = True
    need[0] = True
    new = np.cumsum(need) - 1
    return Tree(tuple(c[need[r]] for c, r in zip(codes, rows, strict=True)), tuple(new[r[need[r]]] for r in rows), (table[need] / np.log(10)).astype(np.float32))


def train(chunks: DataFrame, depth: int = DEPTH, least: float = LEAST) -> Tree:
    """The tree of the words' spellings. One pass counts grams; of each length the contexts that are frequent enough come to the driver (1 / least of them at most)."""
    grams = materialise(_grams(chunks, depth), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    levels = []
    for k in range(depth + 1):
        nearest = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * k)) - 1)) if k else F.lit(0).cast("bigint")
        each = grams.select(nearest.alias("code"), F.col("gram").bitwiseAND(F.lit(255)).alias("next"), "n")
        if k:
            each = each.where(F.shiftright("code", 8 * (k - 1)) != NOTHING)
        each = each.groupBy("code", "next").agg(F.sum("n").alias("n"))
        often = each.groupBy("code").agg(F.sum("n").alias("all")).where(F.col("all") >= max(2.0, least * total) if k else F.lit(True)).select("code")
        got = each.join(often, "code").toArrow()
        code, of = np.unique(got.column("code").to_numpy(), return_inverse=True)
        counts = np.zeros((max(len(code), 1 - min(k, 1)), _N))
        counts[of, got.column("next").to_numpy()] = got.column("n").to_numpy()
        levels.append((code.astype(np.int32), counts))
    return _grow(levels)


@dataclass(frozen=True)
class Top:
    """The next-word distribution of the empty context: words and distinct words in training, texts, words met once and twice."""

    words: int
    distinct: int
    texts: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    @property
    def end(self) -> float:
        """log10 probability that a text ends here."""
        return float(np.log10((self.texts + 0.5) / (self.words + self.texts + 1)))

    def score(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 probability of words from their counts and the log10 probabilities of their spellings."""
        going = np.log10(1 - 10**self.end)
        if not self.words:
            return spelled + going
        free = np.log10(self.discount * self.distinct) + spelled
        known = counts > 0
        own = np.log10(np.where(known, counts - self.discount, 1.0))
        both = np.where(known, np.maximum(own, free) + np.log10(1 + 10 ** -np.abs(own - free)), free)
        return both - np.log10(self.words) + going


_COUNTED = "chunk bigint, totals binary, spelled binary, n double, v double, n1 double, n2 double"


def _counted(chunks: DataFrame, hits: DataFrame, tree) -> DataFrame:
    """For each chunk its words' training counts over the corpus and log10 probabilities of their spellings.

    n: its training words; v, n1, n2: its share of the distinct words, of those met once and twice (a word's share is that of its count).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, data, own = _read(batch, i)
                total = answered(batch.column("hits")[i].as_py(), _word_hashes(lengths, data)[:-2])
                spelled = tree.value.score(lengths, data)
                share = own / np.maximum(total, 1)
                sums = (own.sum(), share.sum(), share[total == 1].sum(), share[total == 2].sum())
                columns = [batch.column("chunk").slice(i, 1), pa.array([pack(total)], pa.binary()), pa.array([pack(np.round(spelled * _SPELL).astype(np.int64))], pa.binary()), *(pa.array([float(x)]) for x in sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "totals", "spelled", "n", "v", "n1", "n2"])

    return chunks.select("chunk", "words", "counts").join(hits, "chunk", "left").mapInArrow(run, _COUNTED)


def score(
    docs: DataFrame, train_on: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES, least: int = MIN_COUNT, weights: tuple[float, float] = WEIGHTS, fan_bits: int = FAN_BITS
) -> DataFrame:
    """The keep columns, n_tokens, n_known, train_tokens, base_score and score of each row; train_on: the rows to learn from.

    A null or empty text has the end alone. Without training texts every count is
    0, no context is a state and spellings are uniform. Rows that repeat count, and
    are scored, each for itself. Other columns are left out.
    """
    rows = docs.select(F.struct(*keep).alias("keep"), F.coalesce(train_on, F.lit(False)).alias("train"), F.col(f"`{text}`").alias("text"))
    ends = docs.where(train_on).count()
    chunks = materialise(_chunks(rows, chunk_bytes), "chunks")
    n_chunks = chunks.select("chunk").count()
    tree = docs.sparkSession.sparkContext.broadcast(train(chunks))

    def asked(df: DataFrame, keys) -> DataFrame:
        """What exchange answers to keys(batch, i) of every chunk."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield ask(batch.column("chunk")[i].as_py(), *keys(batch, i), fan_bits)

        return reduce_keys(df.mapInArrow(run, ROWS), "sum", n_chunks, fan_bits)

    def word_keys(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        lengths, data, counts = _read(batch, i)
        return _word_hashes(lengths, data)[:-2], counts

    words = materialise(_counted(chunks, asked(chunks.select("chunk", "words", "counts"), word_keys), tree), "words")
    n, v, n1, n2 = (round(x or 0) for x in words.agg(*(F.sum(c) for c in ("n", "v", "n1", "n2"))).first())
    top = Top(n, v, ends, n1, n2)
    plain = chunks.drop("docs", "keep", "counts")

    def pair_keys(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        c = Chunk(batch, i)
        return c.pair_hashes(), c.pair_counts

    def counted(batch: pa.RecordBatch, i: int) -> Chunk:
        c = Chunk(batch, i)
        c.take_pairs(batch.column("totals")[i].as_py(), batch.column("pairs")[i].as_py(), ends)
        c.find_triples(least)
        return c

    def modelled(batch: pa.RecordBatch, i: int) -> Chunk:
        c = counted(batch, i)
        c.take_triples(batch.column("triples")[i].as_py())
        spelled = unpack(batch.column("spelled")[i].as_py(), c.distinct) / _SPELL
        c.distributions(np.concatenate([top.score(c.totals[: c.distinct], spelled), [top.end, 0.0]]) * np.log(10), weights)
        return c

    pairs = materialise(asked(plain, pair_keys).withColumnRenamed("hits", "pairs"), "pairs")
    known = words.select("chunk", "totals", "spelled")
    with_pairs = plain.join(known, "chunk").join(pairs, "chunk", "left")
    triples = materialise(asked(with_pairs, lambda batch, i: counted(batch, i).ask_triples()).withColumnRenamed("hits", "triples"), "triples")
    gains = materialise(asked(with_pairs.join(triples, "chunk", "left"), lambda batch, i: modelled(batch, i).ask_gains(least, weights)).withColumnRenamed("hits", "gains"), "gains")
    n, v = top.words + ends, top.distinct + (ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = np.log10(n + v + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                c = modelled(batch, i)
                seen = c.totals[c.seq[c.token]]
                kept = batch.column("keep").slice(i, 1).flatten()
                numbers = (c.lens + 1, c.per_text((seen > 0).astype(np.int64)), np.full(len(c.lens), n), c.per_text(np.log10(seen + 1.0) - norm), c.score(batch.column("gains")[i].as_py(), least, weights))
                yield pa.RecordBatch.from_arrays([kept, *(pa.array(x) for x in numbers)], names=["keep", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    keep_type = rows.schema["keep"].dataType.simpleString()
    all_ = chunks.drop("counts").join(known, "chunk").join(pairs, "chunk", "left").join(triples, "chunk", "left").join(gains, "chunk", "left")
    done = all_.mapInArrow(run, f"keep {keep_type}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return done.select("keep.*", "n_tokens", "n_known", "train_tokens", "base_score", "score")
