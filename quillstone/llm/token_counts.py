"""Token counts by rank-synchronous array merging.

Texts are cut where the vocabulary can join nothing, the distinct pieces of a
batch are held as one ragged numpy array of symbols, and in each round every
piece applies its own lowest-rank pair, all pieces at once. Where a join can make
no pair of that rank or a lower one, a piece applies the pair wherever it occurs
(from the left, without overlap), else the leftmost occurrence alone: both give
what one join at a time would. So the rounds of a piece are about as many as the
ranks that it meets, however long it is. What is left when no pair is known
counts: a known symbol as one token, an unknown character as its UTF-8 bytes. Only
batches are held, so memory does not grow with the input, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

_SPACE = "▁"
_NONE = np.int64(1 << 40)
#: Characters of pieces that are merged at once (a longer piece goes alone).
AT_ONCE = 1 << 20
#: Pieces whose counts a worker remembers, at most.
REMEMBERED = 600_000


class PieceCounter:
    """Counts tokens as the model at path encodes texts (identity normalisation, a dummy space first)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        score = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not special[i]}
        self.ids = {p: i for i, p in enumerate(score)}
        chars = {c for p in score for c in p} - self.ids.keys()
        self.cost = [1] * len(self.ids)
        for c in sorted(chars):
            self.ids[c] = len(self.ids)
            self.cost.append(len(c.encode()))
        ranks = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p, s in score.items():
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    pairs[self.ids[p[:k]], self.ids[p[k:]]] = (ranks[s], self.ids[p])
        self.pairs = pairs
        self.width = len(self.ids) + 1  # the last id: a character that no piece has
        self._hash_pairs()
        self.of_char = np.full(0x110000, self.width - 1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.costs = np.array([*self.cost, 0], np.int64)
        joined = {c for p in score if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        assert all(_SPACE not in p.lstrip(_SPACE) for p in score), "pieces go on over a space"
        self.cut = re.compile(f"{_SPACE}*[^{_SPACE}{alone}]+|{_SPACE}+" + (f"|[{alone}]" if alone else "")).findall
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.cut(_SPACE + t.replace(" ", _SPACE)) if t else [] for t in texts]
        new = set().union(*cut) - self.known.keys()
        if new:
            if len(self.known) > REMEMBERED:
                self.known, new = {}, set().union(*cut)
            new = list(new)
            self.known.update(zip(new, self.pieces(new), strict=True))
        known = self.known.__getitem__
        return [sum(map(known, pieces)) for pieces in cut]

    def pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of each of these, none of which is empty."""
        out, part, size = [], [], 0
        for p in pieces:
            if part and size + len(p) > AT_ONCE:
                out += self._arrays(part).tolist()
                part, size = [], 0
            part.append(p)
            size += len(p)
        return out + (self._arrays(part).tolist() if part else [])

    def _hash_pairs(self) -> None:
        """An open-addressed table of the pairs: of each key's first free slots, at most probes are tried."""
        keys = np.array([a * self.width + b for a, b in self.pairs], np.int64)
        bits = int(len(keys) * 4).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys, self.slot = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int32)
        at, left, self.probes = self._first_slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.keys[at[left] + self.probes] < 0
            slots, first = np.unique((at[left] + self.probes)[free], return_index=True)
            put = left[free][first]
            self.keys[slots], self.slot[slots] = keys[put], put
            left = np.setdiff1d(left, put)
            self.probes += 1
        self.rank = np.array([r for r, _ in self.pairs.values()], np.int64)
        self.into = np.array([m for _, m in self.pairs.values()], np.int32)
        # the lowest rank of the pairs that a symbol is in: a join into a symbol of higher ones makes nothing that is due sooner
        lowest = np.full(self.width, _NONE)
        for (a, b), (r, _) in self.pairs.items():
            lowest[a], lowest[b] = min(lowest[a], r), min(lowest[b], r)
        self.lowest = lowest

    def _first_slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.width + right
        rank, into = np.full(len(key), _NONE), np.zeros(len(key), np.int32)
        at, rest = self._first_slot(key), np.arange(len(key))
        for _ in range(self.probes):  # until a slot that is free or the key's own
            found = self.keys[at]
            hit = found == key
            slot = self.slot[at[hit]]
            rank[rest[hit]], into[rest[hit]] = self.rank[slot], self.into[slot]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            at, key, rest = at[more] + 1, key[more], rest[more]
        return rank, into

    def _arrays(self, pieces: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.of_char[code]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        total = np.zeros(len(pieces), np.int64)
        odd = sym == self.width - 1
        if odd.any():  # unknown characters never merge
            utf8 = 1 + (code[odd] > 0x7F) + (code[odd] > 0x7FF) + (code[odd] > 0xFFFF)
            np.add.at(total, piece[odd], utf8)
        rank, into = self._look_up(sym[:-1], sym[1:]) if len(sym) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        rank, into = np.append(rank, _NONE), np.append(into, 0)
        rank[np.cumsum(lengths) - 1] = _NONE
        while len(sym):
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            going = best < _NONE
            if not going.all():  # these are done
                total += np.bincount(piece, weights=self.costs[sym] * np.repeat(~going, lengths), minlength=len(total)).astype(np.int64)
                stay = np.repeat(going, lengths)
                sym, piece, rank, into = sym[stay], piece[stay], rank[stay], into[stay]
                if not len(sym):
                    break
                lengths, best = lengths[going], best[going]
            due = np.repeat(best, lengths)
            at = np.flatnonzero(rank == due)
            # of neighbours that are due the first, third, ...: each takes the symbol after it
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            risky = self.lowest[into[at]] <= due[at]
            if risky.any():
                of = piece[at]
                alone = np.isin(of, of[risky])
                at = at[~alone | (np.diff(of, prepend=-1) != 0)]
            sym[at] = into[at]
            rank[at] = rank[at + 1]  # no pair after the last symbol of a piece
            gone = np.ones(len(sym), bool)
            gone[at + 1] = False
            at -= np.arange(len(at))
            sym, piece, rank, into = sym[gone], piece[gone], rank[gone], into[gone]
            after = at[at + 1 < len(sym)]
            after = after[piece[after] == piece[after + 1]]
            before = at[at > 0]
            before = before[piece[before] == piece[before - 1]] - 1
            for where in (after, before):
                if len(where):
                    rank[where], into[where] = self._look_up(sym[where], sym[where + 1])
        return total


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns of each row, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Equal rows give equal rows.
    Other columns of df are left out, so theirs may have any name.
    """
    kept = df.select(*keep, df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            n = [m for k in range(0, len(texts), 512) for m in model.count(texts[k : k + 512])]
            size = [len(t.encode()) if t else 0 for t in texts]
            columns = [*batch.columns[:-1], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{types}, n_bytes bigint, n_tokens bigint, over_limit boolean")
