"""Encoding of whole texts with a public byte-level BPE vocabulary, on numpy matrices.

The distinct pieces of an Arrow batch are laid into padded matrices by length bucket. In each round every row merges its leftmost pair of
least rank; pairs are looked up in an open-addressing hash table; rows without a pair left, and columns no row needs any more, are dropped
(compaction). Pieces met before are remembered by the worker, up to ``KEEP`` of them, so that recurring words cost one lookup. A single piece of more than ``LONG`` bytes is merged by the same rule from a heap.

Result for edge cases: a null and an empty text give an empty list; any other text is encoded as stored, strings of special tokens as
ordinary text. Repeated rows each give a row. An empty table gives none.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = 400_000
LONG = 2_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of a public vocabulary's rank file on this machine."""
    spec = importlib.util.find_spec("public_tokenizers")
    home = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(home, f"{name}.tiktoken")


def split_pattern() -> str:
    """The vocabulary's own pattern of pieces, as published with it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """(left id, right id) -> id of the merged token: every cut of every token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NONE, np.int32)
        todo, at, values = keys, self._home(keys), np.array(merged, np.int32)
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            slot, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot], self.values[slot] = todo[put], values[put]
            stay = np.ones(len(todo), bool)
            stay[put] = False
            todo, values, at = todo[stay], values[stay], (at[stay] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair (a, b), ``NONE`` where they don't merge or an id is negative."""
        out = np.full(a.shape, NONE, np.int32)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[live].astype(np.uint64) << np.uint64(32)) | b[live].astype(np.uint64)
        at = self._home(keys)
        while len(live):
            there = self.keys[at]
            hit = there == keys
            out[live[hit]] = self.values[at[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            live, keys, at = live[go], keys[go], (at[go] + 1) & self.mask
        return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.values = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _merge(self, rows: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of a padded matrix of byte ids (-1 pads)."""
        n, done, where = len(rows), [None] * len(rows), np.arange(len(rows))
        flat = lambda m: self.pairs.ranks(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        ranks = flat(rows) if rows.shape[1] > 1 else np.full((n, 1), NONE)
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), int)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    r = rows[i]
                    done[where[i]] = r[r >= 0].copy()
                rows, ranks, where, at, best = rows[~over], ranks[~over], where[~over], at[~over], best[~over]
                if not len(rows):
                    break
            k, w = np.arange(len(rows)), rows.shape[1]
            cols = np.arange(w - 1)
            src = cols + (cols > at[:, None])  # drops column at+1 of each row
            rows[k, at] = best
            rows = np.take_along_axis(rows, src, 1)
            ranks = np.take_along_axis(np.concatenate([ranks, np.full((len(rows), 1), NONE, np.int32)], 1), src, 1)[:, : w - 2] if w > 2 else np.zeros((len(rows), 0), np.int32)
            if rows.shape[1] > 1:
                rows_at = np.minimum(at, rows.shape[1] - 1)
                right = np.where(at + 1 < rows.shape[1], rows[k, np.minimum(at + 1, rows.shape[1] - 1)], -1)
                fresh = self.pairs.ranks(rows[k, rows_at], right)
                ok = at < ranks.shape[1]
                ranks[k[ok], at[ok]] = fresh[ok]
                has = at > 0
                ranks[k[has], at[has] - 1] = self.pairs.ranks(rows[k[has], at[has] - 1], rows[k[has], at[has]])
                used = rows.shape[1] - int((rows[:, ::-1] >= 0).any(0).argmax())
                rows, ranks = rows[:, :used], ranks[:, : max(used - 1, 0)]
        return done

    def _merge_long(self, ids: list[int]) -> np.ndarray:
        """The same merges for one very long piece, its candidate pairs kept in a heap by (rank, place): a matrix round costs the row's width."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        a = np.array(ids, np.int32)
        first = self.pairs.ranks(a[:-1], a[1:])
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        rank = dict(enumerate(first.tolist()))
        look = self.pair_of
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank.get(i) != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((i, after[i]), (before[i], i)):
                if left >= 0 and right < n:
                    new = look(ids[left], ids[right])
                    rank[left] = new
                    if new is not None:
                        heapq.heappush(heap, (new, left))
                elif left >= 0:
                    rank[left] = None
        return np.array([x for x, ok in zip(ids, alive) if ok], np.int32)

    def pair_of(self, a: int, b: int) -> int | None:
        r = int(self.pairs.ranks(np.array([a], np.int32), np.array([b], np.int32))[0]) if (a, b) not in self._pairs else self._pairs[a, b]
        if len(self._pairs) > KEEP:
            self._pairs.clear()
        self._pairs[a, b] = r
        return None if r == NONE else r

    def _learn(self, fresh: list[str]) -> None:
        got: list[np.ndarray | None] = [None] * len(fresh)
        buckets: dict[int, list[int]] = {}
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        for i, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                got[i] = np.array([whole], np.int32)
            elif len(b) > LONG:
                got[i] = self._merge_long(self.bytes[np.frombuffer(b, np.uint8)].tolist())
            else:
                buckets.setdefault(len(b) if len(b) <= 24 else 24 + (len(b) - 1).bit_length(), []).append(i)
        for members in buckets.values():
            width = max(len(raw[i]) for i in members)
            step = max(1, 4_000_000 // width)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                lens = np.array([len(raw[i]) for i in part])
                grid = np.full((len(part), width), -1, np.int32)
                grid[np.arange(width) < lens[:, None]] = self.bytes[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                for i, ids in zip(part, self._merge(grid)):
                    got[i] = ids
        base = len(self.known)
        for i, p in enumerate(fresh):
            self.known[p] = base + i
        self.lengths = np.concatenate([self.lengths, np.array([len(g) for g in got], np.int64)])
        self.values = np.concatenate([self.values, *got])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(piece codes of all texts in a row, number of pieces of each text)."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > KEEP:
            self._forget()
        fresh = dict.fromkeys(p for s in split for p in s if p not in self.known)
        if fresh:
            self._learn(list(fresh))
        known = self.known
        counts = np.array([len(s) for s in split], np.int64)
        codes = np.fromiter((known[p] for s in split for p in s), np.int64, int(counts.sum()))
        return codes, counts

    def _offsets(self, lens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(lens)])
        return total[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets: text i has ids[offsets[i]:offsets[i + 1]])."""
        codes, counts = self._codes(texts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        lens = self.lengths[codes]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1]) - np.repeat(ends - lens, lens) + np.repeat(self.starts[codes], lens)
        return self.values[at], self._offsets(lens, counts)

    def count(self, texts: list[str | None]) -> np.ndarray:
        codes, counts = self._codes(texts)
        if not len(codes):
            return np.zeros(len(texts), np.int64)
        return np.diff(self._offsets(self.lengths[codes], counts))


def _ship(docs: DataFrame, path: str) -> None:
    """Send the rank file along with the job, for workers that do not have it at the driver's path."""
    sc = docs.sparkSession.sparkContext
    if not sc.master.startswith("local") and os.path.exists(path) and not any(f.endswith("/" + os.path.basename(path)) for f in sc.listFiles):
        sc.addFile(path)


def _here(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _parts(batch: pa.RecordBatch, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text."""
    sizes = np.array([len(t) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most_chars)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids): token ids of every row's text. One pass, no shuffle."""
    path, pattern = path or vocabulary(), pattern or split_pattern()
    _ship(docs, path)
    id_field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_here(path), pattern)
        for batch in batches:
            for part in _parts(batch):
                ids, offsets = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_field.dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, tokens): number of tokens of every row's text."""
    path, pattern = path or vocabulary(), pattern or split_pattern()
    _ship(docs, path)
    id_field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_here(path), pattern)
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.count(part.column(1).to_pylist()), pa.int64())], names=[id_col, "tokens"])

    return docs.select(F.col(id_col), text_col).mapInArrow(run, f"`{id_col}` {id_field.dataType.simpleString()}, tokens bigint")
