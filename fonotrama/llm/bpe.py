"""Byte-level BPE by a hierarchical-bitmap rank queue.

Each merge rank has a bucket of positions in a doubly linked list of symbols. A three-level bitmap over
the ranks finds the lowest occupied one by find-first-set. Popping a bucket merges its positions from
left to right; an entry whose pair has changed meanwhile is stale and skipped. Work per symbol is
constant apart from the bitmap's fixed depth, so a pre-token of a million bytes costs no more per byte
than a short one.

``encode_many`` runs the queue over all given pre-tokens at once (one list, cut between them), merging a
whole bucket in one numpy step. Merges in different pre-tokens are independent, and those of one bucket
in one pre-token are taken left to right without overlap. Only if a merge makes a pair of a lower rank
than the bucket's own could this order differ from the one-at-a-time order; such pre-tokens are found
and encoded again by ``encode_one``, the same queue taken one merge at a time.

Defined results: null counts as empty, and an empty text has no ids; repeated rows are encoded alike;
decoding is the concatenation of the ids' byte strings, so it gives back the text's UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Pre-tokens that a worker remembers; beyond, it starts anew. Longer ones than LONG bytes are not kept.
REMEMBERED, LONG = 400_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankBits:
    """The set of occupied ranks: 64 bits a word, three levels, lowest first."""

    def __init__(self, n: int):
        self.low = [0] * (n // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def add(self, r: int) -> None:
        w = r >> 6
        self.low[w] |= 1 << (r & 63)
        self.mid[w >> 6] |= 1 << (w & 63)
        self.top |= 1 << (w >> 6)

    def first(self) -> int:
        """The lowest rank, or -1."""
        if not self.top:
            return -1
        m = (self.top & -self.top).bit_length() - 1
        w = m << 6 | (self.mid[m] & -self.mid[m]).bit_length() - 1
        return w << 6 | (self.low[w] & -self.low[w]).bit_length() - 1

    def drop(self, r: int) -> None:
        w = r >> 6
        self.low[w] &= ~(1 << (r & 63))
        if not self.low[w]:
            self.mid[w >> 6] &= ~(1 << (w & 63))
            if not self.mid[w >> 6]:
                self.top &= ~(1 << (w >> 6))


class RankQueueBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[a], ranks[b], r) for z, r in ranks.items() for i in range(1, len(z)) if (a := z[:i]) in ranks and (b := z[i:]) in ranks]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        key = left * self.size + right
        order = np.argsort(key)
        self.key, self.made = np.concatenate((key[order], [np.iinfo(np.int64).max])), np.concatenate((made[order], [self.size]))
        self.pair = {(int(a), int(b)): int(c) for a, b, c in pairs}
        self.known: dict[str, bytes] = {}

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, or ``size``; -1 stands for the end of a pre-token."""
        key = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.made[at], self.size)

    def encode_one(self, token: bytes) -> list[int]:
        """One pre-token, one merge at a time."""
        if token in self.ranks:
            return [self.ranks[token]]
        n = len(token)
        ids, after, before = [int(self.byte_id[x]) for x in token], list(range(1, n + 1)), list(range(-1, n - 1))
        now = [self.pair.get(x, -1) for x in zip(ids, ids[1:])] + [-1]
        bits, buckets = RankBits(self.size), {}

        def push(i: int, r: int) -> None:
            now[i] = r
            if r >= 0:
                if r not in buckets:
                    buckets[r] = []
                    bits.add(r)
                buckets[r].append(i)

        for i in range(n - 1):
            push(i, now[i])
        while (r := bits.first()) >= 0:
            held = buckets.pop(r)
            bits.drop(r)
            heapq.heapify(held)
            while held:
                i = heapq.heappop(held)
                if now[i] != r:
                    continue  # stale
                j = after[i]
                ids[i], now[j], after[i] = r, -2, after[j]
                if after[i] < n:
                    before[after[i]] = i
                lowest = r
                push(i, self.pair.get((r, ids[after[i]]), -1) if after[i] < n else -1)
                lowest = min(lowest, now[i]) if now[i] >= 0 else lowest
                if (p := before[i]) >= 0:
                    push(p, self.pair.get((ids[p], r), -1))
                    lowest = min(lowest, now[p]) if now[p] >= 0 else lowest
                if lowest < r and held:  # a lower rank has come up: the rest of this bucket waits
                    buckets.setdefault(r, []).extend(held)
                    bits.add(r)
                    break
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_many(self, tokens: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        whole = [self.ranks.get(t) for t in tokens]
        todo = [t for t, w in zip(tokens, whole, strict=True) if w is None and t]
        done = iter(self._bulk(todo)) if todo else iter(())
        return [np.array([w], np.uint32) if w is not None else next(done) if t else np.zeros(0, np.uint32) for t, w in zip(tokens, whole, strict=True)]

    def _bulk(self, tokens: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        n = int(sizes.sum())
        start = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.append(self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[start[1:] - 1] = n
        before[start[:-1]] = n
        after[n] = before[n] = n
        now = self._merged(ids, ids[after])
        now[n] = self.size
        alive = np.ones(n + 1, bool)
        bits, buckets, odd = RankBits(self.size), {}, []

        def push(where: np.ndarray) -> None:
            r = now[where]
            where, r = where[r < self.size], r[r < self.size]
            if len(where):
                order = np.argsort(r, kind="stable")
                where, r = where[order], r[order]
                cut = np.flatnonzero(r[1:] != r[:-1]) + 1
                for k, part in zip(r[np.concatenate(([0], cut))].tolist(), np.split(where, cut), strict=True):
                    if k not in buckets:
                        buckets[k] = []
                        bits.add(k)
                    buckets[k].append(part)

        push(np.arange(n))
        while (r := bits.first()) >= 0:
            held = buckets.pop(r)
            bits.drop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[now[at] == r]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that overlap, every other one, from the left
                fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))
                if not fresh.all():
                    first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            then = after[gone]
            ids[at], now[gone], after[at], alive[gone] = r, self.size, then, False
            before[then] = np.where(then < n, at, before[then])
            before[n] = n
            left = before[at]
            left = left[left < n]
            touched = np.concatenate((at, left))
            now[touched] = self._merged(ids[touched], ids[after[touched]])
            if (low := touched[now[touched] < r]).size:
                odd.append(low)
            push(np.unique(touched))
        again = set(np.searchsorted(start, np.concatenate(odd), "right").tolist()) if odd else set()
        keep = np.flatnonzero(alive[:n])
        kept = ids[keep].astype(np.uint32)
        cuts = np.searchsorted(keep, start)
        return [np.array(self.encode_one(t), np.uint32) if k + 1 in again else kept[cuts[k] : cuts[k + 1]] for k, t in enumerate(tokens)]

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        coded = {w: ids.astype("<u4").tobytes() for w, ids in zip(new, self.encode_many([w.encode() for w in new]), strict=True)}
        known.update(coded)
        out = [b"".join([known[w] for w in words]) for words in split]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        held = self.bytes_of
        return b"".join([held[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[tuple[str, str], RankQueueBPE] = {}


def loaded(path: str, pattern: str) -> RankQueueBPE:
    """The coder of a rank file, once per Python process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankQueueBPE(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, and digests of the ids and of the bytes decoded from them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        coder = loaded(path, pattern)
        ids = coder.encode_texts(C.texts_of(batch))
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids],
        }

    return C.map_rows(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and its ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        ids = loaded(path, pattern).encode_texts(C.texts_of(batch))
        return {"doc_id": batch.column("doc_id"), "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]}

    return C.map_rows(rows, run, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Texts of (doc_id, ids) rows; bytes that aren't UTF-8 become replacement characters."""

    def run(batch: pa.RecordBatch) -> dict:
        coder = loaded(path, pattern)
        return {"doc_id": batch.column("doc_id"), "text": [coder.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]}

    return C.map_rows(coded.select("doc_id", "ids"), run, "doc_id long, text string")
