"""Sequence packing by the sum-of-squares rule.

A document's tokens (its ids and a final end id) are cut only if they exceed the capacity: into full
pieces after a first piece that takes the remainder. Full pieces are sequences by themselves. Every
other piece goes where the squared counts of open sequences per residual gap sum to the least: into an
open sequence of some gap, or a new one. Only the counts per gap matter, so placing a piece is one pass
over an array of the capacity's length.

Pieces are dealt into blocks of about ``BLOCK_DOCS`` documents by a hash of the row, and each block is
packed by one task in bounded memory (also where rows share an id or a text); the rule leaves a number of part-filled sequences per block that
does not grow with the block, so the loss stays far below 1 % at any size.

Defined results: a null text is empty and gives one piece, the end id; repeated rows are packed once
each; an empty table gives an empty result; a null id is packed like any other.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 1024
#: Documents in a block, about.
BLOCK_DOCS = 20_000
END_ID = 2


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of 1 to ``capacity`` in the order given: the bin and the offset of each."""
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    far = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        # the change of the sum when a gap g becomes g - s; a full bin is no longer counted
        cost = np.where(n[s:] > 0, 2 * (n[: capacity + 1 - s] - n[s:] + 1), far)
        if n[s] > 0:
            cost[0] = 1 - 2 * n[s]
        best = int(cost.argmin())
        if s < capacity and cost[best] <= 2 * n[capacity - s] + 1:
            gap = best + s
            b = held[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            n[gap - s] += 1
            held[gap - s].append(b)
    return bins, offsets


def pack_sizes(sizes: np.ndarray, shuffled: np.ndarray, capacity: int = CAPACITY, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing of all pieces at hand: those of a third of the capacity and more come first, longest
    first, the others in the order of ``shuffled``; then the pieces of part-filled bins are taken out and packed
    anew while that lowers the number of bins."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((shuffled, np.where(sizes * 3 >= capacity, -sizes, 0)))
    b, o = sum_of_squares(sizes[order], capacity)
    bins, offsets = np.empty_like(b), np.empty_like(o)
    bins[order], offsets[order] = b, o
    for k in range(passes):
        filled = np.bincount(bins, weights=sizes).astype(np.int64)
        loose = np.flatnonzero(filled[bins] < capacity)
        open_bins = np.flatnonzero(filled < capacity)
        if not len(loose):
            break
        turned = (shuffled[loose] * (2 * k + 3)) % 1_000_003
        by_size = np.lexsort((turned, np.where(sizes[loose] * 3 >= capacity, -sizes[loose], 0))) if k % 2 else np.argsort(-sizes[loose], kind="stable")
        order = loose[by_size]
        b, o = sum_of_squares(sizes[order], capacity)
        if b.max() + 1 < len(open_bins):
            bins[order], offsets[order] = open_bins[b], o
            bins = np.unique(bins, return_inverse=True)[1].reshape(-1)
    return bins, offsets


_CODERS: dict[str, object] = {}


def coder(path: str):
    """The function from a text to its ids by a tokenizers file, whose special strings count where they stand in a text, or by
    a rank file, which has none; made once per Python process. Both give what their own libraries give."""
    if path not in _CODERS:
        import public_tokenizers
        import tiktoken

        special = {}
        if path.endswith(".json"):
            import json

            with open(path, encoding="utf-8") as f:
                held = json.load(f)
            model, special = held["model"], {t["content"]: t["id"] for t in held["added_tokens"]}
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
            ranks = {bytes(shown[c] for c in k): v for k, v in model["vocab"].items() if all(c in shown for c in k) and k not in special}
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        _CODERS[path] = partial(made.encode, allowed_special="all", disallowed_special=()) if special else made.encode_ordinary
    return _CODERS[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, row`` (a number of the document's row) and, if asked, ``ids``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        encode = coder(path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "row", "ids")}
        for i, t, row in zip(batch.column("doc_id").to_pylist(), C.texts_of(batch), batch.column("row").to_pylist(), strict=True):
            ids = np.array(encode(t), "<u4").tobytes() + end
            for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                part = ids[4 * s : 4 * (s + n)]
                for name, v in (("doc_id", i), ("piece", k), ("start", s), ("length", n), ("ids_crc32", zlib.crc32(part)), ("row", row)):
                    out[name].append(v)
                if with_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
        return out

    return C.map_rows(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, n_docs: int, capacity: int = CAPACITY, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    blocks = max(1, -(-n_docs // block_docs))
    spread = F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("long")  # rows of one id and text are dealt apart, too

    def run(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, parts = int(key[0]) << 32, []
        full = 0
        for t in tables:
            whole = t[t["length"] == capacity]
            if len(whole):  # each is a sequence, numbered from the block's upper half
                yield whole.assign(sequence_id=base + (1 << 31) + full + np.arange(len(whole)), offset=0)[names]
                full += len(whole)
            parts.append(t[t["length"] < capacity])
        rest = pd.concat(parts).sort_values(["ids_crc32", "doc_id", "piece"], kind="stable")
        bins, offsets = pack_sizes(rest["length"].to_numpy(np.int64), np.arange(len(rest)), capacity)
        yield rest.assign(sequence_id=base + bins, offset=offsets)[names]

    names = [*[c for c in pieces.columns if c != "row"], "sequence_id", "offset"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "row") + ", sequence_id long, offset long"
    return pieces.withColumn("__block", spread).groupBy("__block").applyInPandas(run, ddl)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(pieces_of(docs, path, capacity, id_col=id_col, text=text), docs.count(), capacity)
