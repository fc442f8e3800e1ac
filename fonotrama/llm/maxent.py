"""Hashed maximum-entropy language model with a class-factored softmax, and its unigram base.

Tokens are the words of a text (ASCII letters lower-cased, split at ASCII white space) and one end. A token
has a code of digits below ``WAYS``: the first is its class, the others, taken from its hash, lead down a tree
inside the class. The ``SINGLE`` most frequent training tokens are a class each and have no further digits; the
other ``HEAD`` most frequent form classes by bands of frequency, with up to two more digits; all other tokens
share the last class, with a number of digits that grows with the vocabulary. Tokens of one code form a leaf.
The chance of a token is the product of a softmax per digit, given the digits before and the context, and of its
smoothed share of the leaf's counts; a leaf of the last class has one place for unknown tokens. So the chances
of all known tokens and those places sum to one at most, whatever the context (a leaf may be empty).

Every softmax starts from the masses of its choices, so that without any feature the chances are those of counts,
and has hashed features: of the class, the word before, the two before (n-grams), the one before the last and the
third last (skips); of a further digit, its node in the tree with the word before.
Rows of weights grow with the vocabulary up to ``MOST_ROWS`` (16 MB), beyond which features collide.

Counting and scoring cover all tokens. A first pass packs texts into chunks of about ``CHUNK`` bytes, cutting
long texts between words (the next chunk then starts with the three tokens before the cut, as context only). A
chunk holds token indices and distinct 64-bit token hashes and is settled in the shared folder; hashes and
counts then travel as packed arrays per (chunk, bucket of the hash), are summed per bucket, and come back aligned
to their chunk. Training runs over all training chunks once, in ``ROUNDS`` shares: every task starts from the
last weights, takes its chunks' mini-batches by adaptive gradient steps, and the weights that tasks have moved
are averaged, row block by row block, by the cluster. The scores of a cut text are summed over its chunks.

Defined results: a null text is empty and consists of its end; without training tokens the base is
log10(0.5 / 0.5) = 0 for every token, and so is the score; repeated rows
are scored each; a null id is in the training part; an empty table gives an empty result. Weights depend on how
the table is dealt into tasks; the base does not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WAYS, BITS = 16, 4
SINGLE, HEAD = 8, 4096
#: Digits after the class, at most: of the head's bands, of all other tokens.
HEAD_DIGITS, MOST_DIGITS = 2, 4
LEAST_ROWS, MOST_ROWS, BLOCK_ROWS = 1 << 12, 1 << 18, 1 << 11
ROUNDS, BATCH, RATE, START_SQUARE = 2, 1 << 15, 0.1, 0.25
CONTEXT = 3
#: Bytes of text in a chunk, about, of a row group of chunks, and chunks in an Arrow batch.
CHUNK, GROUP_BYTES, CHUNK_ROWS = 1 << 20, 16 << 20, 4
#: Distinct tokens of chunks per bucket of hashes, about.
PER_BUCKET = 1_500_000
#: Bytes of token indices (about a third of the text's) that a training task takes if that makes a task for every core, and else at least.
TASK_BYTES, LEAST_TASK_BYTES = 32 << 20, 2 << 20
END = np.uint64(0x51ED270B7F4A7C15)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_FIELDS = "chunk long, rows array<long>, ids array<long>, held array<boolean>, sizes array<int>, skip int, at binary, hashes binary, counts binary"


# --- chunks -----------------------------------------------------------------------------------------------------


def _cut(text: bytes, room: int, size: int) -> Iterator[bytes]:
    """A text in pieces that end before white space: whole unless it is longer than ``size`` bytes; else the first of
    about ``room`` bytes, the others of about ``size``."""
    lo, room = 0, room if len(text) > size else size
    while len(text) - lo > max(room, 1):
        found = _BREAK.search(text, lo + max(room, 1))
        if found is None:
            break
        yield text[lo : found.start()]
        lo, room = found.start(), size
    yield text[lo:]


class _Chunk:
    """Pieces of texts on their way into one row."""

    def __init__(self, skip: np.ndarray):
        self.skip, self.rows, self.ids, self.held, self.texts, self.ends, self.size = skip, [], [], [], [], [], 0

    def add(self, row: int, i: int | None, held: bool, text: bytes, ends: bool) -> None:
        for name, v in (("rows", row), ("ids", i), ("held", held), ("texts", text.lower()), ("ends", ends)):
            getattr(self, name).append(v)
        self.size += len(text)

    def close(self, chunk: int, schema: pa.Schema) -> tuple[pa.RecordBatch, np.ndarray]:
        """The row, and the last tokens of the last piece."""
        h, n = C.hash_words(self.texts)
        ends = np.array(self.ends)
        h, n = np.insert(h, np.cumsum(n)[ends], END), n + ends
        last = np.concatenate((self.skip, h))[max(0, len(h) + len(self.skip) - min(CONTEXT, int(n[-1]) + (len(self.skip) if len(n) == 1 else 0))) :]
        distinct, at = np.unique(np.concatenate((self.skip, h)), return_inverse=True)
        counts = np.bincount(at[len(self.skip) :][np.repeat(~np.array(self.held, bool), n)], minlength=len(distinct))
        narrow = "<u2" if len(distinct) < 1 << 16 else "<u4"
        row = {"chunk": [chunk], "rows": [self.rows], "ids": [self.ids], "held": [self.held], "sizes": [n.astype(np.int32)], "skip": [len(self.skip)]}
        return C.to_batch(row | {"at": [at.astype(narrow).tobytes()], "hashes": [distinct.tobytes()], "counts": [counts.astype("<u4").tobytes()]}, schema), last


def packed(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """One row per chunk: row keys, ids, folds and lengths of its pieces, indices of their tokens, the distinct hashes and their training counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"), F.col(text).alias("text"))
    schema = C.arrow_schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, row, none = TaskContext.get().partitionId() << 40, 0, 0, np.zeros(0, np.uint64)
        now = _Chunk(none)
        for batch in C.slices(batches, 256):
            for i, x, t in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), C.texts_of(batch), strict=True):
                t, lo = t.encode(), 0
                for piece in _cut(t, size - now.size, size):
                    lo += len(piece)
                    now.add(part | row, i, x, piece, ends=lo == len(t))
                    if lo < len(t) or now.size >= size:
                        out, last = now.close(part | made, schema)
                        yield out
                        now, made = _Chunk(last if lo < len(t) else none), made + 1
                row += 1
        if now.rows:
            yield now.close(part | made, schema)[0]

    return C.map_arrow(rows, run, _FIELDS)


def by_bucket(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, hashes, counts``: a chunk's distinct tokens, cut by ranges of the hash (and so still in order)."""
    schema = C.arrow_schema(ddl := "chunk long, bucket int, hashes binary, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        for batch in C.slices(batches, 1):
            h, n = np.frombuffer(batch.column("hashes")[0].as_py(), np.uint64), np.frombuffer(batch.column("counts")[0].as_py(), "<u4")
            cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
            on = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            part = lambda x: [x[cuts[b] : cuts[b + 1]].tobytes() for b in on]
            yield C.to_batch({"chunk": [batch.column("chunk")[0].as_py()] * len(on), "bucket": on, "hashes": part(h), "counts": part(n)}, schema)

    return C.map_arrow(chunks.select("chunk", "hashes", "counts"), run, ddl, CHUNK_ROWS)


def _thin(n: np.ndarray) -> bytes:
    return n.astype("<u4" if not len(n) or n.max() < 1 << 32 else "<i8").tobytes()


def _thick(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8" if size and len(raw) == 8 * size else "<u4").astype(np.int64)


def totals(parts: DataFrame, digits: int) -> DataFrame:
    """``chunk, bucket, counts`` aligned to the chunk's hashes; a row of chunk -1 per bucket has its total, its distinct
    and most frequent tokens, and the places, masses and tokens of its leaves, as if all were of the last class."""
    ddl = "chunk long, bucket int, size long, counts binary, hashes binary, total long, distinct long, leaves binary, masses binary, words binary"

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"]]
        every, at = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.frombuffer(x, "<u4") for x in table["counts"]]), len(every)).astype("<i8")
        ends = np.cumsum([len(h) for h in hashes])
        back = [_thin(n[at[e - len(h) : e]]) for e, h in zip(ends, hashes, strict=True)]
        top = np.lexsort((every, -n))[:HEAD]
        top = top[n[top] > 0]
        leaf = path_of(every[n > 0], digits)
        leaves, which = np.unique(leaf, return_inverse=True)
        out = pd.DataFrame({"chunk": table["chunk"], "bucket": table["bucket"], "size": [len(h) for h in hashes], "counts": back, "hashes": None, "total": 0, "distinct": 0, "leaves": None, "masses": None, "words": None})
        own = {"chunk": -1, "bucket": key[0], "size": len(top), "counts": n[top].tobytes(), "hashes": every[top].tobytes(), "total": int(n.sum()), "distinct": int((n > 0).sum())}
        own |= {"leaves": leaves.astype("<i4").tobytes(), "masses": np.bincount(which, n[n > 0], len(leaves)).astype("<i8").tobytes(), "words": np.bincount(which, minlength=len(leaves)).astype("<i8").tobytes()}
        return pd.concat([out, pd.DataFrame([own])])

    return parts.groupBy("bucket").applyInPandas(run, ddl)


# --- the model --------------------------------------------------------------------------------------------------


def path_of(hashes: np.ndarray, digits: int) -> np.ndarray:
    """The digits after the class, the first in the highest place."""
    return (C.mix64(hashes ^ _SEEDS[0]) >> np.uint64(64 - BITS * digits)).astype(np.int64) if digits else np.zeros(len(hashes), np.int64)


@dataclass
class Model:
    total: int
    distinct: int
    digits: int  # of the last class
    head: np.ndarray  # sorted hashes of the most frequent tokens
    head_class: np.ndarray
    leaves: dict[int, np.ndarray] = field(default_factory=dict)  # mass of every leaf, by class
    prior: np.ndarray | None = None  # nodes x WAYS: log mass of each choice; the first node chooses the class
    first_node: np.ndarray | None = None  # classes x digits: the row of ``prior`` of the first node
    weights: np.ndarray | None = None  # rows x WAYS

    def class_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.full(len(hashes), WAYS - 1)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return np.where(self.head[at] == hashes, self.head_class[at], WAYS - 1)

    def depth(self, classes: np.ndarray) -> np.ndarray:
        """How many digits follow the class."""
        return np.where(classes < SINGLE, 0, np.where(classes < WAYS - 1, min(HEAD_DIGITS, self.digits), self.digits))

    def share(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each token's share of its leaf."""
        own, out = self.class_of(hashes), np.zeros(len(hashes))
        for c in np.unique(own[own >= SINGLE]).tolist():
            on = own == c
            out[on] = np.log10((counts[on] + 0.5) / self.leaves[c][path_of(hashes[on], int(self.depth(np.array([c]))[0]))])
        return out


def start(summary: DataFrame, digits: int, rows: int) -> Model:
    """Classes and masses from the buckets' summaries, with weights of nought."""
    total, distinct = summary.agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = total or 0, distinct or 0

    def spread(names: tuple[str, ...], kinds: tuple[str, ...]):
        return lambda batch: {n: np.concatenate([np.frombuffer(x, k) for x in batch.column(n).to_pylist()]) for n, k in zip(names, kinds, strict=True)}

    tops = C.map_rows(summary.select("hashes", "counts"), spread(("hashes", "counts"), ("<i8", "<i8")), "hashes long, counts long")
    top = tops.orderBy(F.desc("counts"), "hashes").limit(HEAD).toPandas()
    places = C.map_rows(summary.select("leaves", "masses", "words"), spread(("leaves", "masses", "words"), ("<i4", "<i8", "<i8")), "leaves int, masses long, words long")
    places = places.groupBy("leaves").agg(F.sum("masses").alias("mass"), F.sum("words").alias("words")).toPandas()  # at most WAYS ** MOST_DIGITS rows
    h, n = top["hashes"].to_numpy(np.int64).view(np.uint64), top["counts"].to_numpy(float)
    own = np.arange(len(h))
    if len(h) > SINGLE:
        bands = WAYS - 1 - SINGLE
        before = (np.cumsum(n[SINGLE:]) - n[SINGLE:]) / n[SINGLE:].sum()
        own[SINGLE:] = SINGLE + np.minimum((before * bands).astype(int), bands - 1)
    order = np.argsort(h)
    model = Model(total, distinct, digits, h[order], own[order], weights=np.zeros((rows, WAYS), np.float32))
    last = np.full(WAYS**digits, 0.5)
    last[places["leaves"].to_numpy(int)] += places["mass"].to_numpy(float) + 0.5 * places["words"].to_numpy(float)
    if len(h):
        np.subtract.at(last, path_of(h, digits), n + 0.5)
    model.leaves[WAYS - 1] = np.maximum(last, 0.5)
    for c in range(SINGLE, WAYS - 1):
        d = int(model.depth(np.array([c]))[0])
        model.leaves[c] = np.bincount(path_of(h[own == c], d), n[own == c] + 0.5, WAYS**d)
    mass = np.bincount(own, n + 0.5, WAYS) if len(h) else np.zeros(WAYS)
    mass[-1] = model.leaves[WAYS - 1].sum()
    nodes, made = [mass[None]], 1
    model.first_node = np.zeros((WAYS, MOST_DIGITS), np.int64)
    for c, leaves in model.leaves.items():
        for k in range(int(model.depth(np.array([c]))[0])):
            nodes.append(leaves.reshape(WAYS**k, WAYS, -1).sum(2))
            model.first_node[c, k] = made
            made += WAYS**k
    model.prior = np.log(np.concatenate(nodes) + 1e-9).astype(np.float32)
    return model


def contexts(h: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The tokens 1, 2 and 3 places before each, or a mark where the text starts in between."""
    n = len(h)
    where = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = []
    for k in (1, 2, 3):
        x = np.zeros(n, np.uint64)
        x[k:] = h[:-k] if n > k else h[:0]
        x[where < k] = np.uint64(k)
        back.append(x)
    return back


def examples(back: list[np.ndarray], classes: np.ndarray, hashes: np.ndarray, model: Model) -> list[tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Per digit: which tokens have it (None: all), their nodes, their rows of weights (features x tokens), and the digit."""
    at = lambda x: (C.mix64(x) & np.uint64(len(model.weights) - 1)).astype(np.int64)
    with np.errstate(over="ignore"):
        first = [back[0] * _SEEDS[0], back[0] * _SEEDS[1] + back[1] * _SEEDS[2], back[1] * _SEEDS[3] + np.uint64(7), back[2] * _SEEDS[4] + np.uint64(9)]
        out: list = [(None, np.zeros(len(classes), np.int64), np.stack([at(x) for x in first]), classes)]
        depth = model.depth(classes)
        before = back[0] * _SEEDS[5]
        paths = {d: path_of(hashes, d) for d in np.unique(depth).tolist() if d}
        for k in range(max(paths, default=0)):
            on = np.flatnonzero(depth > k)
            path = np.zeros(len(on), np.int64)
            for d, p in paths.items():
                if d > k:
                    these = depth[on] == d
                    path[these] = p[on[these]] >> BITS * (d - k - 1)
            node = model.first_node[classes[on], k] + (path >> BITS)
            mark = C.mix64(node.astype(np.uint64) + _SEEDS[6])
            out.append((on, node, at(mark + before[on])[None], path & (WAYS - 1)))
    return out


def log_softmax(model: Model, w: np.ndarray, node: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of the node's log masses and the sums of the rows ``f`` (features x tokens)."""
    z = model.prior.take(node, 0)
    for rows in f:
        z += w.take(rows, 0)
    top = z
    while top.shape[1] > 1:
        half = top.shape[1] // 2
        top = np.maximum(top[:, :half], top[:, half:])
    z -= top
    z -= np.log(np.exp(z) @ np.ones(WAYS, np.float32))[:, None]
    return z


def learn(model: Model, w: np.ndarray, square: np.ndarray, parts: list[tuple]) -> None:
    """One gradient step over the examples of a mini-batch, in place, its rate adapted to each row."""
    for _, node, f, y in parts:
        if not f.shape[1]:
            continue
        g = np.exp(log_softmax(model, w, node, f))
        g[np.arange(len(y)), y] -= 1
        flat = f.ravel()
        order = np.argsort(flat)
        rows = flat[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        sums, rows = np.add.reduceat(g.take(order % f.shape[1], 0), first, axis=0), rows[first]
        square[rows] += (sums * sums) @ np.full(WAYS, 1 / WAYS, np.float32)
        sums *= (RATE / np.sqrt(square.take(rows)))[:, None]
        w[rows] = w.take(rows, 0) - sums


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each chunk: its row, hashes, indices of its tokens, and lengths of its pieces, the context counted to the first."""
    for batch in C.slices(batches, 1):
        r = {n: batch.column(n)[0].as_py() for n in batch.schema.names}
        yield read(r)


def read(r: dict) -> tuple:
    h, sizes = np.frombuffer(r["hashes"], np.uint64), np.array(r["sizes"], np.int64)
    at = np.frombuffer(r["at"], "<u2" if len(h) < 1 << 16 else "<u4").astype(np.int64)
    sizes[0] += r["skip"]
    return r, h, at, sizes


def train(chunks: DataFrame, model: Model, tasks: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over the training tokens of all chunks."""
    w = model.weights
    rows = len(w)
    block = min(BLOCK_ROWS, rows)
    schema = C.arrow_schema(ddl := "block int, moved binary, tokens long")
    for share in range(rounds):
        part = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == share).select("held", "sizes", "skip", "at", "hashes").coalesce(tasks)

        def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            own, square, seen = w.copy(), np.full(len(w), START_SQUARE, np.float32), 0
            for r, h, at, sizes in _pieces(batches):
                on = np.repeat(~np.array(r["held"], bool), sizes)
                on[: r["skip"]] = False
                classes = model.class_of(h)
                back = contexts(h[at], sizes)
                which = np.flatnonzero(on)
                for lo in range(0, len(which), BATCH):
                    i = which[lo : lo + BATCH]
                    learn(model, own, square, examples([b[i] for b in back], classes[at[i]], h[at[i]], model))
                seen += len(which)
            if seen:
                moved = (own - w).reshape(-1, block, WAYS)
                for b in np.flatnonzero(np.abs(moved).max((1, 2)) > 0).tolist():
                    yield C.to_batch({"block": [b], "moved": [moved[b].astype(np.float16).tobytes()], "tokens": [seen]}, schema)

        def mean(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(block * WAYS), 0
            for t in tables:
                for m, k in zip(t["moved"], t["tokens"], strict=True):
                    total, n = total + np.frombuffer(m, np.float16).astype(float) * float(k), n + float(k)
            yield pd.DataFrame({"block": [key[0]], "moved": [(total / n).astype(np.float32).tobytes()]})

        moves = C.map_arrow(part, run, ddl, CHUNK_ROWS).groupBy("block").applyInPandas(mean, "block int, moved binary").toLocalIterator()  # at most MOST_ROWS / BLOCK_ROWS rows
        w = w.copy()
        for r in moves:
            w[r["block"] * block : (r["block"] + 1) * block] += np.frombuffer(r["moved"], np.float32).reshape(block, WAYS)
    return w


def chance(model: Model, h: np.ndarray, at: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token of a chunk."""
    out, classes, back = model.share(h, counts)[at], model.class_of(h), contexts(h[at], sizes)
    for lo in range(0, len(at), BATCH):
        i = slice(lo, lo + BATCH)
        for on, node, f, y in examples([b[i] for b in back], classes[at[i]], h[at[i]], model):
            got = log_softmax(model, model.weights, node, f)[np.arange(len(y)), y] / np.log(10)
            if on is None:
                out[i] += got
            else:
                out[lo + on] += got
    return out


def fitted(docs: DataFrame, held_out, id_col: str, text: str) -> tuple[DataFrame, DataFrame, Model]:
    """The settled chunks, the settled counts, and the trained model."""
    spark = C.own_session(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(CHUNK_ROWS), "spark.sql.parquet.columnarReaderBatchSize": "8"})
    chunks = C.settle(packed(docs, held_out, id_col, text), GROUP_BYTES, spark)
    entries, size = chunks.agg(F.sum(F.octet_length("hashes")) / 8, F.sum(F.octet_length("at"))).first()
    entries, size = int(entries or 0), int(size or 0)
    digits = next(d for d in range(MOST_DIGITS, -1, -1) if WAYS**d <= max(1, entries // 64))
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (entries // 32).bit_length()))
    counted = C.settle(totals(by_bucket(chunks, max(1, -(-entries // PER_BUCKET))), digits), GROUP_BYTES)
    model = start(counted.where("chunk = -1"), digits, rows)
    tasks = max(-(-size // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_TASK_BYTES)), 1)
    model.weights = train(chunks, model, tasks)
    return chunks, counted, model


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    chunks, counted, model = fitted(docs, held_out, id_col, text)
    total, distinct = model.total, model.distinct
    ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({f.partition(" ")[0]: [] for f in ddl.split(", ")})]
        right = right.sort_values("bucket")
        for r in left.to_dict("records"):
            r, h, at, sizes = read(r)
            c = np.concatenate([_thick(x, s) for x, s in zip(right["counts"], right["size"], strict=True)])
            base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            values = np.stack([np.ones(len(at)), (c > 0)[at], base[at], chance(model, h, at, sizes, c)])[:, r["skip"] :]
            sizes[0] -= r["skip"]
            ends = np.cumsum(sizes)
            some = sizes > 0
            sums = np.zeros((4, len(sizes)))
            if some.any():
                sums[:, some] = np.add.reduceat(values, (ends - sizes)[some], axis=1)
            ids = pd.array([None if i is None or i != i else int(i) for i in r["ids"]], "Int64")
            parts.append(pd.DataFrame({"row": r["rows"], "doc_id": ids, "held_out": np.asarray(r["held"], bool), "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base_score": sums[2], "score": sums[3]}))
        return pd.concat(parts[1:] or parts)

    back = counted.where("chunk >= 0").select("chunk", "bucket", "counts", "size")
    found = chunks.drop("counts").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(run, ddl)
    sums = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
