"""Near-duplicate documents by BagMinHash over word shingles.

A document is the multiset of its shingles of five words (ASCII lower case, split at white space).
BagMinHash: the weight axis of each shingle is cut at the integers and gathered into dyadic blocks [0,1),
[1,2), [2,4), [4,8) ... Each block has a Poisson process with its width as rate, seeded by the shingle and
the block alone; a point carries a slot and a place within the block, found by halving it bit by bit, and
counts for a document if that place lies below the shingle's weight. A slot keeps its least point, so two
documents agree in a slot with exactly the probability of their weighted Jaccard similarity. A process
stops at the largest value among the document's slots, beyond which no point can count.

Equal texts (by a 128-bit digest) are one node. Nodes that agree in one of ``BANDS`` bands of ``ROWS`` slots share
a bucket. In a bucket every node is compared with two pivots: the least node, and the node that shares most with
others (of copies of one text with changes, that text). Nodes of buckets that then still hold two classes are
searched exactly, by prefixes: the elements of their bags (a shingle and its how-manieth occurrence) are ordered by
how many of these nodes hold them, and two bags can only be similar enough if they share an element among the rarest
fifth, at places that leave room for the overlap that the similarity needs; for the shorter bag that is among its
rarest ninth (it is then open to others). So members of a family that are alike
by less than the threshold, whose rarest elements are their own, never meet. Nodes that do share such an element
form new buckets; rounds draw pivots among the open ones, those still without a link first and ``GROWTH`` times as
many per bucket each round, and compare them with all nodes of other classes in the bucket. A pivot has then met all
its bucket and leaves it; rounds end when no bucket with an open node holds two classes. No bucket is capped, and one whose nodes
are of one class is never expanded into pairs.
Pairs of which too few slots agree (``LEAST_SLOTS``, nearly five standard deviations below the threshold) are left
out; the others are verified on the whole texts by the exact weighted Jaccard similarity. Verified links are joined
into classes.

Defined results: a null text is empty; texts without words are alike only if equal; a text of one to four
words has one shingle, all of them; a class is named after its least id, and by null if none of its rows has one;
rows that share an id but not the text are classified by their texts; repeated rows get the same class; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import graph

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 28, 5
SLOTS = BANDS * ROWS
LEAST_SLOTS = 0.64
#: Pivots drawn per bucket, about, in the first round of draws, and how many times as many in each further one.
PIVOTS, GROWTH = 16, 8
#: Ids that are broadcast at most (8 bytes each); beyond, tables are joined by exchange.
SENT_IDS = 400_000
#: Pairs that one group of rows verifies at most, about.
STAR = 512
#: Stands for a null id; the greatest, so that a class is named after it only if it has no other id.
NO_ID = 2**63 - 1
_KEYS = ("__id", "__digest")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, with their counts, and how many each text has."""
    parts, sizes = [], []
    for lo, hi in C.chunks_of(texts):
        h, n = C.hash_words(texts[lo:hi])
        ends = np.cumsum(n)
        for e, k in zip(ends.tolist(), n.tolist(), strict=True):
            w = h[e - k : e]
            with np.errstate(over="ignore"):
                if k >= words:
                    s = w[: k - words + 1] * _MULT[0]
                    for j in range(1, words):
                        s = s + w[j : k - words + 1 + j] * _MULT[j]
                else:
                    s = (w * _MULT[:k]).sum(keepdims=True) if k else w
            parts.append(np.sort(C.mix64(s)))
            sizes.append(len(s))
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    sizes = np.array(sizes, np.int64)
    start = np.cumsum(sizes) - sizes
    new = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.zeros(0, bool)
    new[start[sizes > 0]] = True
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(every)))
    per = np.diff(np.searchsorted(first, np.append(start, len(every)))) if len(sizes) else sizes
    return every[first], counts, per


def bag_min_hash(elements: np.ndarray, weights: np.ndarray, per: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots) of bags: ``per[i]`` of the elements and integer weights are document i's."""
    docs = len(per)
    out = np.full(docs * slots, np.inf)
    doc = np.repeat(np.arange(docs), per)
    blocks = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1, 1)
    of = np.repeat(np.arange(len(elements)), blocks)
    level = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    doc, top = doc[of], weights[of].astype(np.uint64)
    width = np.where(level > 1, 1 << np.maximum(level - 1, 0), 1).astype(np.uint64)
    low = np.where(level > 0, width, 0).astype(np.uint64)
    x, rate = np.zeros(len(of)), width.astype(float)
    step, half = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
    with np.errstate(over="ignore"):
        seed = C.mix64(elements[of] + level.astype(np.uint64) * _MULT[6])
        bound = np.full(docs, np.inf)
        while len(doc):
            seed = seed + step
            u = C.mix64(seed)
            x = x - np.log(((u >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / rate
            on = x < bound[doc]
            doc, top, width, low, x, rate, seed, u = (a[on] for a in (doc, top, width, low, x, rate, seed, u))
            v = C.mix64(u ^ _MULT[1])
            slot = ((v & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> half
            counts = low + (((v >> half) * width) >> half) < top
            np.minimum.at(out, doc[counts] * slots + slot[counts].astype(np.int64), x[counts])
            bound = out.reshape(docs, slots).max(1)
    return out.reshape(docs, slots)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (ascending elements, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 1.0


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, d, text``: the digest of the text as 16 bytes; a null text is empty."""
    held = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.unhex(F.md5(held.cast("binary"))).alias("d"), held.alias("text"))


def signatures(rows: DataFrame) -> DataFrame:
    """``id, d`` and ``codes``: 16 bits of each slot, null without words."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t.encode() for t in C.texts_of(batch)]
        codes: list[bytes | None] = []
        for lo, hi in C.chunks_of(texts, 4 << 20):
            elements, weights, per = shingles([t.lower() for t in texts[lo:hi]])
            sig = C.mix64(bag_min_hash(elements, weights, per).view(np.uint64)).astype(np.uint16)
            codes += [s.tobytes() if n else None for s, n in zip(sig, per.tolist(), strict=True)]
        return {"id": batch.column("id"), "d": batch.column("d"), "codes": codes}

    return C.map_rows(rows, run, "id long, d binary, codes binary")


def _agreeing(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of which enough slots agree."""
    codes = nodes.select("id", "codes")
    rows = pairs.join(codes.select(F.col("id").alias("a"), F.col("codes").alias("ca")), "a").join(codes.select(F.col("id").alias("b"), F.col("codes").alias("cb")), "b").select("a", "b", "ca", "cb")

    def run(batch: pa.RecordBatch) -> dict:
        ca, cb = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for n in ("ca", "cb"))
        on = (ca == cb).mean(1) >= least
        return {n: batch.column(n).to_numpy()[on] for n in ("a", "b")}

    return C.map_rows(rows, run, "a long, b long")


def some_of(df: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """``df`` joined with a table of ids by ``how``; these are broadcast only if counted as few."""
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Of pairs (a, b), those whose bags are similar. ``texts``: id, text.

    The members b of a pivot a are dealt into as many groups as keep each at about ``STAR``, with a copy of the
    pivot's text in each; sorted, a group is read as a stream: first the pivot, then its members.
    """
    n = pairs.count()
    sent = F.broadcast if n <= SENT_IDS // 4 else lambda df: df  # 24 bytes each
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("groups"))
    dealt = pairs.join(sent(groups), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    members = texts.select(F.col("id").alias("b"), "text").join(sent(dealt), "b").select("a", "part", F.lit(1).alias("kind"), "b", "text")
    pivots = texts.select(F.col("id").alias("a"), "text").join(sent(dealt.select("a", "part").distinct()), "a").select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rows = pivots.unionByName(members).repartition(C.partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "kind").select("a", "kind", "b", "text")
    schema = C.arrow_schema("u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: list = []
        for batch in batches:
            found = []
            for a, kind, b, t in zip(*(batch.column(n).to_pylist() for n in ("a", "kind", "b", "text")), strict=True):
                bag = shingles([(t or "").encode().lower()])[:2]
                if kind == 0:
                    pivot = [bag] if not pivot or pivot[0] != a else [*pivot[1:], bag]
                    pivot = [a, *pivot]
                elif any(similarity(p, bag) >= similar for p in pivot[1:]):
                    found.append((a, b))
            if found:
                yield C.to_batch(dict(zip("uv", zip(*found, strict=True), strict=True)), schema)

    return C.map_arrow(rows, run, "u long, v long", 256)


def _first_pivots(buckets: DataFrame) -> DataFrame:
    """``key, pivots``: the least id of each bucket and the node that shares most with others."""
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    share = buckets.join(shared, "key").groupBy("id").agg(F.sum("n").alias("n"))
    return buckets.join(share, "id").groupBy("key").agg(F.array(F.min("id"), F.min(F.struct(-F.col("n"), "id"))["id"]).alias("pivots"))


def _undecided(buckets: DataFrame, links: DataFrame | None) -> DataFrame:
    """``buckets`` that hold nodes of two classes and an open one, with ``class, linked, n, lone``; ``lone`` of the ``n`` open nodes have no link."""
    of = buckets.withColumns({"class": F.col("id"), "linked": F.lit(False)})
    if links is not None:
        heads = links.select(F.col("v").alias("id"), F.col("v").alias("head")).distinct()
        known = links.select(F.col("u").alias("id"), F.col("v").alias("head")).unionByName(heads)
        of = some_of(buckets, known, "id", "left").withColumns({"class": F.coalesce("head", "id"), "linked": F.col("head").isNotNull()}).drop("head")
    two = of.groupBy("key").agg(F.count_if("open").alias("n"), F.count_if(F.col("open") & ~F.col("linked")).alias("lone"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high AND n > 0")
    return of.join(two.select("key", "n", "lone"), "key")


def _prefixes(texts: DataFrame, similar: float) -> DataFrame:
    """``key, id, size, place, open``: the elements in the prefix of each bag that other bags hold, too."""

    def run(batch: pa.RecordBatch) -> dict:
        bags = [shingles([t.encode().lower()])[:2] for t in C.texts_of(batch)]
        with np.errstate(over="ignore"):
            nth = [np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for _, n in bags]
            elements = [C.mix64(np.repeat(e, n) + k.astype(np.uint64) * _MULT[6]).view(np.int64) for (e, n), k in zip(bags, nth, strict=True)]
        return {"id": batch.column("id"), "size": [len(e) for e in elements], "elements": elements}

    bags = C.settle(C.map_rows(texts, run, "id long, size int, elements array<long>", 256))
    held = bags.select("id", "size", F.explode("elements").alias("key"))
    common = held.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    shared = held.join(common, "key")
    order = Window.partitionBy("id").orderBy("nodes", "key")  # of one bag
    placed = shared.withColumn("place", F.row_number().over(order) - 1 + F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("id")))
    prefix = placed.where(F.col("place") <= F.col("size") * (1 - similar) + 1e-6)
    return C.settle(prefix.select("key", "id", "size", F.col("place").cast("int").alias("place"), (F.col("place") <= F.col("size") * (1 - similar) / (1 + similar) + 1e-6).alias("open")))


def _drawn(rows: DataFrame, most: int, turn: int) -> DataFrame:
    """``rows`` with ``drawn``: about ``most`` open nodes of a bucket, all if it has no more, those without a link first."""
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(turn)), F.greatest(F.col(n), F.lit(1))) < most
    return rows.withColumn("drawn", F.when(~F.col("open"), False).when(F.col("n") <= most, True).when(F.col("lone") > 0, ~F.col("linked") & place("lone")).otherwise(place("n")))


def _candidates(rows: DataFrame, similar: float) -> DataFrame:
    """Distinct pairs (drawn pivot a, member b) of different classes that share a bucket at places that leave room for the overlap."""
    pivots = rows.where("drawn").groupBy("key").agg(F.collect_list(F.struct("id", "class", "size", "place")).alias("pivots"))
    room = lambda p: F.least(p["size"] - p["place"], F.col("size") - F.col("place")) >= (p["size"] + F.col("size")) * (similar / (1 + similar)) - 1e-6
    new = lambda p: (p["class"] != F.col("class")) & (~F.col("drawn") | (p["id"] < F.col("id"))) & room(p)
    pairs = rows.join(pivots, "key").select("id", F.explode(F.filter("pivots", new)["id"]).alias("a"))
    return pairs.select("a", F.col("id").alias("b")).distinct()


def _links(rows: DataFrame, signed: DataFrame, alike: DataFrame, similar: float) -> DataFrame | None:
    """``u, v``: the nodes that are joined to another one, and the least node of their class; None if there are none."""
    nodes = C.settle(signed.where("codes IS NOT NULL").join(alike.select("d", F.col("least").alias("id"), F.col("id").alias("node")), ["d", "id"]).select(F.col("node").alias("id"), "codes").dropDuplicates(["id"]))
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring(F.col("codes"), 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])
    banded = nodes.select("id", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    buckets = C.settle(banded.join(shared, "key", "left_semi"))
    wanted = alike.join(buckets.select("id").distinct(), "id", "left_semi").select("d", F.col("least").alias("id"), F.col("id").alias("node"))
    texts = C.settle(some_of(rows, wanted, ["d", "id"], "inner").select(F.col("node").alias("id"), "text"))
    check = lambda pairs: C.settle(verified(C.settle(_agreeing(pairs, nodes, LEAST_SLOTS)), texts, similar))
    first = C.settle(_first_pivots(buckets))
    met = buckets.join(first, "key")
    found = check(met.select("id", F.explode(F.array_distinct("pivots")).alias("a")).where("id <> a").select("a", F.col("id").alias("b")).distinct())
    links = None if found.isEmpty() else graph.components(found)
    left = C.settle(_undecided(met.where(~F.array_contains("pivots", F.col("id"))).select("key", "id", F.lit(True).alias("open")), links).select("id").distinct())
    if left.isEmpty():
        return links
    buckets, most, turn = _prefixes(some_of(texts, left, "id", "left_semi"), similar), PIVOTS, 0
    while True:
        drawn = C.settle(_drawn(_undecided(buckets, links), most, turn))
        if drawn.isEmpty():
            return links
        found = check(_candidates(drawn, similar))
        if not found.isEmpty():
            links = graph.components(found if links is None else links.unionByName(found))
        buckets, most, turn = drawn.where(~F.col("drawn")).select("key", "id", "size", "place", "open"), most * GROWTH, turn + 1


def _classified(docs: DataFrame, id_col: str, text: str, similar: float) -> tuple[DataFrame, DataFrame]:
    """``id, d`` of every row, and ``d, least, v, class`` of every text: the least id of its rows, its class's node, and the least id there."""
    rows = keyed(docs, id_col, text)
    signed = C.settle(signatures(rows))
    alike = C.settle(signed.groupBy("d").agg(F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id()))  # settled, so a node keeps its number
    links = _links(rows, signed, alike, similar)
    if links is None:
        return signed.select("id", "d"), alike.select("d", "least", F.col("id").alias("v"), F.col("least").alias("class"))
    of = alike.join(links.select(F.col("u").alias("id"), "v"), "id", "left").select("d", "least", F.coalesce("v", "id").alias("v"))
    joined = links.select("v").distinct()
    names = some_of(of, joined, "v", "left_semi").groupBy("v").agg(F.min("least").alias("class"))
    return signed.select("id", "d"), some_of(of, names, "v", "left").select("d", "least", "v", F.coalesce("class", "least").alias("class"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id`` per row: the least id among all documents that chains of similar ones connect."""
    rows, of = _classified(docs, id_col, text, similar)
    return rows.join(of, "d").select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.nullif("class", F.lit(NO_ID)).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class only: of the least id, then of the least digest."""
    rows, of = _classified(docs, id_col, text, similar)
    rows, of = C.settle(rows), C.settle(of)
    many = of.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("least", "d")).alias("first")).where("n > 1")
    others = some_of(of, many.select("v", "first"), "v", "inner").where(F.col("first.d") != F.col("d")).select("d")
    held = docs.withColumns({_KEYS[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), _KEYS[1]: F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))})
    named = lambda df: df.select(*[F.col(c).alias(k) for c, k in zip(("id", "d"), _KEYS, strict=True) if c in df.columns])
    kept = some_of(held, named(C.settle(others)), [_KEYS[1]], "left_anti")
    copies = rows.join(of.select("d", "least"), "d").where("id <> least").select("id", "d").distinct()
    kept = some_of(kept, named(C.settle(copies)), list(_KEYS), "left_anti")
    again = C.settle(rows.groupBy("id", "d").count().where("count > 1").select("id", "d"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = some_of(kept, named(again), list(_KEYS), "left_semi").dropDuplicates(list(_KEYS))
    return some_of(kept, named(again), list(_KEYS), "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
