"""Approximate nearest neighbours over balanced posting lists.

Largest inner product becomes smallest distance by one more component: sqrt(M^2 - |x|^2) for a vector, M
the largest norm, and 0 for a query. On a bounded sample of these vectors, k-means with a price on full
clusters gives centroids of about equal lists. Every vector goes to its nearest centroid, and, if it lies
near a boundary, also to others whose distance is within ``NEAR`` of the nearest and that does not
lie close to a chosen one, against the vector's own distance (at most ``COPIES`` lists).

A query searches the centroids by a best-first walk on their neighbour graph, held in each worker's
memory, and reads the lists whose distance is within a ratio of the nearest one's. The ratio is the least
that would have found ``CAUGHT`` of the true neighbours in the sample, in any list that they stand in, for queries drawn at
random from rows of it that the centroids are not fitted on; at least ``FLOOR`` vectors are read. Data without clusters so read many lists. Lists whose centroids
lie together form a group, so a query is sent to the few groups around it, and groups are split by id into blocks of about
``BLOCK`` vectors; a task holds one block as a matrix and streams the queries that ask for lists of the group past it. So a
list of any size is split, and a list asked for by all queries needs no more memory.

Defined results: vectors that are null, zero, of another length than most, or hold a null or a non-finite
component take no part, neither as query nor as candidate; a null id takes no part; of rows that share an
id the best counts once and a query's own id is never its result; equal scores go to the smaller id; a
query without candidates has no row; an empty table gives an empty result. Scores are sums in component
order in double precision, so equal vectors score equally.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Rows that the centroids are fitted on, about; vectors per list; the most lists.
FIT_ROWS, PER_LIST, MOST_LISTS = 20_000, 256, 4096
COPIES, NEAR = 3, 1.1
CAUGHT, FLOOR, BEAM = 0.97, 1024, 64
#: Rows of the sample that the reading ratio is set from, at most; the centroids are not fitted on them.
ASKING = 512
BLOCK, LEAST_GROUPS = 4096, 16


@dataclass
class Centroids:
    points: np.ndarray  # lists x (dimensions + 1)
    graph: np.ndarray  # lists x neighbours
    norm: float
    ratio: float = 1.0

    def nearest(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """About the ``ef`` nearest centroids, nearest first, by a walk on the graph, and their distances."""
        start = [0, len(self.points) // 2]
        far = lambda ids: np.sqrt(((self.points[ids] - q) ** 2).sum(1))
        seen, todo, best = set(start), [], []
        for i, d in zip(start, far(start).tolist(), strict=True):
            if (d, i) not in todo:
                heappush(todo, (d, i))
                heappush(best, (-d, i))
        while todo:
            d, i = heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.graph[i].tolist() if j not in seen]
            if new:
                seen.update(new)
                for j, e in zip(new, far(new).tolist(), strict=True):
                    if len(best) < ef or e < -best[0][0]:
                        heappush(todo, (e, j))
                        heappush(best, (-e, j))
                        if len(best) > ef:
                            heappop(best)
        out = sorted({(-d, i) for d, i in best})
        return np.array([i for _, i in out]), np.array([d for d, _ in out])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``id, v`` (doubles) of the rows that take part, and their dimension."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    rows = rows.where(F.col("id").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = size["d"] if size else 0
    return rows.where(F.size("v") == d), d


def matrix(batch: pa.RecordBatch, d: int, name: str = "v") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate((v, np.sqrt(np.maximum(norm**2 - (v * v).sum(1), 0))[:, None]), axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _own(x: np.ndarray, points: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list of each row at these prices, and the distance of its nearest centroid."""
    own, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), 1024):
        far = distances(x[lo : lo + 1024], points)
        own[lo : lo + 1024], least[lo : lo + 1024] = (far + price).argmin(1), far.min(1)
    return own, least


def places(x: np.ndarray, points: np.ndarray) -> list[list[int]]:
    """The lists that each (lifted) row stands in, its nearest first."""
    out: list[list[int]] = []
    for lo in range(0, len(x), 1024):
        far = distances(x[lo : lo + 1024], points)
        order = np.argpartition(far, min(COPIES, far.shape[1] - 1), axis=1)[:, :COPIES]
        order = np.take_along_axis(order, np.take_along_axis(far, order, 1).argsort(1, kind="stable"), 1)
        for f, cs in zip(far, order.tolist(), strict=True):
            taken: list[int] = []
            for c in cs:
                if not taken or (f[c] <= NEAR * f[taken[0]] and all(((points[c] - points[t]) ** 2).sum() >= 0.25 * f[c] ** 2 for t in taken)):
                    taken.append(c)
            out.append(taken)
    return out


def fit(rows: DataFrame, d: int, fit_rows: int = FIT_ROWS, per_list: int = PER_LIST) -> Centroids | None:
    n, norm = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    held = rows.where(draw < min(1.0, fit_rows / n)).orderBy("id").limit(2 * fit_rows).select("v").toArrow()
    if not held.num_rows:
        held = rows.orderBy("id").limit(1).select("v").toArrow()
    norm = float(np.sqrt(norm))
    x = lifted(np.array(held.column("v").to_pylist(), float).reshape(-1, d), norm)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    apart = order[: min(ASKING, len(x) // 5)]
    every, x = x, x[np.sort(order[len(apart) :])]
    lists = int(min(MOST_LISTS, max(1, -(-n // per_list)), max(1, len(x) // 4)))
    points = x[rng.choice(len(x), lists, replace=False)]
    price, fair = np.zeros(lists), len(x) / lists
    for _ in range(10):
        own, least = _own(x, points, price)
        size = np.bincount(own, minlength=lists)
        price = np.maximum(0, price + 0.05 * least.mean() * (size / fair - 1))
        sums = np.zeros_like(points)
        np.add.at(sums, own, x)
        points = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), lists)])
    near = distances(points, points)
    graph = near.argsort(1, kind="stable")[:, 1 : 1 + min(16, lists - 1)] if lists > 1 else np.zeros((1, 0), int)
    extra = rng.integers(0, lists, (lists, min(4, lists - 1)))  # long ways, so that the walk reaches every part
    asking = every[apart, :d] * (norm / np.maximum(np.sqrt((every[apart, :d] ** 2).sum(1)), 1e-300))[:, None]
    far = distances(np.concatenate((asking, np.zeros((len(asking), 1))), axis=1), points)
    tops = []
    for row, q in zip(apart, asking, strict=True):
        s = every[:, :d] @ q
        s[row] = -np.inf
        tops.append(np.argsort(-s, kind="stable")[: min(20, len(every) - 1)])
    ratios = []
    if tops:
        found = np.unique(np.concatenate(tops))
        of = dict(zip(found.tolist(), places(every[found], points), strict=True))
        ratios = [np.array([f[of[r]].min() for r in top.tolist()]) / max(f.min(), 1e-12) for f, top in zip(far, tops, strict=True)]
    ratio = float(np.quantile(np.concatenate(ratios), CAUGHT)) if ratios else float("inf")
    return Centroids(points, np.concatenate((graph, extra), axis=1), norm, ratio)


def postings(rows: DataFrame, d: int, centroids: Centroids) -> DataFrame:
    """``list, id, v``: each vector in the lists that it belongs to."""

    def run(batch: pa.RecordBatch) -> dict:
        taken = places(lifted(matrix(batch, d), centroids.norm), centroids.points)
        at = pa.array(np.repeat(np.arange(len(taken)), [len(t) for t in taken]), pa.int64())
        return {"list": [c for t in taken for c in t], "id": batch.column("id").take(at), "v": batch.column("v").take(at)}

    return C.map_rows(rows, run, "list int, id long, v array<double>")


def neighbourhoods(points: np.ndarray, sizes: np.ndarray, groups: int) -> np.ndarray:
    """The group of each list: centroids halved again and again across their longest axis, by about equal numbers of vectors."""
    group = np.zeros(len(points), np.int32)
    todo = [(np.arange(len(points)), 0, groups)]
    while todo:
        lists, first, n = todo.pop()
        group[lists] = first
        if n > 1 and len(lists) > 1:
            x = points[lists] - points[lists].mean(0)
            axis = np.linalg.eigh(x.T @ x)[1][:, -1]
            lists = lists[np.argsort(x @ axis, kind="stable")]
            held = np.cumsum(sizes[lists] + 1.0)
            cut = int(np.clip(np.searchsorted(held, held[-1] * (n // 2) / n), 1, len(lists) - 1))
            todo += [(lists[:cut], first, n // 2), (lists[cut:], first + n // 2, n - n // 2)]
    return group


def asked(queries: DataFrame, d: int, centroids: Centroids, sizes: np.ndarray, group_of: np.ndarray, blocks: np.ndarray) -> DataFrame:
    """``group, block, lists, id, v``: each query with the lists that it reads, by group, for every block of it."""

    def run(batch: pa.RecordBatch) -> dict:
        v, out = matrix(batch, d), {"group": [], "block": [], "lists": [], "row": []}
        lifted_q = np.concatenate((v * (centroids.norm / np.maximum(np.sqrt((v * v).sum(1)), 1e-300))[:, None], np.zeros((len(v), 1))), axis=1)
        for i, q in enumerate(lifted_q):
            ef = BEAM
            while True:
                c, far = centroids.nearest(q, ef)
                held = np.cumsum(sizes[c])
                if (far[-1] > centroids.ratio * far[0] and held[-1] >= FLOOR) or ef >= len(centroids.points):
                    break
                ef *= 2
            c = c[: max(int((far <= centroids.ratio * far[0]).sum()), int(np.searchsorted(held, FLOOR)) + 1)]
            # a group that holds several of these lists is asked once
            group = group_of[c]
            for g in np.unique(group).tolist():
                n = int(blocks[g])
                out["group"] += [g] * n
                out["block"] += range(n)
                out["lists"] += [c[group == g].astype(np.int32)] * n
                out["row"] += [i] * n
        at = pa.array(out["row"], pa.int64())
        return {"group": out["group"], "block": out["block"], "lists": out["lists"], "id": batch.column("id").take(at), "v": batch.column("v").take(at)}

    return C.map_rows(queries, run, "group int, block int, lists array<int>, id long, v array<double>")


def nearest_rows(q: np.ndarray, q_ids: np.ndarray, lists: list[list[int]], block: list[np.ndarray], k: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query_id, vec_id, score`` of the ``k`` best rows of a block (ids, vectors, lists) for each query that reads these lists.

    Scores of the ``wanted`` rows that may be among the best are summed anew in component order; of rows of one id the
    best counts, and a query that finds fewer ids than ``k`` among them looks at all rows.
    """
    ids, v, of = block
    scores = q @ v.T
    reads = np.zeros((len(q), int(of.max()) + 1), bool)
    for i, own in enumerate(lists):
        reads[i, [c for c in own if c < reads.shape[1]]] = True
    on = reads[:, of] & (ids != q_ids[:, None])
    rows = on.sum(1)
    if len(ids) > wanted:
        held = np.where(on, scores, -np.inf)
        least = np.partition(held, len(ids) - wanted, axis=1)[:, len(ids) - wanted, None]
        on &= ~(scores < least - 1e-9 * (1 + np.where(np.isinf(least), 0, np.abs(least))))
    at, row = np.nonzero(on)
    x = np.zeros(len(at))
    for j in range(v.shape[1]):
        x += q[at, j] * v[row, j]
    order = np.lexsort((-x, ids[row], at))
    at, row, x = at[order], row[order], x[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (ids[row[1:]] != ids[row[:-1]])
    at, row, x = at[new], row[new], x[new]
    order = np.lexsort((ids[row], -x, at))
    at, row, x = at[order], row[order], x[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    again = np.flatnonzero((np.bincount(at, minlength=len(q)) < k) & (rows > wanted))
    if len(again):
        first &= ~np.isin(at, again)
        more = nearest_rows(q[again], q_ids[again], [lists[i] for i in again.tolist()], block, k, len(ids))
        return tuple(np.concatenate(p) for p in zip((q_ids[at[first]], ids[row[first]], x[first]), more, strict=True))
    return q_ids[at[first]], ids[row[first]], x[first]


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row for which ``is_query`` (a Column of ``id``) holds."""
    spark = vectors.sparkSession
    rows, d = usable(vectors, id_col, vector)
    centroids = fit(rows, d, fit_rows) if d else None
    if centroids is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = C.settle(postings(rows, d, centroids))
    sizes = np.zeros(len(centroids.points), np.int64)
    for r in held.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    groups = max(LEAST_GROUPS, -(-int(sizes.sum()) // BLOCK))
    group_of = neighbourhoods(centroids.points, sizes, groups)
    blocks = np.maximum(1, -(-np.bincount(group_of, sizes, groups).astype(np.int64) // (2 * BLOCK)))
    of = spark.createDataFrame(pa.table({"list": pa.array(range(len(sizes)), pa.int32()), "group": group_of, "blocks": blocks[group_of]}))
    left = held.join(F.broadcast(of), "list")  # at most MOST_LISTS rows
    left = left.select("group", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), F.array("list").alias("lists"), "id", "v")
    queries = asked(rows.where(is_query(F.col("id"))).repartition(C.partitions(spark)), d, centroids, sizes, group_of, blocks)
    right = queries.select("group", "block", F.lit(1).alias("kind"), "lists", "id", "v")
    dealt = left.unionByName(right).repartition(C.partitions(spark), "group", "block").sortWithinPartitions("group", "block", "kind")
    schema = C.arrow_schema(ddl := "query_id long, vec_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, whole = None, [], None
        for batch in batches:
            key = batch.column("group").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy()
            kind, ids, v = batch.column("kind").to_numpy(), batch.column("id").to_numpy(), matrix(batch, d)
            lists = batch.column("lists").to_pylist()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(key)), strict=True):
                if key[a] != now:
                    now, parts, whole = key[a], [], None
                if kind[a] == 0:
                    parts.append((ids[a:b], v[a:b], np.array([x[0] for x in lists[a:b]])))
                    continue
                if not parts:
                    continue
                if whole is None:
                    whole = [np.concatenate([p[j] for p in parts]) for j in range(3)]
                for lo in range(a, b, 256):
                    hi = min(lo + 256, b)
                    out.append(nearest_rows(v[lo:hi], ids[lo:hi], lists[lo:hi], whole, k, COPIES * k))  # copies of a vector may stand in several lists
            if out:
                yield C.to_batch({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(schema.names)}, schema)

    found = C.map_arrow(dealt, run, ddl).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
