"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on a document. Expectation-maximisation over the counts of
all vote patterns estimates, for either class, how often each labeller casts each vote, and how common
the class is; no label is read. The posterior of a document's votes then is the target of a logistic
regression over hashed features (shape trigrams, runs, repetition). Its score is the probability of a good document,
and it alone decides: those below a threshold are rejected. The threshold is the greatest, up to ``KEEP``, that keeps
``STAY`` of the documents that the label model takes for good.

Votes, weights and threshold come from every document with a word. Features are worked out once and settled; each pass
over them gives the loss and its gradient at one point to L-BFGS, until no slope is over ``STEEP`` or ``PASSES`` are done.
Sums are of whole numbers, so how the rows are dealt does not matter. The threshold is an exact order statistic.

Defined results: a null text is empty; on texts of fewer than ``FEW`` words only the labellers of ``SHORT`` vote, and
not for a first occurrence; a text without any character gets score 0 and is rejected; repeated rows get equal
scores; an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FEATURES = 4096
#: The fit ends when no slope of the mean loss is steeper, or after so many passes; price of squared weights; steps remembered.
STEEP, PASSES, PRICE, REMEMBERED = 1e-4, 60, 1e-5, 10
FEW = 16
KEEP, STAY = 0.5, 0.999
GOOD, NONE, BAD = 1, 0, -1
#: name, measure, bad if beyond, good if within (reversed for measures that should be large).
LABELLERS = (
    ("symbols", "symbol", 0.06, 0.02),
    ("pipes", "pipe", 0.08, 0.02),
    ("shouting", "upper", 0.4, 0.15),
    ("exclaiming", "exclaim", 0.15, 0.05),
    ("repeated", "repeat", 0.35, 0.12),
    ("one word", "top", 0.2, 0.12),
    ("echo", "echo", 0.1, 0.04),
    ("function words", "short", -0.12, -0.25),
    ("word ends", "odd_end", 0.4, 0.15),
    ("word length", "long", 9.5, 7.5),
)
SHORT = ("symbols", "pipes", "word ends")
MEASURES = ("symbol", "pipe", "upper", "exclaim", "repeat", "top", "echo", "short", "odd_end", "long")

_KIND: np.ndarray | None = None
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, EXCLAIM, PIPE, SYMBOL, MARK, OTHER = range(12)


def _kinds() -> np.ndarray:
    """The kind of every code point."""
    global _KIND
    if _KIND is None:
        kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                kind[i] = UPPER if c.isupper() else LOWER
            elif c.isdigit():
                kind[i] = DIGIT
            elif c.isspace():
                kind[i] = SPACE
        for chars, k in (("\n", LINE), (".", STOP), (",", COMMA), ("!", EXCLAIM), ("|", PIPE), ("#$%&*@^~\\<>{}=+_", SYMBOL), ("\"'()-:;?/[]", MARK)):
            kind[[ord(c) for c in chars]] = k
        _KIND = kind
    return _KIND


def measure(text: str) -> tuple[dict[str, float], np.ndarray, int]:
    """The measures, the counts of shape trigrams, and the number of words."""
    kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    n = np.bincount(kind, minlength=12)
    space = (kind == SPACE) | (kind == LINE)
    padded = np.concatenate(([True], space, [True]))
    starts = np.flatnonzero(padded[:-1] & ~padded[1:])
    ends = np.flatnonzero(~padded[:-1] & padded[1:])
    sizes = ends - starts
    words = len(sizes)
    shape = kind.astype(np.int64)
    grams = np.bincount(shape[:-2] * 144 + shape[1:-1] * 12 + shape[2:], minlength=1728) if len(kind) > 2 else np.zeros(1728, np.int64)
    if not words:
        return dict.fromkeys(MEASURES, 0.0), grams, 0
    h = C.hash_words([text.encode()])[0]
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            three = np.sort(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))
        repeat = float((three[1:] == three[:-1]).mean()) if len(three) > 1 else 0.0
    else:
        repeat = 0.0
    ordered = np.sort(h)
    runs = np.diff(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))))
    letters = n[LOWER] + n[UPPER]
    free = int(words < FEW)  # occurrences that say nothing
    ends_odd = ~np.isin(kind[ends - 1], (LOWER, UPPER, DIGIT, STOP, COMMA, MARK))
    got = {
        "symbol": max(0, n[SYMBOL] - free) / (n.sum() - n[SPACE] - n[LINE]),
        "pipe": max(0, n[PIPE] - free) / words,
        "upper": n[UPPER] / letters if letters else 1.0,
        "exclaim": n[EXCLAIM] / words,
        "repeat": repeat,
        "top": float(runs.max() / words) if len(runs) and words >= 20 else 0.0,
        "echo": float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0,
        "short": float((sizes <= 3).mean()),
        "odd_end": max(0, int(ends_odd.sum()) - free) / words,
        "long": float(sizes.mean()),
    }
    return got, grams, words


def votes(got: dict[str, float], words: int) -> list[int]:
    out = []
    for label, name, bad, good in LABELLERS:
        if words < FEW and (label not in SHORT or not words):
            out.append(NONE)
            continue
        v = got[name] if bad > 0 else -got[name]
        out.append(BAD if v >= bad else GOOD if v <= good else NONE)
    return out


def features(got: dict[str, float], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: the shares of shape trigrams, damped, and the buckets of the measures."""
    at = np.flatnonzero(grams)
    share = np.sqrt(grams[at] / max(1, grams.sum()))
    bucket = np.array([1728 + 16 * i + min(15, int(15 * min(1.0, got[m] / (12 if m == "long" else 1)))) for i, m in enumerate(MEASURES)])
    where = C.mix64(np.concatenate((at, bucket)).astype(np.uint64)) % np.uint64(FEATURES)
    return where.astype(np.int32), np.concatenate((share, np.full(len(bucket), 0.5))).astype(np.float32)


def pattern_of(v: list[int]) -> int:
    p = 0
    for x in v:
        p = p * 3 + x + 1
    return p


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, x = divmod(pattern, 3)
        out.append(x - 1)
    return out[::-1]


@dataclass
class LabelModel:
    """Class shares and, per labeller and class, the chances of a bad and a good vote where it votes; none says nothing."""

    prior: float
    chance: np.ndarray  # labellers x (bad, good) x (bad, none, good vote)

    @classmethod
    def fit(cls, counts: dict[int, int], rounds: int = 60) -> LabelModel:
        model = cls(0.8, np.tile(np.array([[0.8, 1.0, 0.2], [0.2, 1.0, 0.8]]), (len(LABELLERS), 1, 1)))
        silent = pattern_of([NONE] * len(LABELLERS))
        counts = {k: c for k, c in counts.items() if k != silent}
        if not counts:
            return model
        v = np.array([votes_of(p) for p in counts]) + 1
        n = np.array(list(counts.values()), float)
        one = np.eye(3)[v]  # patterns x labellers x votes
        # start: a labeller speaks up rarely and with reason, so one bad vote is bad
        good = np.where((v == 0).any(1), 0.05, 0.95)
        for _ in range(rounds):
            for k, w in ((0, n * (1 - good)), (1, n * good)):
                seen = np.einsum("p,plv->lv", w, one) + np.array([[1.0, 0.0, 1.0], [0.1, 0.0, 2.0]][k])
                seen[:, 1] = 0
                model.chance[:, k] = seen / seen.sum(1, keepdims=True)
            model.chance[:, :, 1] = 1
            model.prior = float(np.clip((n * good).sum() / n.sum(), 0.02, 0.98))
            good = model.posterior(v)
        return model

    def posterior(self, v: np.ndarray) -> np.ndarray:
        rows = np.arange(len(LABELLERS))
        silent = (v == 1).all(1)
        good = np.log(self.prior) + np.log(self.chance[rows, 1, v]).sum(1)
        bad = np.log(1 - self.prior) + np.log(self.chance[rows, 0, v]).sum(1)
        return np.where(silent, self.prior, 1 / (1 + np.exp(np.clip(bad - good, -60, 60))))


def learnt_from(docs: DataFrame, text: str = "text") -> DataFrame:
    """The vote pattern and the features of every document, settled; no features without a word."""

    def run(batch: pa.RecordBatch) -> dict:
        seen = [measure(t) for t in C.texts_of(batch)]
        made = [features(m, g) if n else None for m, g, n in seen]
        return {"pattern": [pattern_of(votes(m, n)) for m, _, n in seen], "at": [f and f[0].astype(np.uint16).tobytes() for f in made], "x": [f and f[1].tobytes() for f in made]}

    return C.settle(C.map_rows(docs.select(F.col(text).alias("text")), run, "pattern long, at binary, x binary"))


def logits(weights: np.ndarray, bias: float, at: np.ndarray, x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` documents, each the same to the last bit whatever stands beside it."""
    return np.bincount(row, weights[at] * x, n) + bias


def chance_of(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Quality:
    labels: LabelModel
    weights: np.ndarray
    bias: float
    threshold: float = KEEP

    def score(self, text: str) -> tuple[float, list[int], float]:
        got, grams, words = measure(text)
        v = votes(got, words)
        post = float(self.labels.posterior(np.array([v]) + 1)[0])
        if not words:
            return 0.0, v, post
        at, x = features(got, grams)
        return float(chance_of(logits(self.weights, self.bias, at, x, np.zeros(len(at), np.int64), 1))[0]), v, post

    def keeps(self, value: float) -> bool:
        return value > 0 and value >= self.threshold


@dataclass
class Targets:
    """What the label model makes of each vote pattern that occurs in documents with words, and how many these are."""

    patterns: np.ndarray  # ascending
    good: np.ndarray
    count: np.ndarray

    def __post_init__(self) -> None:
        self.n, self.n_good = int(self.count.sum()), int(self.count[self.good >= 0.5].sum())
        self.balance = np.where(self.good >= 0.5, 1.0, min(5.0, max(1.0, self.n_good / max(1, self.n - self.n_good))))
        self.unit = 2.0 ** min(30, 50 - self.n.bit_length())  # sums of whole units fit 64 bits, a batch's 53

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Places in ``patterns``, features (at, x, row) and number of rows, batch by batch."""
        for batch in C.slices(batches):
            held = batch.column("at").to_pylist()
            at, x = np.frombuffer(b"".join(held), np.uint16), np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32)
            row = np.repeat(np.arange(len(held)), np.fromiter((len(b) // 2 for b in held), np.int64, len(held)))
            yield np.searchsorted(self.patterns, batch.column("pattern").to_numpy()), at, x, row, len(held)

    def loss(self, rows: DataFrame, point: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean loss over all ``rows`` with the price of the weights, and its gradient; the bias stands last in ``point``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(FEATURES + 2, np.int64)  # weights, bias, loss
            for place, at, x, row, n in self.blocks(batches):
                z, y, balance = logits(point[:-1], point[-1], at, x, row, n), self.good[place], self.balance[place] * self.unit
                d = (chance_of(z) - y) * balance
                z = np.clip(z, -700, 700)
                sums[:FEATURES] += np.bincount(at, np.rint(d[row] * x), FEATURES).astype(np.int64)
                sums[FEATURES] += int(np.rint(d).sum())
                sums[FEATURES + 1] += int(np.rint((np.logaddexp(0, z) - y * z) * balance).sum())
            on = np.flatnonzero(sums)
            yield C.to_batch({"at": on, "units": sums[on]}, target)

        target, sums = C.arrow_schema("at int, units long"), np.zeros(FEATURES + 2)
        for r in rows.mapInArrow(run, "at int, units long").groupBy("at").agg(F.sum("units").alias("units")).collect():
            sums[r["at"]] = r["units"] / self.unit / self.n
        slope = sums[:-1] + np.append(PRICE * point[:-1], 0.0)
        return float(sums[-1] + PRICE / 2 * point[:-1] @ point[:-1]), slope

    def threshold(self, rows: DataFrame, weights: np.ndarray, bias: float) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for place, at, x, row, n in self.blocks(batches):
                p = chance_of(logits(weights, bias, at, x, row, n))
                yield C.to_batch({"bits": p[(self.good[place] >= 0.5) & (p < KEEP)].view(np.int64)}, target)

        target = C.arrow_schema("bits long")
        bits = least(rows.mapInArrow(run, "bits long"), int((1 - STAY) * self.n_good))
        return KEEP if bits is None else float(np.int64(bits).view(np.float64))


def least(rows: DataFrame, k: int) -> int | None:
    """The value of ``bits`` (no negative one) with exactly ``k`` rows before it in order, by 16 bits at a time; none if there are no more than ``k``."""
    value = None
    for shift in (48, 32, 16, 0):
        part = F.shiftright("bits", shift)
        held = rows if value is None else rows.where(F.shiftright("bits", shift + 16) == value)
        for r in sorted(held.groupBy(part.alias("part")).count().collect()):
            if k < r["count"]:
                value = r["part"]
                break
            k -= r["count"]
        else:
            return None
    return value


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int) -> np.ndarray:
    """L-BFGS from zero; a step that does not lower the loss is halved."""
    point, past, passes = np.zeros(size), [], 1
    value, slope = loss(point)
    while np.abs(slope).max() > STEEP:
        way, used = slope.copy(), []
        for s, y in reversed(past):
            used.append(s @ way / (s @ y))
            way -= used[-1] * y
        if past:
            way *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(used), strict=True):
            way += s * (a - y @ way / (s @ y))
        step = 1.0
        while True:
            if passes >= PASSES:
                return point
            there = point - step * way
            lower, new = loss(there)
            passes += 1
            if lower <= value - 1e-4 * step * (way @ slope):
                break
            step /= 2
        if (there - point) @ (new - slope) > 0:
            past = [*past, (there - point, new - slope)][-REMEMBERED:]
        point, value, slope = there, lower, new
    return point


def fit(docs: DataFrame, text: str = "text") -> Quality:
    held = learnt_from(docs, text)
    worded = F.col("at").isNotNull()
    counts = sorted(held.groupBy("pattern").agg(F.count("*").alias("n"), F.count(F.when(worded, 1)).alias("worded")).collect())
    model = LabelModel.fit({r["pattern"]: r["n"] for r in counts})
    seen = [(r["pattern"], r["worded"]) for r in counts if r["worded"]]
    if not seen:
        C.forget(held)
        return Quality(model, np.zeros(FEATURES), 0.0)
    patterns, count = np.array(seen).T
    targets, rows = Targets(patterns, model.posterior(np.array([votes_of(p) for p in patterns]) + 1), count), held.where(worded)
    point = minimise(lambda p: targets.loss(rows, p), FEATURES + 1)
    weights, bias = point[:-1], float(point[-1])
    quality = Quality(model, weights, bias, targets.threshold(rows, weights, bias))
    C.forget(held)
    return quality


def score(docs: DataFrame, quality: Quality, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, posterior, keep`` and the votes, one character per labeller (+, -, 0)."""

    def run(batch: pa.RecordBatch) -> dict:
        got = [quality.score(t) for t in C.texts_of(batch)]
        return {"doc_id": batch.column("id"), "score": [g[0] for g in got], "posterior": [g[2] for g in got], "keep": [quality.keeps(g[0]) for g in got], "votes": ["".join("-0+"[v + 1] for v in g[1]) for g in got]}

    return C.map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), run, "doc_id long, score double, posterior double, keep boolean, votes string")


def keep_good(docs: DataFrame, quality: Quality, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> dict | None:
        on = pa.array([quality.keeps(quality.score(t)[0]) for t in C.texts_of(batch, text)])
        held = batch.filter(on)
        return {f.name: held.column(f.name) for f in schema} if held.num_rows else None

    return C.map_rows(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
