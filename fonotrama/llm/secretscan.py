"""Secret scanning: rules, and a character convolutional network over every candidate and its context.

Rules give the base findings (kinds ``assign``, ``access``, ``hex``), which always stay. Candidates are
all runs of at least ``LEAST`` characters that tokens consist of. A small network in numpy reads each
candidate with the characters around it (longer ones window by window) and adds those it takes for
secrets as kind ``network``, where no base finding overlaps.

The network is fitted on labelled findings: base findings of a bounded sample of documents, also with
their tell-tale keyword blanked, and secrets of known formats set into sampled contexts are positives;
other candidates of the sample, and dates, numbers, paths and words of theirs, are negatives. The rules may have
missed secrets among these candidates: those that a first fit takes for secrets are left out, and the network is
fitted anew. A third of the findings is kept aside: a logistic curve on it calibrates the scores, and the threshold
is the highest that finds ``RECALL`` of its secrets.

Defined results: a null text is empty and has no finding; repeated rows get equal findings; an empty
table gives an empty result; whole texts are scanned. Without any sampled candidate the network is
fitted on the made-up findings alone.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "network")
_WORDS = ("password", "passwd", "secret", "token")
_any = lambda w: "".join(f"[{c.upper()}{c}]" for c in w)
ASSIGN = re.compile(rf"({'|'.join(map(_any, _WORDS))}|{_any('api')}_?{_any('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that can be secrets, and their least length.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
BEFORE, INSIDE, AFTER = 24, 48, 8
#: Documents that labelled findings are taken from, about, the most taken from one of them, and from all.
FIT_DOCS, FIT_EACH, FIT_FINDINGS = 20_000, 8, 3000
RECALL, SURE = 0.97, 0.9
#: Made-up strings among the findings, half of them secrets.
MADE = 1920
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def free_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates that no base finding overlaps."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if base and found:
        found = [(a, b) for a, b in found if not any(x < b and a < y for x, _, y in base)]
    return found


def parts_outside(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of all candidates outside base findings that are long enough to be candidates."""
    found = []
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        for x, _, y in base:
            if x < end and at < y:
                found.append((at, x))
                at = y
        found.append((at, end))
    return [(a, b) for a, b in found if b - a >= LEAST]


def windows(text: str, a: int, b: int) -> list[str]:
    """The context and the candidate, or as many overlapping pieces as it needs, at fixed places of a window."""
    out, at = [], a
    while True:
        end = min(b, at + INSIDE)
        out.append(text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0") + text[at:end].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0"))
        if end == b:
            return out
        at += INSIDE // 2


WIDTH = BEFORE + INSIDE + AFTER


def codes(rows: list[str]) -> np.ndarray:
    """0 for padding, 1 for what is not ASCII, else the character."""
    raw = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32).reshape(len(rows), WIDTH)
    return np.where(raw > 127, 1, raw).astype(np.int64)


@dataclass
class CharNet:
    """Embedding, convolution of width 5, the mean and the most over the candidate's place, a logistic unit."""

    table: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = SURE
    #: On the findings kept aside.
    recall: float = 0.0
    precision: float = 0.0

    @classmethod
    def start(cls, rng: np.random.Generator, size: int = 8, filters: int = 16) -> CharNet:
        table = rng.normal(0, 0.3, (128, size))
        table[ord("0") : ord("9") + 1, 0] += 1
        table[ord("A") : ord("Z") + 1, 1] += 1
        table[ord("a") : ord("z") + 1, 2] += 1
        table[0] = 0
        return cls(table, rng.normal(0, 0.15, (5 * (size + 1), filters)), np.zeros(filters), rng.normal(0, 0.1, 2 * filters), 0.0)

    def _forward(self, x: np.ndarray) -> tuple:
        e = np.concatenate((self.table[x], np.broadcast_to(((np.arange(WIDTH) >= BEFORE) & (np.arange(WIDTH) < BEFORE + INSIDE))[None, :, None] & (x != 0)[..., None], (*x.shape, 1))), axis=2)
        cols = np.concatenate([e[:, i : WIDTH - 4 + i] for i in range(5)], axis=2)
        h = np.maximum(cols @ self.kernel + self.bias, 0)
        inside = h[:, BEFORE - 2 : BEFORE + INSIDE - 2]
        top = inside.argmax(1)
        pooled = np.concatenate((np.take_along_axis(inside, top[:, None], 1)[:, 0], h.mean(1)), axis=1)
        return cols, h, top, pooled, pooled @ self.out + self.out_bias

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) * self.scale + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 8, rate: float = 0.01) -> None:
        names = ("table", "kernel", "bias", "out")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        weight = np.where(y > 0, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
        step, filters = 0, len(self.bias)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                b = order[i : i + 128]
                cols, h, top, pooled, z = self._forward(x[b])
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * weight[b] / len(b)
                dp = d[:, None] * self.out
                dh = np.repeat(dp[:, None, filters:] / h.shape[1], h.shape[1], axis=1)
                rows, fs = np.arange(len(b))[:, None], np.arange(filters)[None]
                dh[rows, top + BEFORE - 2, fs] += dp[:, :filters]
                dh *= h > 0
                flat = dh.reshape(-1, filters)
                dc = (flat @ self.kernel.T).reshape(*cols.shape)
                size = self.table.shape[1]
                de = np.zeros((len(b), WIDTH, size))
                for k in range(5):
                    de[:, k : WIDTH - 4 + k] += dc[..., k * (size + 1) : k * (size + 1) + size]
                at = x[b].ravel()
                dt = np.stack([np.bincount(at, de[..., j].ravel(), 128) for j in range(size)], axis=1)
                dt[0] = 0
                grads = {"table": dt, "kernel": cols.reshape(-1, cols.shape[2]).T @ flat + 1e-4 * self.kernel, "bias": flat.sum(0), "out": pooled.T @ d + 1e-4 * self.out}
                step += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grads[n]
                    second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                    setattr(self, n, getattr(self, n) - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))
                self.out_bias -= rate * float(d.sum()) * 10

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.raw(x)
        a, c = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(200):  # Newton steps on the two parameters
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
            w = p * (1 - p)
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            move = np.linalg.solve(hess, g)
            a, c = a - np.clip(move[0], -1, 1), c - np.clip(move[1], -1, 1)
            if np.abs(move).max() < 1e-6:
                break
        self.scale, self.shift = float(a), float(c)
        every = self.probability(x)
        p = np.sort(every[y > 0])
        self.threshold = float(p[int((1 - RECALL) * len(p))]) if len(p) else SURE
        self.recall = float((p >= self.threshold).mean()) if len(p) else 0.0
        self.precision = float((y[every >= self.threshold] > 0).mean()) if (every >= self.threshold).any() else 0.0


_HEX, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ALNUM = _B64[:-2]


def made_up(rng: np.random.Generator, kind: int, words: list[str]) -> tuple[str, int]:
    """A string of a known format and whether it is a secret."""
    draw = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    word = lambda: words[int(rng.integers(len(words)))]
    made = [
        lambda: (draw(_B64, int(rng.integers(24, 64))), 1), lambda: ("ghp_" + draw(_ALNUM, 36), 1), lambda: ("sk_live_" + draw(_ALNUM, 24), 1), lambda: ("xoxb-" + draw("0123456789", 12) + "-" + draw(_ALNUM, 24), 1),
        lambda: ("AKIA" + draw(_ALNUM[:26] + _ALNUM[52:], 16), 1), lambda: (draw(_HEX, int(rng.integers(20, 64))), 1), lambda: ("eyJ" + draw(_ALNUM + "-_", int(rng.integers(40, 90))), 1), lambda: ("AIza" + draw(_ALNUM + "-_", 35), 1),
        lambda: (draw("0123456789", int(rng.integers(16, 24))), 0), lambda: ((word() + word() + word() + word())[:60].ljust(LEAST, "e"), 0), lambda: ("/".join(word() for _ in range(5)), 0), lambda: ("2024-0" + draw("123456789", 1) + "-1" + draw("0123456789", 1) + "T0" + draw("123456789", 1) + "-00-00", 0),
        lambda: ("-".join(word() for _ in range(5)), 0), lambda: ("=" * int(rng.integers(16, 70)), 0), lambda: ((word() + "_" + word() + "_" + draw("0123456789", 2)).ljust(LEAST, "a"), 0), lambda: ((word() + word() + word()).upper().ljust(LEAST, "E"), 0),
    ]
    return made[kind % len(made)]()


def labelled(docs: DataFrame, id_col: str, text: str, fit_docs: int = FIT_DOCS) -> tuple[list[str], list[int], list[str]]:
    """Windows and labels (1: a base finding, 0: no finding) from a bounded sample of documents, and words of theirs."""
    n = docs.count()
    if not n:
        return [], [], []
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(draw < min(1.0, fit_docs / n)).select("text")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"window": [], "label": [], "word": []}
        for t in C.texts_of(batch):
            base = base_spans(t)
            got = []
            for a, k, b in base[:FIT_EACH]:
                start = ASSIGN.match(t, a).start(2) if k == 0 else a
                w = windows(t, start, b)[0]
                got += [(w, 1), (" " * BEFORE + w[BEFORE:], 1)] if b - start >= LEAST else []
            got += [(windows(t, a, b)[0], 0) for a, b in free_candidates(t, base)[:FIT_EACH]]
            words = t.split(None, 4)
            for w, lab in got:
                out["window"].append(w.replace("\0", "\x01"))
                out["label"].append(lab)
                out["word"].append(None)
            if len(words) > 3 and words[3].isalpha():
                out["window"].append(None)
                out["label"].append(None)
                out["word"].append(words[3][:20])
        return out

    found = C.map_rows(rows, run, "window string, label int, word string")
    seen = found.where("window IS NOT NULL").orderBy(F.xxhash64("window")).limit(FIT_FINDINGS).collect()
    words = [r[0] for r in found.where("word IS NOT NULL").select("word").distinct().orderBy("word").limit(500).collect()]
    return [r["window"].replace("\x01", "\0") for r in seen], [r["label"] for r in seen], words


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS, seed: int = 5) -> CharNet:
    rows, labels, words = labelled(docs, id_col, text, fit_docs)
    rng = np.random.default_rng(seed)
    words = words or ["the", "and", "document", "language"]
    rows, labels = list(rows), list(labels)
    unsure = np.array([lab == 0 for lab in labels] + [False] * MADE, bool)
    for k in range(MADE):
        s, y = made_up(rng, k, words)
        left = " ".join(words[int(i)] for i in rng.integers(0, len(words), 4)) + (" ", ": ", "=", ' "')[int(rng.integers(4))]
        rows.append(windows(left + s + " " + words[0], len(left), len(left) + len(s))[0])
        labels.append(y)
    x, y = codes(rows), np.array(labels, float)
    apart = rng.random(len(y)) < 1 / 3
    net = CharNet.start(rng)
    net.fit(x[~apart], y[~apart], rng)
    missed = unsure & (net.probability(x) >= 0.5)
    if missed.any():
        x, y, apart = x[~missed], y[~missed], apart[~missed]
        net = CharNet.start(rng)
        net.fit(x[~apart], y[~apart], rng)
    net.calibrate(x[apart], y[apart])
    return net


def spans_of(texts: list[str], net: CharNet) -> list[list[tuple[int, int, int]]]:
    """All findings of each text, by start, then kind."""
    out, asked, where = [], [], []
    for i, t in enumerate(texts):
        base = base_spans(t)
        out.append(base)
        for a, b in parts_outside(t, base):
            pieces = windows(t, a, b)
            asked += pieces
            where += [(i, a, b)] * len(pieces)
    taken = set()
    for lo in range(0, len(asked), 4096):
        for w, p in zip(where[lo : lo + 4096], net.probability(codes(asked[lo : lo + 4096])), strict=True):
            if p >= net.threshold:
                taken.add(w)
    for i, a, b in taken:
        out[i] = sorted([*out[i], (a, 3, b)])
    return out


def scan(docs: DataFrame, net: CharNet, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_network``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        found = spans_of(C.texts_of(batch), net)
        counts = [[sum(k == kind for _, k, _ in s) for s in found] for kind in range(4)]
        base = [hashlib.sha256(as_text([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
        return dict(zip(("n_assign", "n_access", "n_hex", "n_network"), counts, strict=True)) | {"doc_id": batch.column("doc_id"), "base_sha256": base, "spans": [as_text(s) for s in found]}

    return C.map_rows(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], MASK]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: CharNet, text: str = "text") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced; overlapping ones together. A null text stays null."""
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> dict:
        held = batch.column(text).to_pylist()
        clean = [t if t is None else redact_text(t, s) for t, s in zip(held, spans_of([t or "" for t in held], net), strict=True)]
        return {f.name: clean if f.name == text else batch.column(f.name) for f in schema}

    return C.map_rows(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
