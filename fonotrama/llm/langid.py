"""Language identification by rank-order profiles (out-of-place distance).

``fit`` counts character n-grams (1 to 3 letters; a blank marks a word's edge) per language and keeps
each language's most frequent ones in order. ``predict`` ranks a document's own most frequent n-grams
and sums, over them, how far each stands from its place in a language's profile; an n-gram that the
profile lacks costs the profile's whole length. The nearest profile wins.

Defined results: a null text, or one without a letter, gets ``und`` and score 0; equal distances go to
the language that sorts first; an empty training set makes every prediction ``und``; rows are scored
one by one, so repeated rows and null ids change nothing. Whole texts count, whatever their length.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

UNKNOWN = "und"
#: Training rows per language that the profiles are counted over, about; chosen by a hash of the id.
FIT_ROWS = 4000
#: Length of a profile and of a document's own ranking.
PROFILE = 400

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text, each packed exactly into 63 bits (21 for a character)."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[a]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    a = np.where(is_letter, a, 32).astype(np.int64)
    a = np.concatenate(([32], a, [32]))
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
    blank = a == 32
    two = (a[:-1] << 21) | a[1:]
    three = ((a[:-2] << 42) | (a[1:-1] << 21) | a[2:])[~blank[1:-1]]
    return np.concatenate((a[~blank], two, three))


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(grams)
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.diff(np.concatenate((first, [len(g)])))


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # sorted, of all languages
    place: np.ndarray  # grams x languages: the rank, or ``length`` where absent
    length: int

    def rank(self, text: str) -> tuple[str, float]:
        grams = ngrams(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        own, n = counted(grams)
        if len(own) > self.length:
            top = np.flatnonzero(n >= np.partition(n, len(n) - self.length)[len(n) - self.length])
            own, n = own[top], n[top]
        own = own[np.argsort(-n, kind="stable")[: self.length]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        places = np.where(known[:, None], self.place[at], self.length)
        apart = np.where(places == self.length, self.length, np.abs(places - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.length * len(own)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, length: int = PROFILE) -> Profiles:
    """Profiles from the rows of ``docs`` that have a language: all of them, or about ``fit_rows`` of each language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), length)
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, fit_rows / v))])
    draw = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        langs, texts = batch.column("lang").to_pylist(), C.texts_of(batch)
        for one in sorted(set(langs)):
            parts = [g for g in (ngrams(t) for t, x in zip(texts, langs, strict=True) if x == one) if len(g)]
            if parts:
                g, k = counted(np.concatenate(parts))
                out["lang"] += [one] * len(g)
                out["gram"].append(g)
                out["n"].append(k)
        return {k: np.concatenate(v) if k != "lang" and v else v for k, v in out.items()}

    counts = C.map_rows(taken, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= length).select("lang", "gram", "r").toPandas()
    langs = sorted(set(top["lang"]))
    grams = np.unique(top["gram"].to_numpy(np.int64))
    place = np.full((len(grams), len(langs)), length, np.int64)
    place[np.searchsorted(grams, top["gram"].to_numpy(np.int64)), [langs.index(x) for x in top["lang"]]] = top["r"] - 1
    return Profiles(langs, grams, place, length)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score`` (1: in place throughout, 0: nothing in common)."""
    keep = keep if keep is not None else ["doc_id"]
    rows = docs.select(*[F.col(c) if isinstance(c, str) else c for c in keep], F.col(text).alias("__text"))
    kept = rows.drop("__text").schema

    def score(batch: pa.RecordBatch) -> dict:
        found = [profiles.rank(t) for t in C.texts_of(batch, "__text")]
        return {f.name: batch.column(f.name) for f in kept} | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    return C.map_rows(rows, score, ddl)


#: Below this likeness to the nearest profile a language is not taken as known.
KNOWN = 0.2


def keep_known(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised."""
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> dict | None:
        found = [profiles.rank(t) for t in C.texts_of(batch, text)]
        held = batch.filter(pa.array([lang != UNKNOWN and score >= KNOWN for lang, score in found]))
        return {f.name: held.column(f.name) for f in schema} if held.num_rows else None

    return C.map_rows(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
