"""Dictionaries and context rules mined from aligned phoneme outputs.

The most common value of a group is that of the highest count, the first seen winning a tie, as a counter in
reading order would give it. Every group is counted at the grain (key, value) first, so a hot key is summed
before it is exchanged, and what is ranked per key are its distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import columns as X

CATEGORIES = ("posicao_rel", "anterior_class", "proxima_class", "proxima_tipo", "tipo_sintagma", "posicao_sintagma", "anterior_tipo", "proxima_tipo2", "posicao_bucket", "tamanho_bucket")
FLAGS = ("tem_artigo_antes", "tem_preposicao_antes", "verbo_antes", "verbo_depois", "auxiliar_antes", "auxiliar_depois", "tem_pausa_depois", "tem_pausa_antes")
FEATURES = CATEGORIES + FLAGS
#: What a word's variation is held against, as columns of the items.
CONTEXT = ("proxima_tipo", "proxima_inicial", "anterior_tipo", "anterior_final", "posicao_rel", "tem_pausa_depois", "tem_pausa_antes")
VOWELS = "aeiouáéíóúâêôãõàü"
#: Sentences whose lists are Python objects at a time.
SLICE = 16
LABELLED = ("proxima_tipo", "proxima_tipo2", "anterior_tipo", "posicao_bucket", "tamanho_bucket")


def counted(rows: DataFrame, keys: list[str], seen: list[str], weight: str | None = None) -> DataFrame:
    """``keys`` with ``n`` (rows, or the sum of ``weight``) and ``first``, the least ``seen``, counted before the exchange without a sort.

    A least struct makes Spark sort all rows, so a place (id, pos) is one number: a long where it fits, else a decimal.
    """
    n = (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")
    kinds = []
    for c in seen:
        kind = rows.schema[c].dataType
        kinds += [(F.col(c)[f.name], f.dataType) for f in kind] if isinstance(kind, T.StructType) else [(F.col(c), kind)]
    if len(kinds) == 1 and isinstance(kinds[0][1], T.DecimalType):
        return rows.groupBy(*keys).agg(n, F.min(kinds[0][0]).alias("first"))
    whole = all(isinstance(k, T.IntegralType) for _, k in kinds)
    if not whole or len(kinds) > 2 or (len(kinds) == 2 and not isinstance(kinds[1][1], T.IntegerType)):
        return rows.groupBy(*keys).agg(n, F.min(F.struct(*seen)).alias("first"))
    at, pos = kinds[0][0].cast("long"), kinds[1][0] if len(kinds) == 2 else F.lit(0)
    fits = F.coalesce(at.between(0, 2**32 - 1) & (pos >= 0), F.lit(False))
    near = F.when(fits, at * F.lit(2**31).cast("long") + pos)
    wide = F.coalesce(at.cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)")) * F.lit(2**31).cast("decimal(11,0)") + F.coalesce(pos, F.lit(-(2**31))).cast("decimal(11,0)")
    far = F.when(~fits, wide.cast("decimal(38,0)"))
    held = rows.groupBy(*keys).agg(n, F.min(near).alias("__near"), F.min(far).alias("__far"))
    return held.select(*keys, "n", F.least(F.col("__near").cast("decimal(38,0)"), "__far").alias("first"))


def modal(rows: DataFrame, keys: list[str], value: str, seen: list[str], weight: str | None = None) -> DataFrame:
    """Per key ``top`` (the most common value), ``n`` (its count), ``total`` and ``kinds`` (distinct values but null)."""
    counts = counted(rows, [*keys, value], seen, weight)
    best = F.min_by(F.struct(F.col(value).alias("v"), "n"), F.struct(-F.col("n"), "first"))
    per = counts.groupBy(*keys).agg(best.alias("__b"), F.sum("n").alias("total"), F.count(value).alias("kinds"))
    return per.select(*keys, F.col("__b.v").alias("top"), F.col("__b.n").alias("n"), "total", "kinds")


# --- alignment (MN2, MN3) ---------------------------------------------------------------------------------------


def exact_pairs(words: Column, said: Column) -> Column:
    """MN2: array of (word, ipa), null unless there are as many of either."""
    return F.when(F.size(words) == F.size(said), F.zip_with(words, said, lambda w, i: F.struct(w.alias("word"), i.alias("ipa"))))


def _share(words: list[str], said: list[str]) -> list[tuple[str, str]] | None:
    n, m = len(words), len(said)
    if not n or not m or (n != m and abs(n - m) > max(n, m) // 2):
        return None
    if n == m:
        return list(zip(words, said, strict=True))
    out, at = [], 0
    if m > n:  # each word takes a run of tokens in proportion to its length, and leaves one for each word to come
        letters = sum(map(len, words))
        for left, w in zip(range(n - 1, -1, -1), words, strict=True):
            end = max(at + 1, min(at + max(1, round(len(w) / letters * m)), m - left))
            out.append((w, "".join(said[at:end])))
            at = end
        return out
    for left, token in zip(range(m, 0, -1), said, strict=True):  # each token takes a run of words; only a run of one is certain
        run = words[at:] if left == 1 else words[at : at + max(1, round((n - at) / left))]
        if len(run) == 1:
            out.append((run[0], token))
        at += len(run)
    return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of ``sent_id, w, s`` the pairs; Python holds the words of ``SLICE`` sentences at a time, however large a batch is."""
    kinds = pa.schema([("sent_id", pa.int64()), ("pos", pa.int32()), ("word", pa.string()), ("ipa", pa.string())])
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            rows = zip(*(batch.column(c).slice(lo, SLICE).to_pylist() for c in ("sent_id", "w", "s")), strict=True)
            found = [(i, k, w, s) for i, ws, ss in rows for k, (w, s) in enumerate(_share(ws or [], ss or []) or ())]
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def approximate_pairs(outputs: DataFrame, ipa: str = "ipa_b") -> DataFrame:
    """MN3: ``sent_id, pos, word, ipa``; where the lists differ in length, by proportion of the words' lengths."""
    plain = outputs.where(F.col(ipa).isNotNull()).select("sent_id", "sentence", X.plain_ipa(F.col(ipa)).alias("s"))
    lists = plain.select("sent_id", X.text_words(F.col("sentence")).alias("w"), X.ipa_words(F.col("s")).alias("s"))
    return lists.mapInArrow(_shares, "sent_id long, pos int, word string, ipa string")


# --- dictionaries (MN4, MN5, MN17) ------------------------------------------------------------------------------


def context_lexicon(pairs: DataFrame, isolated: DataFrame | None = None, with_next: bool = False, least: int = 2, share: float = 0.9) -> DataFrame:
    """MN4: ``key, ipa`` from ``sent_id, pairs`` (arrays of word and ipa). A key (a word, or with the word that follows) needs
    ``least`` readings, ``share`` of them alike; one whose base form is that of ``isolated`` (word, ipa) is left out."""
    words = F.col("pairs")["word"]
    both = F.arrays_zip(words.alias("w"), F.col("pairs")["ipa"].alias("ipa"), F.slice(words, F.lit(2), F.greatest(F.size("pairs") - 1, F.lit(0))).alias("after"))
    rows = pairs.select("sent_id", both.alias("x")).select("sent_id", F.posexplode_outer("x").alias("pos", "x")).where("pos IS NOT NULL")
    names = ["w", "after"] if with_next else ["w"]
    counts = counted(rows.select("sent_id", "pos", F.col("x.ipa").alias("ipa"), *[F.col(f"x.{c}").alias(c) for c in names]), [*names, "ipa"], ["sent_id", "pos"])
    word = X.bare(F.col("w"))
    key = F.concat_ws("|", word, F.coalesce(X.bare(F.col("after")), F.lit(""))) if with_next else word
    rows = counts.where(word != "").select(key.alias("key"), "ipa", "n", "first")
    top = modal(rows, ["key"], "ipa", ["first"], "n").where((F.col("total") >= least) & (F.col("n") / F.col("total") >= share))
    found = top.select("key", X.base_ipa(F.col("top")).alias("ipa"))
    if isolated is None or with_next:
        return found
    known = isolated.where("ipa <> ''").select(F.col("word").alias("key"), X.base_ipa(X.plain_ipa(F.col("ipa"))).alias("alone"))
    return found.join(known, "key", "left").where("alone IS NULL OR alone <> ipa").select("key", "ipa")


def homograph_lexicon(examples: DataFrame, cached: DataFrame, least: int = 2) -> DataFrame:
    """MN5: ``word, sense, ipa, confidence, occurrences`` from examples (word, sense, sentence) and readings (sentence, ipa)."""
    known = cached.where("ipa <> ''").select("sentence", "ipa")
    wanted = examples.groupBy("sentence").agg(F.collect_list(F.struct("word", "sense")).alias("e"))  # a sentence is joined once, whatever its examples
    plain = wanted.join(known, "sentence").select("sentence", "e", X.plain_ipa(F.col("ipa")).alias("ipa"))
    lists = plain.select("sentence", "e", F.regexp_extract_all("sentence", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w"), X.ipa_words(F.col("ipa")).alias("s"))
    lists = lists.select("sentence", "e", "s", F.when(F.size("w") == F.size("s"), F.transform("w", lambda w: F.lower(w))).alias("w"))
    read = F.transform("e", lambda e: F.struct(e["word"].alias("word"), e["sense"].alias("sense"), F.get("s", F.nullif(F.array_position("w", e["word"]), F.lit(0)).cast("int") - 1).alias("ipa")))
    rows = lists.select("sentence", read.alias("r")).select("sentence", F.inline_outer("r")).where("ipa IS NOT NULL")
    top = modal(rows, ["word", "sense"], "ipa", ["sentence"]).where(F.col("total") >= least)
    return top.select("word", "sense", X.base_ipa(F.col("top")).alias("ipa"), (F.col("n") / F.col("total")).alias("confidence"), F.col("total").alias("occurrences"))


def divergence_pairs(diffs: DataFrame, k: int = 40, least: int = 1, words: int = 5) -> DataFrame:
    """MN17: the ``k`` most frequent pairs (ipa_a, ipa_b), then those of ``least`` and more, with their most frequent words;
    ties in the order in which they are first seen."""
    by_word = counted(diffs, ["ipa_a", "ipa_b", "word"], ["sent_id", "pos"])
    totals = by_word.groupBy("ipa_a", "ipa_b").agg(F.sum("n").alias("total"), F.min("first").alias("f")).orderBy(F.desc("total"), "f").limit(k).drop("f")
    held = by_word.join(F.broadcast(totals.where(F.col("total") >= least)), ["ipa_a", "ipa_b"])  # at most k rows
    rank = F.row_number().over(Window.partitionBy("ipa_a", "ipa_b").orderBy(F.desc("n"), "first"))
    held = held.withColumn("r", rank).where(F.col("r") <= words)
    named = F.transform(F.array_sort(F.collect_list(F.struct("r", "word", "n"))), lambda x: F.concat(x["word"], F.lit("("), x["n"].cast("string"), F.lit(")")))
    return held.groupBy("ipa_a", "ipa_b", "total").agg(F.array_join(named, ", ").alias("words"))


def word_corrections(diffs: DataFrame, least: int = 10) -> DataFrame:
    """MN17: per word of ``least`` and more differences its most frequent pair: ``word, ipa_a, ipa_b, n, total``."""
    rows = diffs.withColumn("pair", F.struct("ipa_a", "ipa_b"))
    top = modal(rows, ["word"], "pair", ["sent_id", "pos"]).where(F.col("total") >= least)
    return top.select("word", "top.ipa_a", "top.ipa_b", "n", "total")


def frequent_words(tokens: DataFrame, least: int = 2, k: int = 50, order: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """MN16: the ``k`` most frequent words of at least so many occurrences; ties in the order in which they are first seen."""
    counts = counted(tokens, ["word"], list(order)).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "first").limit(k).select("word", "n")


# --- features and rules (MN6-MN14) ------------------------------------------------------------------------------


def letter_class(c: Column) -> Column:
    """MN6: of the first letter; empty and null are a class of their own."""
    low = F.lower(c)
    named = F.when(low.rlike(f"^[{VOWELS}]"), F.lit("vogal")).when(low.rlike("^[bdgvzmnlr]"), F.lit("sonora")).when(low.rlike("^[ptkfsxʃ]"), F.lit("surda"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("vazio")).otherwise(named.otherwise(F.lit("outra")))


def position_bucket(at: Column, total: Column) -> Column:
    share = at / F.when(total > 1, total - 1)
    return F.when(F.coalesce(total, F.lit(0)) <= 1, F.lit("unico")).when(share < 0.2, F.lit("inicio")).when(share > 0.8, F.lit("fim")).otherwise(F.lit("meio"))


def size_bucket(total: Column) -> Column:
    return F.when(total <= 5, F.lit("curta")).when(total <= 15, F.lit("media")).otherwise(F.lit("longa"))


def with_features(items: DataFrame) -> DataFrame:
    """MN6: adds columns of ``FEATURES``. One that ``items`` lacks would be null, or no, in all rows, so it tells them apart nowhere and is left out."""
    has = lambda n, default: F.col(n) if n in items.columns else F.lit(default)
    made = {
        "anterior_tipo": letter_class(has("anterior_final", "").cast("string")),
        "proxima_tipo2": letter_class(has("proxima_inicial", "").cast("string")),
        "posicao_bucket": position_bucket(has("posicao", 0), has("total", 1)),
        "tamanho_bucket": size_bucket(has("total", 0)),
    }
    kept = [c for c in items.columns if c not in FEATURES]
    values = {c: made.get(c, has(c, None).cast("string")) for c in CATEGORIES if c in made or c in items.columns}
    values |= {c: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit("sim")).otherwise(F.lit("nao")) for c in FLAGS if c in items.columns}
    return items.select(*kept, *[v.alias(c) for c, v in values.items()])


def feature_rows(names: list[str], base: bool = False) -> Column:
    """The features as an array of (f, feature, value); ``base`` sets one before them in which all rows are alike."""
    named = [F.struct(F.lit(FEATURES.index(c)).alias("f"), F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names]
    return F.array(*[F.struct(F.lit(-1).alias("f"), F.lit("").alias("feature"), F.lit("").alias("value"))] * base, *named)


def all_rules(items: DataFrame, least: int = 5, precision: float = 0.85, scopes: tuple[str, ...] = ("global", "palavra"), change: Column | None = None) -> DataFrame:
    """MN7-MN10: rules of both scopes (``global`` by kind of change, ``palavra`` by word and kind) from items with features:
    ``id, word, change, ipa``, or ``ipa_a`` and how the kind of ``change`` follows from both. One row per scope, change, feature,
    value, reading and word.

    Items alike in all of these are counted together before they are multiplied by features and scopes, and the share of the
    most common reading without any feature, which rules are held against, is counted among them as one feature more.
    """
    names = [c for c in FEATURES if c in items.columns]
    kinds = counted(items, ["word", "change" if change is None else "ipa_a", "ipa", *names], ["id"])
    kinds = kinds.withColumn("change", F.coalesce(F.col("change") if change is None else change, F.lit("desconhecido")))
    own = {"global": F.lit(""), "palavra": F.col("word")}
    long = kinds.select("word", "change", "ipa", "n", "first", F.inline(feature_rows(names, base=True))).drop("feature").where("value IS NOT NULL")
    held = F.array(*[F.struct(F.lit(s).alias("scope"), own[s].alias("word")) for s in scopes])
    long = long.select("change", "ipa", "n", "first", "f", "value", F.inline(held))
    keys = ["scope", "word", "change"]
    top = modal(long, [*keys, "f", "value"], "ipa", ["first"], "n").withColumn("precision", F.col("n") / F.col("total"))
    base = F.col("f") == -1
    good = F.when(~base & (F.col("total") >= least) & (F.col("precision") >= precision), F.struct("f", F.get(F.array(*map(F.lit, FEATURES)), F.col("f")).alias("feature"), "value", F.col("top").alias("ipa"), F.col("total").alias("coverage"), "precision"))
    # the values of a group's features, of which there are few
    found = top.groupBy(*keys).agg(F.max(F.when(base, F.col("precision"))).alias("baseline"), F.max(F.when(base, F.col("total"))).alias("all"), F.collect_list(good).alias("r"))
    found = found.where((F.col("scope") == "global") | (F.col("all") >= least)).select(*keys, "baseline", F.inline("r")).where(F.col("precision") > F.col("baseline") + 0.02)
    return found.select("scope", "change", "feature", "value", "ipa", "word", "f", "coverage", "precision", (F.col("precision") - F.col("baseline")).alias("gain"), "baseline")


def consolidated(rules: DataFrame) -> DataFrame:
    """MN11: global rules of one key together: summed coverage, the last one's other figures."""
    keys = ["change", "feature", "value", "ipa"]
    last = F.max_by(F.struct("precision", "gain", "baseline"), F.struct("f", "coverage", "precision"))
    one = rules.where("scope = 'global'").groupBy(*keys).agg(F.sum("coverage").alias("coverage"), last.alias("r"))
    return one.select(*keys, "coverage", "r.precision", "r.gain", "r.baseline")


def ranked_rules(rules: DataFrame, k: int = 30) -> DataFrame:
    """MN12: the ``k`` rules of the highest score, and whether each is worth putting in place."""
    score = F.col("coverage") * F.col("gain") * F.log(F.col("precision") + 1)
    ready = (F.col("coverage") >= 10) & (F.col("precision") >= 0.9)
    return rules.withColumns({"score": score, "implementable": ready}).orderBy(F.desc("score"), *[c for c in ("scope", "change", "word", "feature", "value", "ipa") if c in rules.columns]).limit(k)


LABEL_KEY = ("palavra", "ipa_rs", "ipa_espeak", "proxima", "posicao_rel", "tem_pausa_depois")


def with_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """MN13: ``items`` with the ``trigger`` of the last label (_key, trigger, seq) of their six-field key, if any."""
    last = labels.groupBy("_key").agg(F.max_by("trigger", "seq").alias("trigger"))
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LABEL_KEY])
    return items.withColumn("_key", key).join(last, "_key", "left")


def label_cooccurrence(items: DataFrame, k: int = 5) -> DataFrame:
    """MN14: per trigger the ``k`` most frequent feature values: ``trigger, feature_value, n``."""
    names = [c for c in LABELLED if c in items.columns]
    kinds = items.where("trigger IS NOT NULL AND trigger <> ''").groupBy("trigger", *names).agg(F.count(F.lit(1)).alias("n"))
    long = kinds.select("trigger", "n", F.inline(feature_rows(names))).where("value IS NOT NULL")
    counts = long.groupBy("trigger", F.concat_ws("=", "feature", "value").alias("feature_value")).agg(F.sum("n").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "feature_value"))), 1, k)  # distinct values of five features
    return counts.groupBy("trigger").agg(top.alias("t")).select("trigger", F.inline("t")).select("trigger", "feature_value", (-F.col("m")).alias("n"))


# --- variation by word (MN15) -----------------------------------------------------------------------------------


def variation(items: DataFrame, features: tuple[str, ...] = CONTEXT) -> DataFrame:
    """MN15: per word ``n, verdict, best_feature, score`` from items (id, word, ipa_a, ipa, and any of ``features``): whether
    either engine varies, and which feature separates the second one's readings best (precision times ln(buckets + 1))."""
    held = [c for c in features if c in items.columns]
    kinds = counted(items.select("id", "word", "ipa_a", "ipa", *[F.col(c).cast("string").alias(c) for c in held]), ["word", "ipa_a", "ipa", *held], ["id"])
    part = lambda f, name, value, reading: F.struct(F.lit(f).alias("f"), F.lit(name).alias("feature"), value.alias("value"), F.col(reading).alias("reading"))
    # the engines' readings of a word whatever its context are counted as two features more
    parts = F.array(part(-2, "a", F.lit(""), "ipa_a"), part(-1, "b", F.lit(""), "ipa"), *[part(i, c, F.col(c), "ipa") for i, c in enumerate(features) if c in held])
    long = kinds.select("word", "n", "first", F.inline(parts)).where("value IS NOT NULL")
    buckets = modal(long, ["word", "f", "feature", "value"], "reading", ["first"], "n")
    split = buckets.groupBy("word", "f", "feature").agg(F.count(F.lit(1)).alias("buckets"), F.count_distinct("top").alias("tops"), F.max("kinds").alias("kinds"), F.sum("total").alias("total"), (F.sum("n") / F.sum("total")).alias("precision"))
    split = split.withColumn("score", F.when((F.col("f") >= 0) & (F.col("tops") > 1), F.col("precision") * F.log(F.col("buckets") + 1)))
    one = lambda f, c: F.max(F.when(F.col("f") == f, F.col(c)))
    best = F.min_by(F.when(F.col("score").isNotNull(), F.struct("feature", "score")), F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), "f")))
    words = split.groupBy("word").agg(one(-1, "total").alias("n"), (one(-2, "kinds") == 1).alias("a"), (one(-1, "kinds") == 1).alias("b"), best.alias("best"))
    a, b = F.col("a"), F.col("b")
    verdict = F.when(a & b, F.lit("lexical")).when(~a & ~b, F.lit("ambiguo")).when(a & ~b, F.lit("regra")).otherwise(F.lit("inverso"))
    return words.select("word", "n", verdict.alias("verdict"), F.col("best.feature").alias("best_feature"), F.col("best.score").alias("score"))
