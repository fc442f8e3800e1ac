"""Texts to phonemes: sentences, tokens, distinct words, dictionaries, sounds between words, chunks.

Texts are normalised, split and cut into tokens once. What surrounds a word is read off its sentence's list of tokens, so no
window is needed; then a row per word, keyed (doc, sent, pos), goes through the dictionaries, and the only exchange is that of
words by sentence for the assembly. The Python kernel works out a word once per Arrow batch and remembers it, so words need no
exchange; everything else is native.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as X
from ..functions import kernel

#: The most entries of a dictionary that are broadcast; a larger one is joined by exchange.
BROADCAST_ENTRIES = 200_000


@dataclass
class Dictionaries:
    """Layers of (word, ipa); ``homographs`` also has ``sense``."""

    word: DataFrame | None = None
    clitic: DataFrame | None = None
    context_word: DataFrame | None = None
    context_clitic: DataFrame | None = None
    external: DataFrame | None = None
    context_external: DataFrame | None = None
    homographs: DataFrame | None = None
    #: The words and stems whose u sounds after q or g, such as ``sources.lexicons.diaeresis_rules`` reads.
    rules: kernel.Rules = kernel.SEED
    checked: dict = field(default_factory=dict)

    def joined(self, df: DataFrame, name: str, out: str, on: tuple[str, ...] = ("word",)) -> DataFrame:
        lexicon = getattr(self, name)
        if lexicon is None:
            return df.withColumn(out, F.lit(None).cast("string"))
        if name not in self.checked:
            self.checked[name] = lexicon.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
        side = lexicon.select(*on, F.col("ipa").alias(out)).dropDuplicates(list(on))
        return df.join(F.broadcast(side) if self.checked[name] else side, list(on), "left")


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", normalise: bool = True) -> DataFrame:
    """``doc, sent, sentence``."""
    said = X.normalised(F.col(text)) if normalise else F.col(text)
    cut = X.sentences.asNondeterministic()  # or a filter that Spark infers from the explosion would split the text again
    split = docs.select(F.col(id_col).alias("doc"), cut(said).alias("s"))
    return split.select("doc", F.posexplode("s").alias("sent", "sentence"))


def token_rows(sentences: DataFrame) -> DataFrame:
    """``doc, sent, pos, token, kind`` (word, mark, space, or other: hyphens and quotes alone)."""
    tokens = F.regexp_extract_all("sentence", F.lit(X.TOKEN), F.lit(0))
    rows = sentences.select("doc", "sent", F.posexplode(tokens).alias("pos", "token"))
    return rows.withColumn("kind", _kind(F.col("token")))


def _kind(token: Column) -> Column:
    kind = F.when(token == " ", "space").when(token.rlike(r"\p{IsAlphabetic}"), "word").when(token.rlike(f"^{X.PAUSE}+$"), "mark")
    return kind.when(token.rlike(r"^\s+$"), "space").otherwise("other")


def _placed(t: Column, strict_compat: bool, *keep: str) -> Column:
    """Of a sentence's tokens (structs with ``token`` and ``kind``) its words, and others if they count as places, with ``initial``.

    Lists are zipped with each other, never looked up in: the cost grows with the tokens of a sentence.
    """
    kinds = F.array_join(F.transform(t, lambda x: F.substring(x["kind"], 1, 1)), "")
    marks_after = F.regexp_extract_all(F.regexp_replace(kinds, "[so]+", ""), F.lit("w(m*)"), F.lit(1))  # of each word
    is_word = lambda x: x["kind"] == "word"
    following = F.slice(F.filter(t, is_word), F.lit(2), F.size(t))
    own = F.zip_with(marks_after, following, lambda m, w: F.when(m == "", F.substring(w["token"], 1, 1)))
    places = F.filter(t, lambda x: x["kind"].isin("word", "other")) if strict_compat else F.filter(t, is_word)
    return F.zip_with(places, own, lambda x, i: F.struct(*[x[c].alias(c) for c in ("token", "kind", *keep)], F.when(is_word(x), i).alias("initial")))


def with_context(tokens: DataFrame, strict_compat: bool = True) -> DataFrame:
    """Adds ``n_words`` of the sentence and ``initial``: the first character of the next word unless a mark stands between.

    A token of hyphens or quotes alone counts as a place though it is no word, so that the words after it take their
    neighbours' initial; ``strict_compat=False`` gives every word its own.
    """
    rest = [c for c in tokens.columns if c not in ("doc", "sent", "pos", "token", "kind")]
    held = tokens.groupBy("doc", "sent").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "kind", *rest))).alias("t"))
    placed = _placed(F.col("t"), strict_compat, "pos", *rest)
    others = F.filter("t", lambda x: ~x["kind"].isin("word", "other") if strict_compat else x["kind"] != "word")
    others = F.transform(others, lambda x: F.struct(*[x[c].alias(c) for c in ("token", "kind", "pos", *rest)], F.lit(None).cast("string").alias("initial")))
    n_words = F.size(F.filter("t", lambda x: x["kind"] == "word")).cast("long")
    return held.select("doc", "sent", n_words.alias("n_words"), F.inline(F.concat(placed, others))).select(*tokens.columns, "n_words", "initial")


def word_rows(sentences: DataFrame, strict_compat: bool = True, whole: bool = False) -> DataFrame:
    """``doc, sent, pos, token, kind, n_words, initial`` of each word, ``pos`` being its number in the sentence.

    ``whole`` adds to the first word's row the ``sentence`` and ``rest``, what is said of it besides words, each of which is a zero
    character; a sentence without a word keeps one row.
    """
    token = F.regexp_extract_all("sentence", F.lit(X.TOKEN if whole else X.TOKEN.removesuffix(r"|\s+")), F.lit(0))
    cut = sentences.select("doc", "sent", *["sentence"] * whole, F.transform(token, lambda x: F.struct(x.alias("token"), _kind(x).alias("kind"))).alias("t"))
    words = F.filter(_placed(F.col("t"), strict_compat), lambda x: x["kind"] == "word")
    said = lambda x: F.when(x["kind"] == "word", F.lit("\0")).when(x["kind"] == "mark", F.concat(x["token"], F.lit(" "))).when(x["kind"] == "space", F.lit(" "))
    lists = cut.select("doc", "sent", *["sentence", F.array_join(F.transform("t", said), "").alias("rest")] * whole, words.alias("w"))
    # what belongs to the sentence stands in the first element, so that no word's row carries it through the explosion
    once = [F.array(c).alias(c) for c in ("sentence", "rest")] if whole else []
    zipped = lists.select("doc", "sent", F.size("w").cast("long").alias("n_words"), F.arrays_zip(F.col("w").alias("w"), *once).alias("x"))
    rows = zipped.select("doc", "sent", "n_words", F.posexplode_outer("x").alias("pos", "x")).where("pos IS NOT NULL")
    return rows.select("doc", "sent", *["x.sentence", "x.rest"] * whole, "pos", "x.w.token", "x.w.kind", "n_words", "x.w.initial")


def word_parts(tokens: DataFrame) -> DataFrame:
    """One row per hyphen part of each word: ``part, word`` and ``parts``; only a word of one part hears the next. Other
    tokens keep one row without a word, and so does a word of no part."""
    bare = X.bare(F.col("token"))
    parts = F.when(bare.contains("-"), F.filter(F.split(bare, "-"), lambda w: w != "")).when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))
    split = F.when(F.col("kind") == "word", parts)
    rows = tokens.withColumn("parts", F.size(split)).select("*", F.posexplode_outer(split).alias("part", "word"))
    return rows.withColumn("initial", F.when((F.col("parts") == 1) & (F.col("n_words") > 1), F.col("initial")))


def spoken(words: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """Adds ``ipa`` and its ``layer`` (LX4, LX5, SD1-SD6); rules answer where no dictionary does."""
    names = {"context_clitic": "x0", "context_word": "x1", "context_external": "x2", "external": "x3", "word": "x4", "clitic": "x5"}
    rows = words.withColumn("x6", X.ipa_by(dictionaries.rules)("word"))
    for name, out in names.items():
        rows = dictionaries.joined(rows, name, out)
    if dictionaries.homographs is not None and "sense" in words.columns:
        rows = dictionaries.joined(rows, "homographs", "xh", ("word", "sense"))
    else:
        rows = rows.withColumn("xh", F.lit(None).cast("string"))
    context = F.col("n_words") > 1
    rows = rows.withColumn("xh", F.when(context & (F.col("part") == 0), F.col("xh")))
    alone = F.when(F.col("x4").isNotNull(), "word").when(F.col("x5").isNotNull(), "clitic").when(F.col("x3").isNotNull(), "external").otherwise("rules")
    among = F.when(F.col("xh").isNotNull(), "homograph")
    for name, out in names.items():
        among = among.when(F.col(out).isNotNull(), name)
    rows = rows.withColumn("layer", F.when(context, among.otherwise("rules")).otherwise(alone))
    chosen = F.when(context, F.coalesce("xh", "x0", "x1", "x2", "x3", "x4", "x5", "x6")).otherwise(F.coalesce("x4", "x5", "x3", "x6"))
    rows = rows.withColumn("base", chosen).drop(*names.values(), "xh", "x6")
    heard = X.sandhi(F.col("word"), F.col("base"), F.col("initial"), ~F.col("layer").isin("external", "rules"), F.col("layer") == "homograph")
    return rows.withColumn("ipa", F.when(context, heard).otherwise(F.col("base")))


def with_senses(words: DataFrame, tagged: DataFrame) -> DataFrame:
    """FZ4: the k-th time a word stands in a sentence it takes the sense of its k-th tagged token (doc, sent, pos, word, sense)."""
    order = Window.partitionBy("doc", "sent", "key")
    mine = words.withColumn("key", F.element_at(F.split(F.lower("token"), "-"), 1))
    first = mine.where("part = 0").select("doc", "sent", "pos", "key", F.row_number().over(order.orderBy("pos")).alias("k"))
    theirs = tagged.where("sense IS NOT NULL").withColumn("key", F.lower("word")).select("doc", "sent", "key", "sense", F.row_number().over(order.orderBy("pos")).alias("k"))
    senses = first.join(theirs, ["doc", "sent", "key", "k"]).select("doc", "sent", "pos", "sense")
    return words.join(senses, ["doc", "sent", "pos"], "left")


def assembled(heard: DataFrame) -> DataFrame:
    """FZ6: ``doc, sent, sentence, ipa`` of each sentence, from its words and the ``rest``."""
    words = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "part", "ipa")))
    whole = heard.groupBy("doc", "sent").agg(F.max("sentence").alias("sentence"), F.max("rest").alias("rest"), words.alias("w"))
    # between two words stands what the sentence has there, between two parts of one a space; what follows the last word comes at the end
    gaps = F.split("rest", "\0")
    lists = whole.select("doc", "sent", "sentence", F.array_sort("w").alias("w"), gaps.alias("gaps"))
    firsts = F.filter("w", lambda x: x["part"] == 0)
    more = F.filter("w", lambda x: x["part"] > 0)
    led = F.zip_with(firsts, F.slice("gaps", F.lit(1), F.size(firsts)), lambda x, g: F.struct(x["pos"].alias("pos"), x["part"].alias("part"), F.concat(F.coalesce(g, F.lit("")), F.coalesce(x["ipa"], F.lit(""))).alias("s")))
    tied = F.transform(more, lambda x: F.struct(x["pos"].alias("pos"), x["part"].alias("part"), F.concat(F.lit(" "), F.coalesce(x["ipa"], F.lit(""))).alias("s")))
    every = F.when(F.size(more) == 0, led).otherwise(F.array_sort(F.concat(led, tied)))
    raw = F.concat(F.array_join(F.transform(every, lambda x: x["s"]), ""), F.coalesce(F.element_at("gaps", -1), F.lit("")))
    said = lists.select("doc", "sent", "sentence", raw.alias("raw"))
    attached = F.regexp_replace("raw", f" +(?={X.PAUSE})", "")
    ipa = F.trim(F.regexp_replace(F.regexp_replace(attached, r"\s{2,}", " "), r"\s+([;:,.!?…])", "$1"))
    return said.select("doc", "sent", "sentence", F.coalesce(ipa, F.lit("")).alias("ipa"))


def phonemise(docs: DataFrame, dictionaries: Dictionaries | None = None, id_col: str = "doc_id", text: str = "text", normalise: bool = True, tagged: DataFrame | None = None) -> DataFrame:
    """``doc, sent, sentence, ipa`` (FZ7, WK3)."""
    words = word_parts(word_rows(sentence_rows(docs, id_col, text, normalise), whole=True))
    if tagged is not None:
        words = with_senses(words, tagged)
    return assembled(spoken(words, dictionaries or Dictionaries()))


def speech(docs: DataFrame, dictionaries: Dictionaries | None = None, id_col: str = "doc_id", text: str = "text", limit: int = 200, **how) -> DataFrame:
    """``doc, ipa, chunks`` (PL1, PL2, WK5)."""
    said = phonemise(docs, dictionaries, id_col, text, **how).withColumn("speech", X.speech_text(F.col("ipa")))
    whole = said.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "speech"))), lambda x: x["speech"]), " ").alias("ipa"))
    return whole.withColumn("chunks", X.fragments(F.col("ipa"), limit))


def word_map(words: DataFrame, dictionaries: Dictionaries | None = None) -> DataFrame:
    """WK6: ``word, ipa`` of distinct input words, normalised only where needed."""
    said = words.select("word").distinct()
    plain = said.where(~X.needs_normalising(F.col("word"))).select("word", F.col("word").alias("said"))
    odd = said.where(X.needs_normalising(F.col("word"))).select("word", X.normalised("word").alias("said"))
    docs = plain.unionByName(odd)
    words = word_rows(docs.select(F.col("word").alias("doc"), F.lit(0).alias("sent"), F.col("said").alias("sentence")), whole=True)
    return assembled(spoken(word_parts(words), dictionaries or Dictionaries())).select(F.col("doc").alias("word"), "ipa")
