"""Comparison of two engines' phoneme outputs, word by word and sentence by sentence.

``outputs`` is a table ``sent_id, sentence, ipa_a, ipa_b``; a null output is missing. Alignment happens within a
row, so only counts and distinct words are exchanged, each after a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as X
from .mining import counted

#: Six sentences that set a word before a vowel, a voiced and an unvoiced consonant, at the end, at the start, and alone.
TEMPLATES = ("Eu vejo {p} água", "Eu vejo {p} bola", "Eu vejo {p} coisa", "Eu vejo {p}", "{p} está aqui", "{p}")
# Abbreviations that are no words to compare.
ABBREVIATIONS = (
    "sr", "sra", "srta", "dr", "dra", "prof", "profa", "eng", "av", "r", "pç", "ed", "apto", "ap", "pág", "pag", "fig", "obs", "ex", "etc", "cia", "ltda", "no", "tel", "cel",
    "kg", "km", "cm", "mm", "ml", "mg", "gb", "mb", "kb", "tb",
)
#: Sets of at most so many rows are broadcast; larger ones are joined by exchange.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted as small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _not_speakable(word: Column) -> Column:
    """Not letters only, or an abbreviation: such words are left out of comparisons."""
    return word.rlike(r"[^\p{L}]") | F.lower(word).isin(*ABBREVIATIONS)


def word_occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, skipped``: every part of two and more characters of every token (CM4, before it is made distinct)."""
    tokens = docs.select(F.explode(X.text_words(F.col(text))).alias("t")).select(X.bare(F.col("t")).alias("w")).where(F.length("w") >= 2)
    parts = F.filter(F.transform(F.split("w", "-"), X.bare), lambda p: F.length(p) >= 2)
    return tokens.select(F.explode(F.when(F.col("w").contains("-"), parts).otherwise(F.array("w"))).alias("word")).select("word", _not_speakable(F.col("word")).alias("skipped"))


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """CM4: the words to compare."""
    return word_occurrences(docs, text).where(~F.col("skipped")).select("word").distinct()


def skipped_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """CM4: how many occurrences are left out."""
    return word_occurrences(docs, text).agg(F.count_if("skipped").alias("skipped"))


def plain_sentences(docs: DataFrame, exceptions: DataFrame | None = None, text: str = "text") -> DataFrame:
    """CM5: rows without a token of two and more characters that is no plain word, or stands in ``exceptions`` (word)."""
    words = X.text_words(F.col(text))
    odd = F.exists(words, lambda t: (F.length(t) >= 2) & _not_speakable(t))
    rows = docs.where(~odd)
    if exceptions is None:
        return rows
    names = rows.columns
    marked = rows.withColumn("__row", F.monotonically_increasing_id())
    hit = marked.select("__row", F.explode(words).alias("word")).select("__row", F.lower("word").alias("word")).join(small(exceptions.select("word").distinct()), "word", "left_semi").select("__row").distinct()
    return marked.join(hit, "__row", "left_anti").select(*names)


def compare_words(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CM6: of two tables (word, ipa), a summary ``total, matched, skipped`` and the differing rows."""
    both = left.select("word", F.col("ipa").alias("a")).join(right.select("word", F.col("ipa").alias("b")), "word", "left")
    both = both.select("word", F.col("a"), F.col("b"), (F.col("a").isNull() | F.col("b").isNull()).alias("skipped"))
    both = both.withColumns({"ipa_a": X.plain_ipa(F.col("a")), "ipa_b": X.plain_ipa(F.col("b"))})
    same = ~F.col("skipped") & (F.col("ipa_a") == F.col("ipa_b"))
    summary = both.agg(F.count_if(~F.col("skipped")).alias("total"), F.count_if(same).alias("matched"), F.count_if("skipped").alias("skipped"))
    return summary, both.where(~F.col("skipped") & (F.col("ipa_a") != F.col("ipa_b"))).select("word", "ipa_a", "ipa_b")


def compare_sentences(outputs: DataFrame) -> DataFrame:
    """CM9: ``total, matched`` over whole sentences that both engines gave."""
    rows = outputs.where("ipa_a IS NOT NULL AND ipa_b IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(X.plain_ipa(F.col("ipa_a")) == X.plain_ipa(F.col("ipa_b"))).alias("matched"))


def _token_lists(outputs: DataFrame, *keep: str) -> DataFrame:
    rows = outputs.where("ipa_a IS NOT NULL AND ipa_b IS NOT NULL")
    plain = rows.select("sent_id", *keep, "sentence", X.plain_ipa(F.col("ipa_a")).alias("a"), X.plain_ipa(F.col("ipa_b")).alias("b"))
    return plain.select("sent_id", *keep, X.ipa_words(F.col("a")).alias("ta"), X.ipa_words(F.col("b")).alias("tb"), X.text_words(F.col("sentence")).alias("tt"))


def _label(word: Column, at: Column) -> Column:
    return F.coalesce(F.lower(word), F.concat(F.lit("["), at.cast("string"), F.lit("]")))


def aligned(outputs: DataFrame, *keep: str, around: bool = False) -> DataFrame:
    """CM10: ``sent_id, pos, word, ipa_a, ipa_b`` of sentences with as many tokens on either side, and the columns to ``keep``;
    ``around`` adds ``anterior`` and ``proxima``, the words before and after, and ``total``, the tokens of the sentence.

    A sentence's lists are zipped before they are exploded, so that no token's row carries a list.
    """
    n = F.size("ta")
    columns = {"ta": F.col("ta"), "tb": F.col("tb"), "w": F.slice("tt", F.lit(1), n)}
    if around:
        fewer = F.greatest(n - 1, F.lit(0))
        columns |= {"after": F.slice("tt", F.lit(2), fewer), "before": F.concat(F.array(F.lit(None).cast("string")), F.slice("tt", F.lit(1), fewer))}
    lists = _token_lists(outputs, *keep).select("sent_id", *keep, n.alias("total"), F.when((n == F.size("tb")) & (n > 0), F.arrays_zip(*[c.alias(k) for k, c in columns.items()])).alias("x"))
    # an outer explosion, as Spark would work out the lists once more to filter for an inner one
    rows = lists.select("sent_id", *keep, "total", F.posexplode_outer("x").alias("pos", "x")).where("pos IS NOT NULL")
    at = F.col("pos")
    out = rows.select("sent_id", *keep, "pos", _label(F.col("x.w"), at).alias("word"), F.col("x.ta").alias("ipa_a"), F.col("x.tb").alias("ipa_b"), *(["total", "x"] if around else []))
    if around:
        out = out.withColumns({"proxima": F.when(at + 1 < F.col("total"), _label(F.col("x.after"), at + 1)), "anterior": F.when(at > 0, _label(F.col("x.before"), at - 1))}).drop("x")
    return out


def differences(outputs: DataFrame) -> DataFrame:
    return aligned(outputs).where("ipa_a <> ipa_b")


def aligned_summary(outputs: DataFrame) -> DataFrame:
    """CM10: ``total, matched, structural`` without an exchange of tokens."""
    lists = _token_lists(outputs)
    even = F.size("ta") == F.size("tb")
    same = F.size(F.filter(F.zip_with("ta", "tb", lambda a, b: a == b), lambda x: x))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return lists.agg(zero(F.when(even, F.size("ta"))).alias("total"), zero(F.when(even, same)).alias("matched"), F.count_if(~even).alias("structural"))


def categories(outputs: DataFrame, examples: int = 3) -> DataFrame:
    """CM8: ``category, n, examples`` (the first words by sentence and position) of the differences.

    What is exchanged and ranked are counts by category and sentence; only the first sentences of a category, which hold its
    first words, are aligned once more.
    """
    told = lambda diffs: diffs.select(X.divergence(F.col("ipa_a"), F.col("ipa_b")).alias("category"), "sent_id", "pos", "word")
    counts = told(differences(outputs)).groupBy("category", "sent_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("category").orderBy("sent_id")
    # the condition on n is always true, and makes Spark use the exchange of the counts again instead of aligning all once more
    first = counts.withColumn("r", F.row_number().over(order)).where((F.col("r") <= examples) & (F.col("n") > 0)).select(F.col("category").alias("c"), F.col("sent_id").alias("s"))
    again = outputs.join(F.broadcast(first.select("s").distinct()), F.col("sent_id").eqNullSafe(F.col("s")), "left_semi")  # so many per category
    rank = F.row_number().over(Window.partitionBy("category").orderBy("sent_id", "pos"))
    named = told(differences(again)).withColumn("r", rank).where(F.col("r") <= examples).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("e"))
    totals = counts.groupBy("category").agg(F.sum("n").alias("n"))
    # every category has examples; an inner join would filter the counts, which then were no longer one exchange for both
    return totals.join(named, "category", "left").select("category", "n", F.array_join(F.transform("e", lambda x: x["word"]), ",").alias("examples"))


def errors_by_sentence(outputs: DataFrame) -> DataFrame:
    """CM12: ``errors`` (0 to 4, 5+), how many sentences have so many, and their share in per cent; all sentences count."""
    lists = _token_lists(outputs)
    wrong = F.when(F.size("ta") == F.size("tb"), F.size(F.filter(F.zip_with("ta", "tb", lambda a, b: a != b), lambda x: x))).otherwise(0)
    per = outputs.select("sent_id").join(lists.select("sent_id", wrong.alias("n")), "sent_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    counts = per.groupBy(F.when(F.col("n") >= 5, F.lit("5+")).otherwise(F.col("n").cast("string")).alias("errors")).agg(F.count(F.lit(1)).alias("sentences"))
    total = counts.agg(F.sum("sentences").alias("all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("errors", "sentences", (F.col("sentences") * 100 / F.col("all")).alias("percent"))


def homograph_accuracy(outputs: DataFrame, targets: DataFrame) -> DataFrame:
    """CM11: per target word ``occurrences, errors, correct, accuracy``."""
    wanted = small(targets.select("word").distinct())
    tokens = outputs.select(X.text_words(F.col("sentence")).alias("t")).select(F.explode_outer("t").alias("t")).where("t IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    seen = tokens.select(X.bare(F.col("t")).alias("word"), "n").join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("occurrences"))
    wrong = differences(outputs).groupBy("word").agg(F.count(F.lit(1)).alias("errors")).join(wanted, "word", "left_semi")
    rows = targets.select("word").distinct().join(seen, "word", "left").join(wrong, "word", "left").fillna(0, ["occurrences", "errors"])
    correct = F.greatest(F.lit(0), F.col("occurrences") - F.col("errors"))
    return rows.select("word", "occurrences", "errors", correct.alias("correct"), F.when(F.col("occurrences") > 0, correct / F.col("occurrences")).alias("accuracy"))


def worst_words(diffs: DataFrame, k: int = 15) -> DataFrame:
    """CM13: the words of most errors; ties in the order in which they are first seen."""
    counts = counted(diffs, ["word"], ["sent_id", "pos"])
    return counts.orderBy(F.desc("n"), "first").limit(k).select("word", F.col("n").alias("errors"))


def divergence_lexicon(left: DataFrame, right: DataFrame) -> DataFrame:
    """CM14: ``word, ipa`` of the right table where the left one reads otherwise or not at all."""
    both = right.where("ipa IS NOT NULL").select("word", "ipa").join(left.select("word", F.col("ipa").alias("a")), "word", "left")
    return both.where(X.plain_ipa(F.col("a")) != X.plain_ipa(F.col("ipa"))).select("word", "ipa")


def reading_of(sentence: Column, ipa: Column, word: Column) -> Column:
    """CM16: what ``word`` sounds like where it first stands in a sentence, null if the lists don't align."""
    words = F.transform(X.text_words(sentence), lambda w: F.lower(w))
    said = X.ipa_words(X.plain_ipa(ipa))
    at = F.array_position(words, F.lower(word)).cast("int")
    return F.when((F.size(words) == F.size(said)) & (at > 0), F.get(said, at - 1))


def probes(words: DataFrame, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """CM17: ``word, template, sentence``: each distinct word in every template."""
    made = F.array(*[F.struct(F.lit(i).alias("template"), F.concat_ws("", F.lit(a), F.col("word"), F.lit(b)).alias("sentence")) for i, (a, _, b) in enumerate(t.partition("{p}") for t in templates)])
    return words.select("word").distinct().select("word", F.inline(made))


def probe_verdicts(read: DataFrame) -> DataFrame:
    """CM17: of (word, template, ipa_a, ipa_b) per word which engine varies with its context."""
    a, b = F.count_distinct("ipa_a"), F.count_distinct("ipa_b")
    same = F.min("ipa_a") == F.min("ipa_b")
    verdict = F.when((a == 1) & (b == 1), F.when(same, F.lit("consistent")).otherwise(F.lit("systematic"))).when(b == 1, F.lit("excess")).when(a == 1, F.lit("missing rule")).otherwise(F.lit("ambiguous"))
    return read.where("ipa_b IS NOT NULL").groupBy("word").agg(a.alias("readings_a"), b.alias("readings_b"), verdict.alias("verdict"))
