"""Dictionaries as DataFrames (word, ipa), from JSON files in the shared storage or from the small seed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernel

SCHEMA = "word string, ipa string"
#: Seed entries by layer, in the documented file layout.
SEED = {
    "word": {"casa": "kˈazæ", "água": "ˈaɡwæ", "muito": "mˈuɪ̃tʊ"},
    "clitic": {"de": "dʒˈy", "o": "ʊ", "os": "ˈʊs", "que": "kˈy", "na": "nˈa", "a": "ˈa"},
    "context_clitic": {"de": "dʒy", "que": "ky", "uma": "ˌumæ", "para": "pˌaɾæ", "o": "ʊ", "os": "ʊs", "as": "as"},
    "context_word": {"ser": "ser", "não": "nɐ̃ʊ̃"},
}
LAYERS = ("context_clitic", "context_word", "context_external", "external", "word", "clitic")


def from_mapping(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(entries.items()), SCHEMA) if entries else spark.createDataFrame([], SCHEMA)


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: from_mapping(spark, entries) for name, entries in SEED.items()}


def _parsed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The file's JSON as one column; a missing file or a value of another type gives null."""
    try:
        text = spark.read.text(path, wholetext=True)
        text.schema  # noqa: B018
    except Exception as e:  # the session raises the same class for any unreadable path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"j {kind}")
    return text.select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("j"))


def flat(spark: SparkSession, path: str) -> DataFrame:
    """IO2: one object of word to ipa; anything else is an empty dictionary."""
    whole = _parsed(spark, path, "map<string,string>")
    return whole.select(F.explode("j").alias("word", "ipa")).where("ipa IS NOT NULL")


def lookup_paths(stem: str, beside: str | None = None, prefix: str = "FONOTRAMA_") -> list[str]:
    """IO3: where a dictionary is looked for, in order: the path in the environment, then the file beside the program, in the
    working folder, and in its ``data`` and ``cache`` folders. For ``first_filled``; resolved on the driver."""
    named = os.environ.get(prefix + stem.upper())
    folders = [*([beside] if beside else []), os.getcwd(), *(os.path.join(os.getcwd(), d) for d in ("data", "cache"))]
    return [*([named] if named else []), *(f"file://{os.path.join(os.path.abspath(d), stem)}.json" for d in folders)]


def first_filled(spark: SparkSession, paths: list[str]) -> DataFrame:
    """IO3: the first of several files that has entries."""
    for path in paths:
        found = flat(spark, path)
        if not found.isEmpty():
            return found
    return spark.createDataFrame([], SCHEMA)


def curated(spark: SparkSession, path: str, word_field: str, clitic_field: str) -> tuple[DataFrame, DataFrame]:
    """IO1: a file of two objects, such as ``lexico`` and ``cliticos``."""
    whole = _parsed(spark, path, f"struct<{word_field}:map<string,string>,{clitic_field}:map<string,string>>")
    return tuple(whole.select(F.explode(f"j.{f}").alias("word", "ipa")) for f in (word_field, clitic_field))


def homographs(spark: SparkSession, path: str) -> DataFrame:
    """IO4: word, sense, ipa, confidence, occurrences."""
    whole = _parsed(spark, path, "map<string,map<string,struct<ipa:string,confianca:double,ocorrencias:bigint>>>")
    by_word = whole.select(F.explode("j").alias("word", "senses"))
    return by_word.select("word", F.explode("senses").alias("sense", "e")).select("word", "sense", "e.ipa", F.col("e.confianca").alias("confidence"), F.col("e.ocorrencias").alias("occurrences"))


def diaeresis_rules(spark: SparkSession, path: str) -> kernel.Rules:
    """The words and stems whose u sounds; a file of under a thousand entries."""
    r = _parsed(spark, path, "struct<palavras_com_trema:array<string>,radicais:map<string,int>>").select("j.*").first()
    return kernel.Rules(frozenset(r["palavras_com_trema"] or ()), tuple(sorted(r["radicais"] or {}, key=lambda s: (-len(s), s)))) if r else kernel.SEED


def layered(*layers: DataFrame) -> DataFrame:
    """LX6: later layers win."""
    ranked = [d.select("word", "ipa", F.lit(i).alias("layer")) for i, d in enumerate(layers)]
    every = ranked[0]
    for d in ranked[1:]:
        every = every.unionByName(d)
    order = Window.partitionBy("word").orderBy(F.desc("layer"))
    return every.withColumn("r", F.row_number().over(order)).where("r = 1").select("word", "ipa")


def voice_layer(voices: DataFrame, voice: str) -> DataFrame:
    """WK8: the entries of a voice, or of ``__default__`` if it has none."""
    own = voices.where(F.col("voice") == voice)
    return (own if not own.isEmpty() else voices.where("voice = '__default__'")).select("word", "ipa")
