"""Corpus readers and writers: whole texts, sentences by line, JSON lines, and caches of engine output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """IO8: value, and the first 16 digits of its digest, by which a change is seen."""
    return spark.read.text(path, wholetext=True).withColumn("digest", F.substring(F.sha2("value", 256), 1, 16))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """IO9: one sentence per line, trimmed, without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("sentence")).where("sentence <> ''")


def examples(spark: SparkSession, path: str) -> DataFrame:
    """IO10: word, sense and sentence; malformed lines are skipped."""
    return spark.read.schema("word string, sense string, sentence string").json(path, mode="DROPMALFORMED").where("word IS NOT NULL AND sense IS NOT NULL AND sentence IS NOT NULL")


def save(df: DataFrame, path: str, form: str = "parquet") -> None:
    """IO11."""
    df.write.mode("overwrite").format(form).save(path)


def cache(spark: SparkSession, path: str) -> DataFrame:
    """IO12: sentence and ipa from either layout: two arrays of one length, or an object of sentence to ipa."""
    text = spark.read.text(path, wholetext=True)
    pair = text.select(F.from_json("value", "struct<sentencas:array<string>,espeak:array<string>>").alias("j")).select("j.*").where("size(sentencas) = size(espeak)")
    zipped = pair.select(F.inline(F.arrays_zip(F.col("sentencas").alias("sentence"), F.col("espeak").alias("ipa"))))
    plain = text.where("get_json_object(value, '$.sentencas') IS NULL").select(F.explode(F.from_json("value", "map<string,string>")).alias("sentence", "ipa"))
    return zipped.toDF("sentence", "ipa").unionByName(plain)


def cache_is_valid(cached: DataFrame, wanted: DataFrame, key: str, share: float = 0.9) -> bool:
    """IO13: whether the cache holds at least a share of the wanted keys, by count."""
    have, want = cached.select(key).distinct().count(), wanted.select(key).distinct().count()
    return have >= share * want


def cache_is_same(cached: DataFrame, wanted: DataFrame) -> bool:
    return cached.exceptAll(wanted).isEmpty() and wanted.exceptAll(cached).isEmpty()


def missing(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """CM15: what is still to be worked out."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")
