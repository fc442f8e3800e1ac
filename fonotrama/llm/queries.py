"""The queries ``opN_<name>`` and their SQL, for __spark_entry__."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, langid, maxent, neardup, packing, quality, secretscan, syncmers
from . import common as C


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held = C.is_fold("doc_id", 4, 2)
    profiles = langid.fit(docs.where(~held))
    return langid.predict(docs, profiles, keep=["doc_id", held.alias("held_out")])


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(C.table(spark, sf_dir, "documents"))


#: A conversation of control strings, beside those of the table.
ODD_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT * FROM VALUES " + ", ".join(f"(CAST({c} AS BIGINT), CAST({t} AS BIGINT), '{r}', '{x}')" for c, t, r, x in ODD_TURNS) + f" AS t({', '.join(names)})")
    turns = chat.rendered_turns(C.table(spark, sf_dir, "conversations").select(*names).unionByName(odd))
    return chat.read_back(turns, C.partitions(spark))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(C.table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(C.table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(20)) == 0)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return secretscan.scan(docs, secretscan.fit(docs))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(C.table(spark, sf_dir, "documents"), C.is_fold("doc_id", 5, 1))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_syncmer_fingerprints, op3_chat_round_trip, op4_near_duplicates, op5_best_fit_packing, op6_quality, op7_byte_bpe, op8_nearest_neighbours, op9_secret_scan, op10_language_model)}


def oracle_sql() -> dict[str, str]:
    return {}
