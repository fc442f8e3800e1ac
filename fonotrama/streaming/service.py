"""The request service: JSON lines in, JSON lines out, as a batch or a structured stream.

A stream has no state but its dictionaries. Each micro-batch is one job: requests are parsed once, their
texts and words go through the same plan as a batch's, and one response per request is written. A
``set_lexicon`` request names files whose entries replace the dictionaries from the next micro-batch on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..plans import phonemes as P
from ..sources import lexicons as L

BUILD = "fonotrama-1"
ACTIONS = ("version", "set_lexicon", "process", "process_piper", "process_piper_chunks", "process_batch")
REQUEST = (
    "action string, text string, voice string, words array<string>, overrides map<string,string>, base_path string, global_path string, "
    "context_path string, voice_paths map<string,string>, voice_paths_contexto map<string,string>, _bad string"
)
DEFAULT_VOICE = "__default__"


@dataclass
class Service:
    """Dictionaries in force. ``voices`` and ``voices_context`` are (voice, word, ipa); each voice's are complete."""

    spark: SparkSession
    curated: P.Dictionaries = field(default_factory=P.Dictionaries)
    voices: DataFrame | None = None
    voices_context: DataFrame | None = None

    def set_lexicon(self, base: str | None, common: str | None, context: str | None, voice_paths: dict[str, str], voice_paths_context: dict[str, str]) -> None:
        """WK2, LX6: per voice the base, then the common entries, then the voice's own; the context side takes no common ones."""
        flat = lambda p: L.flat(self.spark, p) if p else L.from_mapping(self.spark, {})

        def layers(first: list[DataFrame], own: dict[str, str]) -> DataFrame:
            named = {DEFAULT_VOICE: None, **own}
            found = [L.layered(*first, *([flat(p)] if p else [])).select(F.lit(v).alias("voice"), "word", "ipa") for v, p in named.items()]
            every = found[0]
            for d in found[1:]:
                every = every.unionByName(d)
            return every

        self.voices = layers([flat(base), flat(common)], voice_paths or {})
        self.voices_context = layers([flat(context)], voice_paths_context or {})

    def for_voice(self, voice: str, overrides: dict[str, str]) -> P.Dictionaries:
        """WK8: the dictionaries of a voice, with the request's overrides above both sides."""
        own = L.from_mapping(self.spark, overrides) if overrides else None
        pick = lambda d: None if d is None else L.voice_layer(d, voice)
        put = lambda d: own if d is None else d if own is None else L.layered(d, own)
        return replace(self.curated, external=put(pick(self.voices)), context_external=put(pick(self.voices_context)), checked={})


def requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """IO6: parsed requests with ``rid``; blank lines are skipped, bad ones have ``_bad``."""
    rows = lines.where(F.trim(F.col(value)) != "").withColumn("rid", F.monotonically_increasing_id())
    parsed = F.from_json(F.col(value), REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select("rid", parsed.alias("r")).select("rid", "r.*")


def respond(reqs: DataFrame, dictionaries: P.Dictionaries) -> DataFrame:
    """``rid, response``: WK1 and WK3 to WK7 for requests that share dictionaries."""
    bad, action = F.col("_bad").isNotNull(), F.coalesce("action", F.lit(""))
    fixed = reqs.where(bad | ~action.isin("process", "process_piper", "process_piper_chunks", "process_batch"))
    version = F.to_json(F.struct(F.lit(BUILD).alias("build"), F.array(*map(F.lit, ACTIONS[1:])).alias("features")))
    error = lambda text: F.to_json(F.struct(text.alias("error")))
    said = F.when(bad, error(F.lit(f"JSON parse (build {BUILD})"))).when(action == "version", version).when(action == "set_lexicon", F.lit('{"ok":true}'))
    out = fixed.select("rid", said.otherwise(error(F.concat(F.lit("Unknown action: "), action, F.lit(f" (build {BUILD})")))).alias("response"))

    texts = reqs.where(~bad & action.isin("process", "process_piper", "process_piper_chunks")).select("rid", "action", F.coalesce("text", F.lit("")).alias("text"))
    heard = P.phonemise(texts, dictionaries, "rid", "text").withColumnRenamed("doc", "rid")
    heard = heard.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("sent", "sentence", "ipa"))).alias("s"))
    rows = texts.select("rid", "action").join(heard, "rid", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() AS array<struct<sent:int,sentence:string,ipa:string>>)")))
    plain = F.transform("s", lambda x: F.struct(x["sentence"].alias("text"), x["ipa"].alias("phonemes")))
    tokens = F.transform("s", lambda x: F.struct(x["sentence"].alias("text"), X.speech_tokens(x["ipa"]).alias("phonemes")))
    joined = F.array_join(F.transform("s", lambda x: F.trim(X.speech_text(x["ipa"]))), " ")
    rows = rows.withColumn("whole", joined)
    body = (
        F.when(F.col("action") == "process", F.to_json(F.struct(plain.alias("sentences"))))
        .when(F.col("action") == "process_piper", F.to_json(F.struct(tokens.alias("sentences"))))
        .otherwise(F.to_json(F.struct(F.col("whole").alias("ipa_piper"), X.fragments(F.col("whole")).alias("chunks"))))
    )
    out = out.unionByName(rows.select("rid", body.alias("response")))

    batches = reqs.where(~bad & (action == "process_batch")).select("rid", F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: w.isNotNull()).alias("words"))
    each = batches.select("rid", F.explode(F.array_distinct("words")).alias("word"))
    read = each.join(P.word_map(each, dictionaries), "word", "left").groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("word", "ipa"))).alias("phonemes"))
    answered = batches.join(read, "rid", "left").select("rid", F.to_json(F.struct(F.coalesce("phonemes", F.expr("cast(map() AS map<string,string>)")).alias("phonemes"), F.lit(0).alias("timing_ms"), F.size("words").alias("total"))).alias("response"))
    return out.unionByName(answered)


def serve_batch(service: Service, lines: DataFrame) -> DataFrame:
    """``rid, response`` of a batch of lines. Requests are grouped by voice and overrides, of which a batch has few kinds."""
    reqs = requests(lines)
    for r in reqs.where("action = 'set_lexicon'").orderBy("rid").toLocalIterator():
        service.set_lexicon(r["base_path"], r["global_path"], r["context_path"], r["voice_paths"], r["voice_paths_contexto"])
    kinds = reqs.select(F.coalesce("voice", F.lit("")).alias("voice"), F.coalesce(F.to_json("overrides"), F.lit("{}")).alias("overrides")).distinct()
    out = None
    for k in kinds.toLocalIterator():
        import json

        own = reqs.where((F.coalesce("voice", F.lit("")) == k["voice"]) & (F.coalesce(F.to_json("overrides"), F.lit("{}")) == k["overrides"]))
        part = respond(own, service.for_voice(k["voice"], json.loads(k["overrides"])))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else lines.sparkSession.createDataFrame([], "rid long, response string")


def serve(service: Service, lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """IO6, IO7: a streaming query that answers each micro-batch of ``lines`` and hands ``rid, response`` to ``sink``."""
    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(serve_batch(service, df), n)).start()


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of the files that appear in a folder."""
    return spark.readStream.text(folder)


def write_lines(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink of text files, one response a line, in the order of requests; a batch that is retried is written anew."""
    return lambda df, n: df.sort("rid").select("response").write.mode("overwrite").text(f"{folder}/batch={n}")
