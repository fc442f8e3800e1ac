"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A k-mer (k code points) is an anchor if the least hash among its inner s-mers is that of its first or
its last one. Whether a k-mer is an anchor depends on nothing outside it, so a text can be scanned in
blocks, and the anchors of a text made of two pieces are those of the pieces and of the seam. The
fingerprint is the ``SKETCH`` least distinct anchor hashes in ascending order, 16 hex digits each, and
the likeness of two is the share of the least ``SKETCH`` of their union that both hold: the Jaccard
similarity of the anchor sets, exact where these are smaller than the sketch.

Defined results: a null text is empty; a text without an anchor, as one of under k code points, is
fingerprinted as a whole; equal texts have equal fingerprints, and likeness 1. Rows are ordered by id, a null one first; rows of one
id by a hash of the text, then by the text; the row after the last is the first, so a single row follows itself; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, S = 16, 6
#: Anchor hashes in a fingerprint.
SKETCH = 64
#: Code points that are scanned at a time.
BLOCK = 2048
#: Ranges of rows for each shuffle partition, and the most of them; rows that are drawn for each range's start.
RANGES, MOST_RANGES, DRAWN = 32, 1 << 16, 16


def _marked(block: Column, first: Column, k: int, s: int) -> Column:
    """The anchors of a block whose first code point has the 0-based position ``first``."""
    w = k - s + 1
    mers = F.transform(F.regexp_extract_all(block, F.lit(f"(?s)(?=(.{{{s}}}))."), F.lit(1)), lambda x: F.xxhash64(x))
    inner = sorted({*range(0, w - 1, s), w - 1})  # these s-mers together cover the k-mer

    def scan(h: Column) -> Column:
        def first_least(x: Column, i: Column) -> Column:
            held = x <= F.get(h, i + 1)
            for j in range(2, w):
                held = held & (x <= F.get(h, i + j))
            return F.when(held, i)  # beyond the end a null stands, which no comparison passes

        def last_least(x: Column, i: Column) -> Column:
            held = x <= F.get(h, i - 1)
            for j in range(2, w):
                held = held & (x <= F.get(h, i - j))
            return F.when(held, i - (w - 1))

        ends = F.sort_array(F.array_union(F.array_compact(F.transform(h, first_least)), F.array_compact(F.transform(h, last_least))))
        return F.transform(ends, lambda i: F.struct((first + i).cast("int").alias("at"), F.xxhash64(*[F.get(h, i + j) for j in inner]).alias("hash")))

    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    return F.flatten(F.transform(F.array(mers), lambda h: F.when(F.size(h) >= w, scan(h)).otherwise(none)))


def anchors(text: Column, k: int = K, s: int = S, block: int = BLOCK) -> Column:
    """array<struct<at, hash>>: the 0-based positions and hashes of a text's anchors."""
    n = F.length(text)
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - k) / block).cast("int")))
    return F.flatten(F.transform(blocks, lambda b: _marked(F.substring(text, b * block + 1, F.lit(block + k - 1)), b * block, k, s)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(marks: Column, text: Column, size: int = SKETCH) -> Column:
    """The least distinct hashes, ascending; a text without an anchor, such as one under k code points, has its own."""

    def least(found: Column) -> Column:
        hashes = F.when(F.size(found) > 0, F.transform(found, lambda m: m["hash"])).otherwise(F.array(F.xxhash64(text, F.lit(K))))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)

    return _let(marks, least)


def as_text(held: Column) -> Column:
    return F.array_join(F.transform(held, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """0 to 1, of two sketches."""
    both = lambda least: F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.size(least).cast("double")
    return _let(F.slice(F.sort_array(F.array_union(a, b)), 1, size), both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), as_text(sketch(anchors(F.col("text")), F.col("text"))).alias("fingerprint"))


def anchor_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per anchor, for positional matching: ``doc_id, at, hash``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), anchors(F.coalesce(F.col(text), F.lit(""))).alias("marks"))
    return rows.select("doc_id", F.explode("marks").alias("m")).select("doc_id", "m.at", "m.hash")


def with_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc_id, text, marks, sketch``, and the following row's as ``next_*``, by one exchange of the texts.

    Rows are dealt by ranges of their place in the order, as even as a draw of ``DRAWN`` rows for each makes them however
    the ids are spread; a range starts at a row of the table, and that row is also sent to the range before it.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, RANGES * parts)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.xxhash64("text").alias("hash"))
    rows = rows.withColumn("place", place)
    drawn = F.when(F.rand(1) < ranges * DRAWN / max(1, docs.count()), F.col("place"))
    starts = rows.select("place", drawn.alias("drawn")).agg(F.min("place").alias("first"), F.sort_array(F.collect_list("drawn")).alias("drawn"))
    even = F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda i: F.get("drawn", F.floor(i * F.size("drawn") / ranges).cast("int")))
    starts = starts.select(F.array_distinct(F.array_compact(F.concat(F.array("first"), even))).alias("starts"))

    def upper(low: Column, step: Column) -> Column:
        return F.when(F.get("starts", low + step) <= F.col("place"), low + step).otherwise(low)

    steps = [F.lit(1 << b) for b in reversed(range(MOST_RANGES.bit_length()))]
    rows = rows.withColumn("starts", starts.scalar()).withColumn("range", F.aggregate(F.array(*steps), F.lit(0), upper))
    before = F.when(F.col("range") == 0, F.size("starts") - 1).otherwise(F.col("range") - 1)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("copy"))
    twice = F.array(own, F.struct(before.alias("range"), F.lit(True).alias("copy")))
    dealt = rows.select("doc_id", "place", "text", F.explode(F.when(F.get("starts", "range") == F.col("place"), twice).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "place", "text", "to.range", "to.copy").repartition(parts, "range")
    dealt = dealt.withColumn("marks", anchors(F.col("text"))).withColumn("sketch", sketch(F.col("marks"), F.col("text")))
    by = Window.partitionBy("range").orderBy("copy", "place", "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(by) for c in ("text", "marks", "sketch")}).where(~F.col("copy"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half gives way to the start of the next one."""
    rows = with_next(docs, id_col, text)
    n = F.length("text")
    rows = rows.withColumns({"n_chars": n.cast("long"), "kept": n - F.floor(n / 2).cast("int")})
    rows = rows.withColumn("taken", F.least(F.col("n_chars") - F.col("kept"), F.length("next_text")).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("kept")), F.substring(F.col("next_text"), F.lit(1), F.col("taken"))))
    lead_in = F.least(F.col("kept"), F.lit(K - 1))
    seam = F.concat(F.substring(F.col("text"), F.col("kept") - lead_in + 1, lead_in), F.substring(F.col("next_text"), F.lit(1), F.least(F.col("taken"), F.lit(K - 1))))
    within = lambda marks, upto: F.when(upto >= K, F.filter(marks, lambda m: m["at"] <= upto - K)).otherwise(F.slice(marks, 1, 0))
    pieced = F.concat(within(F.col("marks"), F.col("kept")), within(F.col("next_marks"), F.col("taken")), _marked(seam, F.lit(0), K, S))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.col("sketch").alias("own"), sketch(pieced, F.col("edited")).alias("other"), F.col("next_sketch").alias("following"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
