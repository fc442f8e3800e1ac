"""Helpers shared by the training-data operators: splits, Arrow maps, shared storage, word hashing.

All operators take a DataFrame plus column names, select only the columns they need, and so are
indifferent to extra columns, whatever these are called.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch: keeps a worker's share of very long documents small.
BATCH_ROWS = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_of(id_col: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod))


def is_fold(id_col: Column | str, mod: int, rest: int) -> Column:
    """Whether the row is in that fold; a null id is in none."""
    return F.coalesce(split_of(id_col, mod) == rest, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one (spark.checkpoint.dir), else, in tests, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = held.get() if held.isDefined() else f"file://{tempfile.gettempdir()}/fonotrama-shared"
        spark.sparkContext.setCheckpointDir(base) if not held.isDefined() else None
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def own_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session beside ``spark``, on the same cluster and with its settings but for these; the given one stays as it is."""
    own = spark.newSession()
    for k, v in {**spark.conf.getAll, **settings}.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches of at most ``rows`` rows, so that buffers stay small on both sides.

    The bound is a setting of the session that plans the query, so the plan of ``df`` goes on in a session of its own.
    """
    own = own_session(df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})
    held = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(held, own).mapInArrow(run, ddl)


def settle(df: DataFrame, group_bytes: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``group_bytes`` bounds the row groups of the files, for rows of a megabyte or so; ``spark`` reads it if given.
    """
    path = shared_dir(df.sparkSession)
    out = df.write.mode("overwrite")
    (out.option("parquet.block.size", group_bytes) if group_bytes else out).parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files below a settled frame that is no longer needed."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with ``fn`` from at most ``rows`` rows to a dict of columns in the order of ``schema``."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            if batch.num_rows and (out := fn(batch)) is not None:
                yield to_batch(out, target)

    return map_arrow(df, run, schema, rows)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def to_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            full = np.full(max(n, 64), np.uint64(0xD6E8FEB86659FD93), np.uint64)
            full[0] = 1
            _POWERS = np.multiply.accumulate(full)
    return _POWERS


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of all texts, in order, and how many each text has."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], edges + 1)))) if texts else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sizes = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    within = at - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        parts = _BYTE_CODE[buf[at]] * _powers(int(sizes.max()))[within]
        sums = np.add.reduceat(parts, np.concatenate(([0], np.cumsum(sizes)[:-1])))
        return mix64(sums + sizes.astype(np.uint64) * _STEP), counts


def chunks_of(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, each of about ``most`` bytes or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
