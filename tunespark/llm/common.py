"""What the operators share: scratch tables in the cluster's shared folder, text slices, hashing, bounded caches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32 of the id leaves this remainder are held out of every fit.
FOLDS, HELD_OUT = 5, 0
#: Rows of an Arrow batch where a row holds a text or two.
BATCH_ROWS = 1000
#: Texts that a task turns into Python strings at a time.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only where none is named (tests), a new temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        local = spark.sparkContext.master.startswith("local[")
        named = tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers BATCH_ROWS at a time: a batch of texts lies in the executor and in the worker at once. A lower setting of the session stays."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches() for what is run inside; then the session's setting holds again."""
    before = spark.conf.get(BATCH_KEY)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_sized(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """rows joined with keyed, a table of one row a key whose `size` says how many rows have it.

    Keys of more than a thousandth of the rows, fewer than 1,000 of them, are broadcast; so no common key's rows meet in one task.
    """
    border = max(1000, rows.count() // 1000)
    common = F.broadcast(keyed.where(F.col("size") > border))
    return rows.join(common, key).unionByName(rows.join(common.select(key), key, "left_anti").join(keyed.where(F.col("size") <= border), key))


_HELD: list[Callable] = []


def held(made: Callable) -> Callable:
    """Marks a cached function whose values a Python worker holds from task to task."""
    _HELD.append(made)
    return made


def trim() -> None:
    """Gives memory that is free inside this process back to the system."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        give_back(0)


def let_go(module: str) -> None:
    """Gives back what a worker's earlier tasks hold for operators of other modules: workers outlive the stages of a pipeline."""
    others = [f for f in _HELD if f.__module__ != module and f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()
    trim()


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[list[str]]:
    """The strings of a column in order, null as "", in lists of bounded rows and bytes."""
    start, n = 0, len(column)
    while start < n:
        rows = min(SLICE_ROWS, n - start)
        while rows > 1 and column.slice(start, rows).nbytes > SLICE_BYTES:
            rows //= 2
        yield [x or "" for x in column.slice(start, rows).to_pylist()]
        start += rows


def text_to_rows(df: DataFrame, schema: str, rows: Callable[[list[str]], dict[str, list]], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One output row per input row: the kept columns, then what rows(texts) gives for each text."""
    source = df.select(*keep, F.col(text).cast("string").alias(text) if text not in keep else text)
    out_schema = ", ".join([f"{c} {source.schema[c].dataType.simpleString()}" for c in keep] + [schema])
    made = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(rows.__module__)
        for batch in batches:
            parts: dict[str, list] = {c: [] for c in made}
            for texts in slices(batch.column(text)):
                for c, values in rows(texts).items():
                    parts[c].extend(values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(parts[c], type=types[c]) for c in made)], names=[*keep, *made])

    types = {f.name: _arrow(f.dataType.simpleString()) for f in df.sparkSession.createDataFrame([], schema).schema}
    return source.mapInArrow(run, out_schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]


def filter_rows(df: DataFrame, mask: Callable[[list[str]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose text mask() keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(mask.__module__)
        for batch in batches:
            keep: list[bool] = []
            for texts in slices(batch.column(text)):
                keep.extend(bool(x) for x in mask(texts))
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


class Cache(dict):
    """A dict that makes missing values and starts anew when it holds most entries, so that a worker's memory is bounded."""

    def __init__(self, make: Callable, most: int = 500_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


WORDS = re.compile(r"[^\W_]+")
