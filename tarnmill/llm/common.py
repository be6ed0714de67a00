"""What the operators of this subpackage share: tables, scratch space, hashing."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task takes up at once.
SLICE_BYTES = 4 << 20

ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and both are
    one process, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tarnmill-")
        atexit.register(shutil.rmtree, _own[app].removeprefix("file://"), True)
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tarnmill-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there, and no executor is needed to read it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote and that no later plan reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus, never null: a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes of a text column, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def gathered(df: DataFrame, columns: dict[str, str]) -> list[np.ndarray]:
    """The columns of a small table as arrays on the driver, sent as packed bytes: rows would take many times as much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(c)).astype(t).tobytes()], pa.binary()) for c, t in columns.items()], [*columns])

    rows = df.select(*columns).mapInArrow(run, ", ".join(f"{c} binary" for c in columns)).collect()
    return [np.concatenate([np.frombuffer(r[c], t) for r in rows] or [np.empty(0, t)]) for c, t in columns.items()]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by sorting, which large arrays of numbers are fastest at."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def powers_by_size() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Filled by powers(); one for each Python worker."""
    return {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64: n and more of them."""
    made = powers_by_size()
    if not made or next(iter(made)) < n:
        size = 1 << max(16, n.bit_length())
        up, down = np.full(size, ODD), np.full(size, np.uint64(pow(int(ODD), -1, 1 << 64)))
        up[0] = down[0] = 1
        made.clear()
        made[size] = np.cumprod(up), np.cumprod(down)
    return next(iter(made.values()))


def run_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: differences of a running polynomial hash, shifted to one place."""
    up, down = powers(len(data) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    return mix((run[stop] - run[start]) * down[start])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[data], [True])).astype(np.int8)))
    return run_hashes(data, edge[::2], edge[1::2])


def give_back() -> None:
    """Free memory goes back to the system: a Python worker outlives its task, and others run beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def tidy(run):
    """A function over batches, a group's table or two groups' tables that gives free memory back at its end."""

    def batches(given):
        try:
            yield from run(given)
        finally:
            give_back()

    def table(group):
        try:
            return run(group)
        finally:
            give_back()

    def tables(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return batches if inspect.isgeneratorfunction(run) else table if len(inspect.signature(run).parameters) == 1 else tables
