"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach; a local one only where the session names none and has no cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, so lost executors cost no more than reading."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and checkpoints that nothing refers to any more: it learns of them by garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys that are broadcast at most: 8 MB of 64-bit numbers.
FEW_KEYS = 1 << 20


def with_and_without(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose long `key` is in `keys` or may be, rows whose key surely is not), so that only the first need a shuffle.

    keys: one column of distinct numbers, counted first: up to FEW_KEYS of them are broadcast; with more, all rows
    are in the first part. Rows with a null key are in the second.
    """
    keys = cut(keys.toDF("_key"))
    if keys.count() > FEW_KEYS:
        return rows.filter(F.col(key).isNotNull()), rows.filter(F.col(key).isNull())
    marked = rows.join(F.broadcast(keys), F.col(key) == F.col("_key"), "left")
    return marked.filter("_key is not null").drop("_key"), marked.filter("_key is null").drop("_key")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new, unused folder below the shared one, as a URI."""
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, by way of a Parquet file, for small rows of rounds: a checkpoint keeps Spark's estimate of the size, a product over all joins so far.

    Some ten rounds later, that number has millions of digits, and planning does not end.
    """
    folder = fresh_folder(df.sparkSession, "rounds")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(n: int, *cols: Column) -> Column:
    """A hash bucket 0..n-1; nulls count as a value of their own."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def hashed_sample(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The n rows of each group with the smallest `key`, a 64-bit hash; rows of equal (group, key) count once.

    A first pass estimates how many keys a group has (small sketches, combined before the shuffle); the keys below the
    share that holds n of them, with room for the estimate's error, are all that is shuffled and ranked. Hashes are even, so
    that is some n rows a group, however many rows the group or one key has. Groups must be few.
    """
    near = F.col(key).cast("double") / 2.0**64 + 0.5
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(key, 0.02).alias("_keys")).withColumnRenamed(group, "_group")
    sizes = sizes.select("_group", (F.lit(1.2 * n + 8 * n**0.5 + 20) / F.col("_keys")).alias("_share"))
    some = rows.join(F.broadcast(sizes), F.col(group) == F.col("_group")).filter(near <= F.col("_share")).drop("_group", "_share")
    some = some.dropDuplicates([group, key])
    return some.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(key))).filter(F.col("_n") <= n).drop("_n")


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `rows` rows and about `size` bytes of text (one row at least)."""
    for batch in batches:
        upto = np.zeros(batch.num_rows + 1, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                offsets = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_string(c.type) else np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1)
                upto += offsets.astype(np.int64) - int(offsets[0])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, min(at + rows, batch.num_rows, int(np.searchsorted(upto, upto[at] + size, "right")) - 1))
            yield batch.slice(at, end - at)
            at = end


_HELD: dict[object, object] = {}


def held(key: object, build: Callable[[], object]) -> object:
    """What a worker keeps from task to task: one model at a time, so that the next operator finds the memory free."""
    if key not in _HELD:
        _HELD.clear()
        hand_back()
        _HELD[key] = build()
    return _HELD[key]


#: Seconds after a task's end in which another one may still find the model.
IDLE_S = 2.0
_IDLE: list[threading.Timer] = []


def let_go() -> None:
    """Drops what the worker holds. Functions that are sent to workers must call this, as they have copies of a module's variables."""
    if _HELD:
        _HELD.clear()
        hand_back()


def busy() -> None:
    while _IDLE:
        _IDLE.pop().cancel()


def idle() -> None:
    """Hands freed memory back, and the model too if no task comes soon: idle workers live on beside those of the next stage."""
    hand_back()
    if _HELD:
        busy()
        timer = threading.Timer(IDLE_S, let_go)
        timer.daemon = True
        _IDLE.append(timer)
        timer.start()


def hand_back() -> None:
    """Gives freed memory back to the system; workers live long and serve one operator after the other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python finds it on any cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp()).resolve() / "tidemark.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(name))
    sc._tidemark_sent = True


#: Bytes in a batch on its way to Python.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *, model: bool = False) -> DataFrame:
    """mapInArrow with this package at hand on the executors, and memory handed back at a task's end.

    Batches are held to BATCH_BYTES by the session's own setting, which is lowered if it is larger: both sides of the
    pipe hold a batch, and ten thousand texts of usual length are too much for that. Tasks with a `model` find what the worker holds; others make it let go of that first,
    and so does a worker that is idle for IDLE_S seconds.
    """
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    set_now = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(key).strip().lower())
    if not set_now or int(set_now[1]) << 10 * " kmgtp".index(set_now[2] or " ") > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy()
        if not model:
            let_go()
        yield from run(batches)
        idle()

    return df.mapInArrow(task, schema)
