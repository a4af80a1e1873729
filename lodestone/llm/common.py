"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only up to so many bytes; beyond it the plain shuffle join runs.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, for a session within one machine, one of our own where that is unset."""
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written into the shared folder. They cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # the shuffles of what is now written are of no further use
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under BROADCAST_BYTES; otherwise Spark chooses."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


#: Bytes of an Arrow batch between the JVM and Python. Both sides hold a few at a time for each running task.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Has the session pass batches of BATCH_BYTES to Python, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, str(64 << 20)).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def lean(run):
    """run, followed by giving back to the system what memory it no longer needs, as workers are used again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def list_array(values: np.ndarray, lengths, kind: pa.DataType, valid=None) -> pa.Array:
    """A list array of consecutive runs of values; rows that aren't valid become null."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(np.asarray(lengths, dtype=np.int64), out=offsets[1:])
    mask = None if valid is None or np.all(valid) else pa.array(~np.asarray(valid, dtype=bool))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind), mask=mask)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, name: str, limit: int = 4 << 20):
    """The batch in pieces of about limit bytes of the named text column, so that workers stay small."""
    col = column(batch, name)
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * limit / max(col.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


#: Edges that a task joins to trees at once.
FOREST = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Of edges, as few as join the same nodes: each node with the least that it leads to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["u", "v"])


def _forest(batches):
    held, n = [], 0
    for batch in batches:
        held.append((column(batch, "u").to_numpy(), column(batch, "v").to_numpy()))
        n += batch.num_rows
        if n >= FOREST:
            yield stars(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield stars(*map(np.concatenate, zip(*held)))


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges; component is the least node reached.

    Each task first cuts its edges to trees. Alternates large-star and small-star steps, each written to the shared folder,
    until the set of edges stops changing; null ends are left out.
    """
    now = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .mapInArrow(lean(_forest), "u long, v long")
        .distinct()
    )
    nodes = None

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(r)

    seen = mark(now)
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = scratch.save(small)
        scratch.drop(now)
        now, was, seen = new, seen, mark(new)
        if was == seen:
            break
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def tokenizer_path(path: str | None = None) -> str:
    return path or os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def grouped(batches, names: list[str]):
    """(key, batch) of each run of rows that have the same values of the named integer columns; a run may reach over batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([column(batch, x).to_numpy() for x in names])
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            k = tuple(keys[s].tolist())
            if k != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            key = k
            held.append(batch.slice(s, e - s))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Members of one component that are compared with each other at once.
BLOCK = 1500


def cells(pairs: DataFrame, scratch: Scratch, most: int = BLOCK) -> DataFrame:
    """(id, component, blocks) of every node of the pairs (a, b): large components fall into blocks of about so many nodes, by _block()."""
    groups = scratch.save(components(pairs, scratch).withColumnRenamed("node", "id"))
    sized = groups.groupBy("component").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / most).cast("int").alias("blocks")
    return scratch.save(groups.join(sized, "component").select("id", "component", blocks))


def _block(name: str) -> F.Column:
    return F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")


def verified(pairs: DataFrame, sets: DataFrame, where: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(sets, pairs) for each two blocks of a component, of the rows of sets (id, ...) and of pairs (a, b) that lie there.

    A set goes once to each block of its component instead of once to each of its pairs.
    """
    where = broadcast_if_small(where, where.count(), 32)
    lo, hi = F.least(_block("id"), "other"), F.greatest(_block("id"), "other")
    spread = sets.join(where, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("component", lo.alias("i"), hi.alias("j"), *sets.columns)
    placed = pairs.join(where.withColumnRenamed("id", "a"), "a")
    placed = placed.select(F.col("component").alias("component"), F.least(_block("a"), _block("b")).alias("i"), F.greatest(_block("a"), _block("b")).alias("j"), "a", "b")
    kinds = [part.split() for part in schema.split(", ")]
    none = pd.DataFrame({name: pd.Series(dtype={"long": "int64", "double": "float64"}[kind]) for name, kind in kinds})

    def guarded(key: tuple, own: pd.DataFrame, these: pd.DataFrame) -> pd.DataFrame:
        return run(own, these) if len(own) and len(these) else none

    keys = ["component", "i", "j"]
    return spread.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(guarded, schema)
