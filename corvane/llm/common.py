"""Pieces shared by the operators of this subpackage: shared scratch tables, row numbers, connected components."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts here, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"


#: Bytes of an Arrow batch between the JVM and a Python worker; both hold copies of it, beside the heap.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, its Arrow batches bounded to BATCH_BYTES (a lower bound of its own stays)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` of a data folder."""
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session in spark.checkpoint.dir. Where it is unset, a local session gets a folder of its
    own; on a cluster, whose machines would each write to their own disk, that is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = os.path.join(tempfile.gettempdir(), "corvane-checkpoints")
    context.setCheckpointDir(base)
    return base


_written: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = bounded(df.sparkSession)
    path = f"{checkpoint_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables whose successors are stored. Each must be what `stored` returned."""
    for df in tables:
        _delete(df.sparkSession, df._corvane_path)


def _delete(spark: SparkSession, name: str) -> None:
    _written.discard(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Deletes the scratch tables that this process wrote. Results that still read them must be written before."""
    spark = SparkSession.getActiveSession()
    try:
        while spark is not None and _written:
            _delete(spark, next(iter(_written)))
    except Exception:  # the JVM may be gone at exit; the folder is then left to the cluster's own clean-up
        _written.clear()


def lean(run: Callable) -> Callable:
    """A batch function after which its worker, which Spark keeps for later tasks, gives freed memory back to the system."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return lean_run


def numbered(df: DataFrame, *order: str, name: str = "row_no") -> tuple[DataFrame, int]:
    """Rows with gapless numbers from 0 in the order of `order`, and their count.

    A range shuffle and a sort within partitions, stored with their places so that the numbers can't move when an executor
    is lost; only one count per partition comes to the driver. A trailing tie-breaker spreads rows that are equal in all of
    `order`; as such rows are equal in every column used, any order among them gives the same result.
    """
    spark = df.sparkSession
    low = (1 << 33) - 1
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    s = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    s = stored(s.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(low))), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in s.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    total, offsets = 0, []
    for part, n in counts:
        offsets.append((part, total))
        total += n
    base = spark.createDataFrame(offsets, "_part int, _base long")
    # One row per partition of the shuffle: bounded by spark.sql.shuffle.partitions whatever the size of the data.
    out = s.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
    return out, total


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id of each one's component) of a list of edges: least labels over edges, then pointers of pointers."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if parts:
        ids, roots = roots_of(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["id", "component_id"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_local: int = 1_000_000) -> DataFrame:
    """(id, component_id) of every id in an edge: the smallest id reachable. `edges` should be stored: it is read twice.

    Alternating large and small stars on DataFrames: each round joins every edge with the least neighbour of its end, so
    no component is ever gathered in one task; rounds are written to the shared folder until the edge set stands still.
    From the round on in which at most `max_local` edges are left (counted, 16 bytes each), one task joins those at once.
    """
    now = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was, before = mark(now), None
    while was[0]:
        if was[0] <= max_local:
            return now.coalesce(1).mapInArrow(lean(_joined), "id long, component_id long")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        paired = large.join(least, "u")
        small = paired.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(paired.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "edges")
        if before is not None:
            discard(before)
        before = now
        if (is_ := mark(now)) == was:
            break
        was = is_
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
