"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, wherever words are counted or compared: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges that a task joins at once; rows up to which a table of ids, and one of pairs, is broadcast.
EDGES_PER_TASK, BROADCAST_ROWS, BROADCAST_PAIRS = 500_000, 1_000_000, 300_000
#: Texts that are held against one text in one block.
BLOCK = 1_000
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandbook-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, held as files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame, rows_per_task: int) -> tuple[DataFrame, int]:
    """``df`` checkpointed, in no more partitions than its rows need, and its number of rows."""
    held = checkpointed(df)
    n = held.count()
    return held.coalesce(max(1, -(-n // rows_per_task))), n


def either_way(small: DataFrame) -> DataFrame:
    """Broadcast if it has been counted to be small enough, else shuffled."""
    return F.broadcast(small) if small_enough(small, BROADCAST_ROWS) else small


def meetings(pairs: DataFrame, n: int, texts: DataFrame, width: int) -> DataFrame:
    """Brings the texts of ``n`` pairs (hub, member, and more columns) together: each hub's in front of its members'.

    ``texts`` has key and text, one row a key. Each member's text travels once a
    pair, the hub's once for each block of about BLOCK members, so that no hub's
    members must lie in one task. Rows (hub, block, member, text, more) are sorted
    by hub and block; the hub's own row comes first and has a null member. Where
    pairs have more columns, these come in a row without text before the member's.
    """
    more = [c for c in pairs.columns if c not in ("hub", "member")]
    dealt = pairs.withColumn("block", F.lit(0))
    if n > BLOCK:  # else no hub can have more members than a block
        crowded = pairs.groupBy("hub").count().filter(F.col("count") > BLOCK).select("hub", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        crowded = checkpointed(crowded).coalesce(1)
        dealt = pairs.join(either_way(crowded), "hub", "left").withColumn("block", F.pmod(F.xxhash64("member"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
        dealt, _ = sized(dealt, 100_000)
    ids = dealt.select("hub", "block", F.col("member").alias("key"))
    hubs = dealt.select("hub", "block").distinct()
    if n <= BROADCAST_PAIRS:  # then pairs go to the texts
        hubs, ids = F.broadcast(hubs), F.broadcast(ids)
    else:
        wanted = checkpointed(ids.select("key").unionByName(ids.select(F.col("hub").alias("key"))).distinct())
        texts = texts.join(either_way(wanted), "key", "left_semi").select("key", "text")
    none = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in more]
    met = texts.join(ids, "key").select("hub", "block", F.col("key").alias("member"), "text", *none)
    met = met.unionByName(texts.join(hubs.withColumnRenamed("hub", "key"), "key").select(F.col("key").alias("hub"), "block", F.lit(None).cast("long").alias("member"), "text", *none))
    if more:
        met = met.unionByName(dealt.select("hub", "block", "member", F.lit(None).cast(texts.schema["text"].dataType).alias("text"), *more))
    least = max(1, min(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 200))
    return met.repartition(max(width, least), "hub", "block").sortWithinPartitions("hub", "block", F.col("member").asc_nulls_first(), F.col("text").isNotNull())


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a checkpoint for many narrow rows, which compress well there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow(), which gives memory back to the system at a task's end, as Python workers outlive their tasks and share an executor's memory."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return out


def shuffle_width(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Tasks for a shuffle of about ``rows`` rows: the session's number, or more where tasks would get too many."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it must to tell."""
    return df.limit(most + 1).count() <= most


def hashed_unit(*parts: Column) -> Column:
    """A long in [0, 2**60) that depends on the parts alone (md5), so DuckDB can compute it too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def prefix_sums(df: DataFrame, order: list[str], value: str, width: int | None = None) -> DataFrame:
    """Adds ``before`` (sum of ``value`` in all earlier rows) and ``position`` (from 0) in the global order.

    The rows are range-partitioned and sorted; each partition's total and row
    count go into one small table with a row for each partition, whose running
    sums are each partition's offset. No task sees more than its own range, and
    rows with equal order keys may lie in any order between themselves. The
    ranged rows are checkpointed, as a recomputed range shuffle could cut elsewhere.
    """
    width = width or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()))
    offsets = ranged.groupBy("part").agg(F.sum(value).alias("part_sum"), F.count("*").alias("part_rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = offsets.select(
        "part",
        F.coalesce(F.sum("part_sum").over(ahead), F.lit(0)).alias("sum_ahead"),
        F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias("rows_ahead"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    return (
        ranged.withColumn("position", F.row_number().over(inside).cast("long") - 1)
        .withColumn("before", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(offsets), "part")  # at most ``width`` rows
        .withColumn("position", F.col("position") + F.col("rows_ahead"))
        .withColumn("before", F.col("before") + F.col("sum_ahead"))
        .drop("part", "sum_ahead", "rows_ahead")
    )


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges a[i] - b[i], and the smallest node that each one reaches over them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while not (root[a] == root[b]).all():
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not (root[root] == root).all():
            root = root[root]
    return nodes, nodes[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, as one edge (node, smallest node that it reaches) for each node."""
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        nodes, roots = local_roots(t.column("src").to_numpy(), t.column("dst").to_numpy())
        apart = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], ["src", "dst"])


def connected_components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``node``, ``component`` (smallest node that links reach) for every node of ``edges`` (src, dst longs).

    Each task first joins its own share of the edges, at most about ``per_task``
    of them, and keeps one for each node. If that leaves several tasks' worth,
    large-star and small-star steps follow, which hang a node's neighbours under
    the smallest one it knows, so that chains shrink by halves and edges never
    multiply; and so on until the edges no longer change.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def with_least(e: DataFrame) -> DataFrame:
        least = e.groupBy("src").agg(F.min("dst").alias("least"))
        return e.join(least.select("src", F.least("src", "least").alias("least")), "src")

    def print_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now, n = sized(edges.filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), per_task)
    seen = None
    while n:
        now = now.mapInArrow(_forest, "src long, dst long")
        if n <= per_task:
            break
        now, n = sized(now, per_task)
        step = with_least(both(now)).filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
        small = with_least(step)
        small = small.select("src", F.col("least").alias("dst")).unionByName(small.filter("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst")))
        now, n = sized(small.filter("src != dst").distinct(), per_task)
        was, seen = seen, print_of(now)
        if was == seen:
            break
    roots = now.groupBy("src").agg(F.min("dst").alias("component")).withColumnRenamed("src", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, as ``--py-files`` would, once for each application.

    Where the session leaves the size of Arrow batches at Spark's 64 MB, it is set
    to 8 MB, as texts are long and a worker holds a batch besides what it makes of it.
    """
    if spark.conf.get(ARROW_BYTES, "64m").lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(ARROW_BYTES, "8m")
    context = spark.sparkContext
    if getattr(context, "_strandbook_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="strandbook-py-"))
    archive = folder / "strandbook_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._strandbook_shipped = True
