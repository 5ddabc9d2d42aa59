"""Cutting lineage between the rounds of an iteration, and blocks of two tables that all meet."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The shared checkpoint folder; in local mode alone, a temporary one is made where none is set. On a cluster executors wouldn't see it."""
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='spark-rounds-')}")
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read from there."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(d: DataFrame, group: str, order: str, name: str = "n") -> DataFrame:
    """Each row's place, from 0, in its group by ``order``, which is unique in it. Null groups are one group.

    A group of any size is shared among tasks: rows are dealt by ranges of (group, order) and written once, so that ranges can't move between the two
    readings; a row's place is that in its range, and what its group has in the ranges before.
    """
    ranges = stored(d.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranges.groupBy("_range", group).agg(F.count("*").alias("_count"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_of"), F.col(group).alias("_group"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range", group).orderBy(order)) - 1
    met = ranges.withColumn(name, own).join(starts, (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_of", "_group", "_start")


def block_pairs(a: DataFrame, b: DataFrame, per_block: tuple[int, int], f, schema: str) -> DataFrame:
    """``f`` (an Arrow function of two tables) on every pair of a block of ``a`` and one of ``b``. Each side is shuffled once, dealt in turn into blocks of about ``per_block``
    rows; a task reads one block of each side from there. No side is copied for the other's blocks, and nothing passes through the driver."""
    n, m = (max(1, -(-d.count() // size)) for d, size in zip((a, b), per_block, strict=True))
    met = a.repartition(n).mapInArrow(_packed("left"), "left binary").join(b.repartition(m).mapInArrow(_packed("right"), "right binary").hint("shuffle_replicate_nl"))

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                found = f(*(pa.ipc.open_stream(v.as_buffer()).read_all() for v in (x, y)))
                yield from found.combine_chunks().to_batches(max_chunksize=10_000)

    return met.mapInArrow(run, schema)


def _packed(name: str):
    """A partition's rows as one, an Arrow stream; an empty partition has none."""

    def pack(batches):
        t = [b for b in batches if b.num_rows]
        if t:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, t[0].schema) as writer:
                for b in t:
                    writer.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=[name])

    return pack
