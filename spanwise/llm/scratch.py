"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import ship  # noqa: F401
from .wordhash import mix


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a local one is set only where none is configured."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanwise-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Spark's setting by which the shuffle files of an execution go when it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the files instead of recomputing
    what came before, and later jobs prune the columns that they do not need.
    The shuffle files that this took are not read again, and are removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables that `materialize` wrote, once what was made of them is itself a table."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one id each, 8 bytes or so, up to which a materialised table is broadcast.
BROADCAST_IDS = 1_000_000


def broadcast_if_small(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """`ids` with a broadcast hint if it is counted to have at most `most` rows; beyond that Spark shuffles both sides."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def frequent_values(df: DataFrame, column: str, most: int, tracked: int, groups: int = 64) -> DataFrame:
    """At most `most` values of `column` with upper bounds of their counts: columns item and count.

    Misra-Gries summaries with `tracked` counters, made in each task, merged in `groups` groups of
    tasks and then to one: any value that fills over 1 / (0.75 * tracked) of the rows is among them.
    """
    kind = dict(df.dtypes)[column]
    # a null, which is not counted, so that there is a summary to merge when there are no rows
    rows = df.select(column).union(df.sparkSession.range(1).select(F.lit(None).cast(kind)))
    summed = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("part")).agg(F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("summary"))
    # in one partition, as merging fails on an empty one; there are `groups` rows at most
    merged = summed.repartition(1).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {most})")).alias("x"))
    return top.select("x.item", "x.count")


#: Values that a membership bitmap takes at most, bits for each (in all at most 2^29, 64 MB), and bits set for each.
MOST, ROOM, HASHES = 1 << 26, 8, 2


class Bitmap:
    """Which 64-bit values may be in a set, with ROOM bits for each: never wrong about one that is."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(values: np.ndarray, bits: int) -> list[np.ndarray]:
        h = mix(values.view(np.uint64))
        return [(h >> np.uint64(32 * k)) & np.uint64(bits - 1) for k in range(HASHES)]

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for at in self.places(values, 64 * len(self.words)):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    @classmethod
    def of(cls, df: DataFrame, column: str, most: int = MOST) -> Bitmap | None:
        """Sized by a count of the rows and made by an aggregation; none for more than `most` rows, where Spark joins instead."""
        count = df.count()
        if count > most:
            return None
        bits = 1 << max(16, (ROOM * count - 1).bit_length())

        def run(batches):
            import pyarrow as pa

            words = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                for at in cls.places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            held = np.flatnonzero(words)
            for a in range(0, len(held), 1 << 16):
                part = held[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].view(np.int64))], names=["at", "word"])

        parts = ship(df).select(F.col(column).cast("long")).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[parts.column(0).to_numpy()] = parts.column(1).to_numpy().view(np.uint64)
        return cls(words)
