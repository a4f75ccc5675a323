"""What several corpus operators share: table access, lineage cuts, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Bytes of an Arrow batch between Spark and Python at most, unless the session says less.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes: rows may be whole texts, and each task holds a few batches off the heap."""
    if int(str(spark.conf.get(_BATCH, str(1 << 30))).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where that is unset, on one machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    return sc.getCheckpointDir()


def few_parts(df: DataFrame) -> DataFrame:
    """The rows of a narrow table in fewer files: four for each core, or a quarter of the session's shuffle partitions if that is more."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of a narrow table (ids, counts, digests), computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return few_parts(df).checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """As :func:`checkpointed`, but as Parquet: compressed, and later readers take only the columns they need."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def id_bitmap(wanted: DataFrame, id_col: str) -> tuple[Column, Broadcast]:
    """(place of an identifier, broadcast bitmap): all identifiers of ``wanted`` are in it, and about one of 16 others, more beyond 2**24 of them; 32 MB at most."""
    spark = wanted.sparkSession
    bits = min(28, max(15, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << bits))
    rows = wanted.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bits")).collect()
    table = np.zeros((1 << bits) // 8 + 4096, dtype=np.uint8)
    for r in rows:
        table[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return place, spark.sparkContext.broadcast(table)


def maybe_in(table: np.ndarray, places: pa.Array) -> pa.Array:
    """Whether the bitmap has each place."""
    p = places.to_numpy(zero_copy_only=False)
    return pa.array((table[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))


def left_join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot_share: int = 2000) -> DataFrame:
    """``rows`` left-joined with one ``groups`` row per ``key``, safe for a key that most rows have.

    ``size`` is the number of rows of each group.  Groups of at least ``total / hot_share`` rows, of
    which there are ``hot_share`` at most, are broadcast; their rows are dealt by a random-like salt
    instead of the key, so that no task gets a hot group.
    """
    extra = [c for c in groups.columns if c != key]
    hot_at = max(1, total // hot_share)
    hot = groups.filter(F.col(size) >= hot_at).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in extra], F.lit(True).alias("_hot"))
    cold = groups.filter(F.col(size) < hot_at).select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in extra])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt = F.concat(F.lit("\x00hot"), F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != key][:1], F.lit(7)), F.lit(100_003)).cast("string"))
    spread = marked.withColumn("_deal", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(F.col(key).cast("string")))
    joined = spread.join(cold.withColumn("_deal2", F.col("_cold_key").cast("string")), F.col("_deal") == F.col("_deal2"), "left")
    return joined.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in extra])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
