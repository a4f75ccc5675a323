"""Streams of source snapshots and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_snapshots(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Snapshots without those seen before: one row per path and content hash inside the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path", "content_hash"])


def activity(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and type, late rows up to the delay included."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed after a gap without events."""
    counted = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def upsert_graph(batch: DataFrame, _epoch: int, path: str, key: str = "id") -> None:
    """For ``foreachBatch``: the latest row of each key of a batch, under a folder of the batch's own.

    Writing a batch again replaces its folder, so a retried batch changes nothing.
    """
    from ..operators.index import last_wins

    last_wins(batch, key, "ordinal").write.mode("overwrite").parquet(f"{path}/batch={_epoch}")


# --- the newest snapshot of every path, in keyed state -------------------------------------------------------

_CHANGE = "path string, version long, content_hash string, retired_version long, retired_hash string"
_STATE = "version long, content_hash string"


def newest(snapshots: DataFrame) -> DataFrame:
    """(path, version, content_hash): the newest snapshot of each path of a table; of one version the greatest hash."""
    best = snapshots.groupBy("path").agg(F.max(F.struct("version", "content_hash")).alias("s"))
    return best.select("path", "s.version", "s.content_hash")


def snapshot_changes(stream: DataFrame) -> DataFrame:
    """A row (path, version, content_hash, retired_version, retired_hash) whenever a batch brings a newer snapshot of a path.

    The state of a path is its newest version and hash, so late, repeated and out-of-order snapshots change nothing.
    ``stream`` has path, version and content_hash; only the newest of a batch reaches the state, by a partial aggregation.
    Output mode is update.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (None, None)
        best = old
        for pdf in parts:
            for version, content in zip(pdf["version"], pdf["content_hash"], strict=True):
                if best[0] is None or (version, content) > best:
                    best = (int(version), content)
        if best != old:
            state.update(best)
            yield pd.DataFrame({"path": [key[0]], "version": [best[0]], "content_hash": [best[1]], "retired_version": pd.array([old[0]], dtype="Int64"), "retired_hash": [old[1]]})

    return stream.select("path", "version", "content_hash").groupBy("path").applyInPandasWithState(step, _CHANGE, _STATE, "update", GroupStateTimeout.NoTimeout)


def merge_changes(batch: DataFrame, epoch: int, path: str) -> None:
    """For ``foreachBatch``: a batch's changes, in a folder of its own, which a repeated batch replaces."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshots after all merged batches; a version that a later batch has retired does not show."""
    return newest(spark.read.schema(_CHANGE).parquet(f"{path}/batch=*"))


def follow_snapshots(stream: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keeps ``current`` up to date with a stream of snapshots; ``trigger`` as for a writer, all there is and then an end by default."""
    merge_changes(stream.sparkSession.createDataFrame([], _CHANGE), -1, path)  # so that there is a table before the first batch
    writer = snapshot_changes(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, epoch: merge_changes(batch, epoch, path)).start()
