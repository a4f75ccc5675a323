"""Exact dedup by content sort (operator 6).

Sampled splitters range-partition the rows on a short order key of the normalised text,
Spark's external sort puts equal texts next to each other inside a partition, and a single
pass over each sorted partition compares neighbours in full.

The order key is (first bytes, 64-bit hash) of the normalised text, then the identifier.  The
identifier lets a group of equal texts span several range partitions, so a text that a third of
all rows share is no task's burden.  Runs that touch a partition edge are then stitched: there
are about two for each partition, so their summary is broadcast.

Defined results: a null text is an empty text; null identifiers order after all others and can
be a ``keep_id``; repeated rows are rows like any other, and exactly one row of a group is kept
(among rows equal in identifier and text, one of them); an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed

#: Characters that normalisation deletes.
DELETED = b"\x20\x09\x0a\x0b\x0c\x0d"
_SQL_DELETED = "[\\x20\\x09-\\x0D]"

_RUN_SCHEMA = "id long, text_sha256 string, size long, best_id long, best_chars long, head boolean, edge boolean"
_ARROW = pa.schema([("id", pa.int64()), ("text_sha256", pa.string()), ("size", pa.int64()), ("best_id", pa.int64()), ("best_chars", pa.int64()), ("head", pa.bool_()), ("edge", pa.bool_())])


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal normalised texts in one sorted partition.

    Rows come ordered by key, then longest original, then identifier.  ``runs`` holds the runs of
    the current key: one, but for a hash collision.  Each maps a text to [digest, best row, ids].
    """
    out: list[tuple] = []
    key, runs, first_key = None, {}, True

    def close(edge: bool) -> None:
        for digest, chars, ids in runs.values():
            size, best = len(ids), ids[0]
            out.extend((i, digest, size, best, chars, n == 0, edge) for n, i in enumerate(ids))
        runs.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(_ARROW)
        out.clear()
        return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        for k, i, chars, text in zip(batch["key"], batch["id"], batch["chars"], batch["text"], strict=True):
            k = k.as_py()
            if k != key:
                if key is not None:
                    close(edge=first_key)
                    first_key = False
                key = k
                if len(out) >= 8192:
                    yield flush()
            norm = text.as_buffer().to_pybytes().translate(None, DELETED)
            run = runs.get(norm)
            if run is None:
                runs[norm] = [hashlib.sha256(norm).hexdigest(), chars.as_py(), [i.as_py()]]
            else:
                run[2].append(i.as_py())
    close(edge=True)
    yield flush()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its group's keeper, the group's size and whether it is the keeper.

    Texts are equal when identical after deleting white space.  The row with the most code points
    stays, then the smallest identifier.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    norm = F.regexp_replace("text", _SQL_DELETED, "")
    rows = rows.select("id", "text", F.length("text").alias("chars"), norm.alias("norm"))
    rows = rows.select("id", F.col("text").cast("binary").alias("text"), "chars", F.concat(F.substring(F.col("norm").cast("binary"), 1, 16), F.unhex(F.lpad(F.hex(F.xxhash64("norm")), 16, "0"))).alias("key"))
    ordered = rows.repartitionByRange("key", "id").sortWithinPartitions("key", F.desc("chars"), F.asc_nulls_last("id"))
    runs = checkpointed(ordered.select("key", "id", "chars", "text").mapInArrow(_compare_neighbours, _RUN_SCHEMA))
    best = F.min(F.struct((-F.col("best_chars")).alias("c"), F.col("best_id").isNull().alias("n"), F.col("best_id").alias("i")))
    stitched = runs.filter("edge AND head").groupBy("text_sha256").agg(F.sum("size").alias("all_size"), best.alias("best")).select(F.col("text_sha256").alias("edge_sha"), "all_size", "best", F.lit(True).alias("met"))
    joined = runs.join(F.broadcast(stitched), F.col("edge") & (F.col("text_sha256") == F.col("edge_sha")), "left")
    keep = F.when(F.col("met"), F.col("best.i")).otherwise(F.col("best_id"))
    return joined.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("head") & F.col("id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns stay as they are, whatever their names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"), F.sha2(F.regexp_replace(text, _SQL_DELETED, ""), 256).alias("sha"), F.length(text).alias("chars"))
    dropped = exact_dedup(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("drop_id"), F.col("text_sha256").alias("drop_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("repeat"))
    same = F.col("own").eqNullSafe(F.col("drop_id")) & (F.col("sha") == F.col("drop_sha"))
    kept = packed.join(dropped.filter("NOT repeat"), same, "left_anti")
    # A row that repeats its keeper, identifier and all, goes by number instead of by name.
    repeats = dropped.filter("repeat").select("drop_id", "drop_sha").distinct()
    if repeats.isEmpty():
        return kept.select("row.*")
    both = kept.join(repeats, same, "left")
    order = Window.partitionBy("own", "sha").orderBy(F.desc("chars"), F.monotonically_increasing_id())
    one = both.filter("drop_sha IS NOT NULL").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return both.filter("drop_sha IS NULL").select("row").unionByName(one.select("row")).select("row.*")
