"""Work on many small groups, each whole in one row: one shuffle by key and no rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Rows of a group at most; what works by groups has another way for larger ones.
LARGEST = 5_000


def larger_groups(tables: list[DataFrame], key: str, most: int = LARGEST) -> DataFrame:
    """The keys that have more than ``most`` rows in one of the tables; counted by partial aggregation."""
    out = None
    for t in tables:
        big = t.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(key)
        out = big if out is None else out.unionByName(big)
    return out.distinct()


def by_group(key: str, tables: dict[str, DataFrame], work: Callable[..., Iterator[tuple]], schema: StructType) -> DataFrame:
    """``work(key, columns of the first table, columns of the next, ...)`` of every group of the first table.

    Columns come as lists, in the tables' order without the key, empty for a table without rows of the group.  ``schema`` is that of the
    rows that ``work`` yields.
    """
    joined, names = None, []
    for name, t in tables.items():
        columns = [c for c in t.columns if c != key]
        rows = t.groupBy(F.col(key).alias(key if joined is None else f"_{name}")).agg(F.collect_list(F.struct(*columns)).alias(name))
        flat = rows.select(rows.columns[0], *[F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in columns])
        joined = flat if joined is None else joined.join(flat, F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}")
        names.append([f"{name}_{c}" for c in columns])
    arrow = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [[batch[c].to_pylist() for c in columns] for columns in names]
            rows = [r for at, k in enumerate(batch[key].to_pylist()) for r in work(k, *[c[at] or [] for table in held for c in table])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=arrow).cast(wanted)

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    return joined.mapInArrow(run, schema)
