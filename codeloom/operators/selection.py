"""Bounded, deterministic selections with exact counts of what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import kept

#: Kinds of edges by relation mode; ``boundary`` takes all.
EXECUTION = ("calls", "routesTo", "usesModel", "renders", "injects", "configures")
DEPENDENCY = ("imports", "exports", "extends")


def relation_mode(kind: Column, mode: str) -> Column:
    """P11."""
    sets = {"execution": EXECUTION, "dependency": DEPENDENCY}
    return kind.isin(*sets[mode]) if mode in sets else F.lit(True)


def top_per_group(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of every group; Spark cuts groups before the shuffle."""
    own = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= limit).drop("_n")


def running_total(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over all rows up to each in a total order.

    The rows are sorted into ranges; a window runs inside each range, and only the ranges' sums, one row each,
    are added up in one place.
    """
    ranges = kept(rows.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_value": value}))
    sums = ranges.groupBy(F.col("_range").alias("_r")).agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = ranges.withColumn("_own", own).join(F.broadcast(sums.select("_r", F.coalesce(before, F.lit(0)).alias("_before"))), F.col("_range") == F.col("_r"))
    return joined.select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def retained_scene(expansions: DataFrame, most: int = 500) -> DataFrame:
    """(scene, expansion, nodes): the latest expansions of each scene whose nodes together fit the budget.

    ``expansions`` has scene, expansion, seen_at and nodes; the newest stays even where it alone is over.
    """
    own = Window.partitionBy("scene").orderBy(F.desc("seen_at"), "expansion")
    total = F.sum("nodes").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return expansions.withColumns({"_n": F.row_number().over(own), "_total": total}).filter((F.col("_n") == 1) | (F.col("_total") <= most)).select("scene", "expansion", "nodes")


def smallest_values(rows: DataFrame, groups: list[str], value: str, limit: int, name: str) -> DataFrame:
    """(groups, name, n): each group's smallest distinct values, ``limit`` at most, and how many there are.

    Values are numbered before they are gathered, so no row holds more than ``limit`` of them.
    """
    distinct = rows.select(*groups, value).filter(F.col(value).isNotNull()).distinct()
    own = Window.partitionBy(*groups).orderBy(value)
    first = distinct.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= limit).groupBy(*groups).agg(F.array_sort(F.collect_list(value)).alias(name))
    counts = distinct.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(first, groups)


def one_per_category(rows: DataFrame, limit: int) -> DataFrame:
    """The best row of every category first, the rest by rank.  ``rows`` has id, category and score."""
    own = Window.partitionBy("category").orderBy(F.desc("score"), "id")
    numbered = rows.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= limit)
    return numbered.orderBy(F.when(F.col("_n") == 1, 0).otherwise(1), F.desc("score"), "category", "id").limit(limit).drop("_n")


def catalog(rows: DataFrame, text: str, limit: int = 24, most: int = 50) -> DataFrame:
    """K9: literal substring search over the names, with the exact number left out."""
    limit = max(0, min(limit, most))
    found = rows.filter(F.contains(F.lower("name"), F.lit(text.strip().lower())))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy("framework", "name", "id").limit(limit)
    return page.crossJoin(F.broadcast(total)).select(*rows.columns, F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted"))


def bounded_labels(labels: Column, limit: int, total: Column | None = None) -> Column:
    """The first labels, the last replaced by how many more there are; of ``total``, where ``labels`` has only the first."""
    total = F.size(labels) if total is None else total
    more = F.concat((total - (limit - 1)).cast("string"), F.lit(" additional"))
    return F.when(total > limit, F.concat(F.slice(labels, 1, limit - 1), F.array(more))).otherwise(labels)


def boundary_edges(containment: DataFrame, concrete: DataFrame, limit: int) -> DataFrame:
    """Edges of an expanded module: all of containment first, then calls, each by evidence and id."""
    both = containment.withColumn("_p", F.lit(0)).unionByName(concrete.withColumn("_p", F.lit(1)))
    return both.orderBy("_p", F.desc("evidence"), "id").limit(limit).drop("_p")


def clamp_limit(value: float | int | None, default: int, most: int) -> int:
    """A finite whole number from 0 to ``most``."""
    try:
        number = int(value) if value is not None and value == value and abs(value) != float("inf") else default
    except (TypeError, ValueError):
        number = default
    return max(0, min(number, most))
