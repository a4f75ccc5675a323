"""Smaller views over the graph: orphans, cursors, call trees, condition cases, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .selection import smallest_values


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without the external placeholders that no edge refers to, at either end."""
    used = edges.select(F.col("target_id").alias("u")).unionByName(edges.select(F.col("source_id").alias("u")))
    kept = nodes.filter("kind = 'external'").join(used, F.col("id") == F.col("u"), "left_semi")
    return nodes.filter("kind <> 'external'").unionByName(kept)


def at_cursor(functions: DataFrame, path: str, line: int) -> DataFrame:
    """The function at a place: same start before containment, then the smallest range, then id."""
    inside = functions.filter((F.col("file_path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    return inside.orderBy(F.col("start_line") != line, F.col("end_line") - F.col("start_line"), "id").limit(1)


def boundary_functions(located: DataFrame) -> DataFrame:
    """Functions by their number of calls across the border of their module."""
    cross = located.filter(F.coalesce(F.col("target_module") != F.col("source_module"), F.lit(True)) & F.col("source_module").isNotNull())
    return cross.groupBy("source_module", "source_id").agg(F.count(F.lit(1)).alias("degree"))


def call_tree(calls: DataFrame, limit: int = 3) -> DataFrame:
    """Each function's first callees and callers, and how many there are."""
    out = smallest_values(calls.select(F.col("source_id").alias("id"), "related_id"), ["id"], "related_id", limit, "callees").withColumnRenamed("n", "n_out")
    into = smallest_values(calls.select(F.col("related_id").alias("id"), "source_id"), ["id"], "source_id", limit, "callers").withColumnRenamed("n", "n_in")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return out.join(into, "id", "full_outer").select("id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce(F.array_join("callees", ","), none).alias("callees"), F.coalesce("n_in", zero).alias("n_in"), F.coalesce(F.array_join("callers", ","), none).alias("callers"))


def direct_callees(calls: DataFrame, limit: int = 24) -> DataFrame:
    """A function's direct callees by number of callsites, self-calls left out, with what the limit omits."""
    per = calls.filter("source_id <> related_id").groupBy("source_id", "related_id").agg(F.count(F.lit(1)).alias("callsites"))
    own = Window.partitionBy("source_id")
    ranked = per.withColumns({"position": F.row_number().over(own.orderBy(F.desc("callsites"), "related_id")), "total": F.count(F.lit(1)).over(own)})
    return ranked.filter(F.col("position") <= limit).select("source_id", "related_id", "callsites", "position", F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted"))


#: Constraint operators on a value and a bound.
CONSTRAINTS = {
    "truthy": lambda v, b: v.isNotNull() & (v != 0),
    "falsy": lambda v, b: v.isNull() | (v == 0),
    "eq": lambda v, b: v.eqNullSafe(b),
    "ne": lambda v, b: ~v.eqNullSafe(b),
    "lt": lambda v, b: F.coalesce(v < b, F.lit(False)),
    "lte": lambda v, b: F.coalesce(v <= b, F.lit(False)),
    "gt": lambda v, b: F.coalesce(v > b, F.lit(False)),
    "gte": lambda v, b: F.coalesce(v >= b, F.lit(False)),
}


def constraint(operator: str, value: Column, bound: Column) -> Column:
    """F20."""
    return CONSTRAINTS[operator](value, bound)


def canonical(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows in order, the first of each key."""
    own = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def nearest_uses(blocks: DataFrame) -> DataFrame:
    """For every read, the nearest earlier access of the same binding in its function."""
    own = Window.partitionBy("function_id", "binding").orderBy("block_id")
    return blocks.withColumn("nearest", F.lag("block_id").over(own)).filter("access = 'read' AND nearest IS NOT NULL").select("function_id", "binding", F.col("block_id").alias("read"), "nearest")


# --- projections of a whole graph ------------------------------------------------------------------------------

# Kinds of nodes and edges of each mode; files are nodes of every mode, ``contains`` edges of all but the file mode.
VIEW_NODES = {"call": ("function", "method", "constructor"), "class": ("class", "interface", "enum", "method", "constructor", "property"), "file": ()}
VIEW_EDGES = {"call": ("calls", "contains"), "class": ("extends", "implements", "overrides", "instantiates", "contains"), "file": ("imports", "exports")}


def view_projection(nodes: DataFrame, edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a view of calls, classes or files; an edge needs both ends.  The file view has the external targets of its imports too."""
    shown = nodes.filter(F.col("kind").isin("file", *VIEW_NODES[mode]))
    kinds = edges.filter(F.col("kind").isin(*VIEW_EDGES[mode]))
    if mode == "file":
        own = shown.select(F.col("id").alias("s"))
        reached = kinds.join(own, F.col("source_id") == F.col("s"), "left_semi").select(F.col("target_id").alias("t")).distinct()
        shown = shown.unionByName(nodes.filter("kind = 'external'").join(reached, F.col("id") == F.col("t"), "left_semi"))
    return subgraph(shown, kinds)


def subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the edges with both ends among them."""
    ids = nodes.select(F.col("id").alias("n")).distinct()
    return nodes, edges.join(ids, F.col("source_id") == F.col("n"), "left_semi").join(ids, F.col("target_id") == F.col("n"), "left_semi")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The counters that a smaller graph has of its own, one row."""
    kinds = nodes.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "external").alias("externals"))
    return kinds.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def first_locations(rows: DataFrame, key: str) -> DataFrame:
    """(key, file_path, start_line, start_character): the first place of each key by path, then range; a missing range comes last."""
    place = F.struct("file_path", F.col("start_line").isNull().alias("missing"), "start_line", "start_character", "end_line", "end_character")
    return rows.groupBy(key).agg(F.min(place).alias("at")).select(key, "at.file_path", "at.start_line", "at.start_character")
