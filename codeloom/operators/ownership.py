"""Module ownership by longest path prefix, module relations and their rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import confidence_name, confidence_rank, path_key, path_prefixes
from .selection import smallest_values

#: Evidence rows kept for a relation.
REPRESENTATIVES = 5


def owners(files: DataFrame, boundaries: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Each distinct path with its nearest boundary; containment is by whole segments.

    The prefixes of a path are a handful of equi-join keys, so no range join is needed.
    """
    paths = files.select(F.col(path_col).alias("path")).filter("path <> ''").distinct()
    exploded = paths.select("path", F.inline(path_prefixes(path_key(F.col("path")))))
    roots = boundaries.select("root_key").distinct()
    return exploded.join(roots, F.col("root") == F.col("root_key")).groupBy("path").agg(F.max_by("root", "depth").alias("module"))


def owned(rows: DataFrame, owner: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Rows with the module of their path; null outside all boundaries."""
    return rows.join(owner, F.col(path_col) == F.col("path"), "left").drop("path")


def module_edges(nodes: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges with the modules of both ends."""
    homes = owned(nodes, owner).select("id", "module")
    source = homes.select(F.col("id").alias("s"), F.col("module").alias("source_module"))
    target = homes.select(F.col("id").alias("t"), F.col("module").alias("target_module"), F.lit(True).alias("known"))
    return edges.join(source, F.col("source_id") == F.col("s"), "left").join(target, F.col("target_id") == F.col("t"), "left").drop("s", "t")


def relations(located: DataFrame) -> DataFrame:
    """Cross-module relations with evidence count, confidence histogram, first evidence and what is omitted."""
    cross = located.filter("source_module IS NOT NULL AND target_module IS NOT NULL AND source_module <> target_module")
    # A repeated id counts once, by its smallest signature.
    signature = F.struct("kind", "source_module", "target_module", "start_line", "confidence")
    once = cross.groupBy("id").agg(F.min(signature).alias("s")).select("id", "s.*")
    names = ("exact", "resolved", "inferred", "unresolved")
    groups = ["source_module", "target_module", "kind"]
    counted = once.groupBy(*groups).agg(F.count(F.lit(1)).alias("evidence"), *[F.count_if(F.col("confidence") == c).alias(c) for c in names])
    first = smallest_values(once, groups, "id", REPRESENTATIVES, "first").drop("n")
    omitted = F.greatest(F.col("evidence") - REPRESENTATIVES, F.lit(0))
    return counted.join(first, groups).select(*counted.columns, F.array_join("first", ",").alias("representatives"), omitted.alias("omitted"))


# The kinds of relations that are counted inside a module.
INTERNAL_KINDS = ("calls", "imports", "exports", "routesTo", "usesModel", "renders", "injects", "extends", "configures")


def internal_counts(located: DataFrame, kinds: tuple[str, ...] = INTERNAL_KINDS) -> DataFrame:
    """Relations inside each module, a column for each kind."""
    inside = located.filter("source_module = target_module")
    return inside.groupBy(F.col("source_module").alias("module")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def coverage(located: DataFrame) -> DataFrame:
    """Cross, internal, external and unowned relations, one row."""
    external = F.col("target_module").isNull() & F.col("source_module").isNotNull()
    return located.agg(
        F.count_if(F.col("source_module") != F.col("target_module")).alias("cross_module"),
        F.count_if(F.col("source_module") == F.col("target_module")).alias("internal"),
        F.count_if(external).alias("external"),
        F.count_if(F.col("source_module").isNull()).alias("unowned"),
    )


def pair_totals(related: DataFrame) -> DataFrame:
    """All kinds of a pair together, with its strongest and weakest confidence."""
    return related.groupBy("source_module", "target_module").agg(F.sum("evidence").alias("evidence"), F.count(F.lit(1)).alias("kinds"), *[F.sum(c).alias(c) for c in ("exact", "resolved", "inferred", "unresolved")])


def rollup(nodes: DataFrame, owner: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Files and callables owned directly, and those of all descendant modules."""
    homes = owned(nodes.filter("file_path <> ''"), owner).filter("module IS NOT NULL")
    called = F.col("kind").isin("function", "method", "constructor")
    direct = homes.groupBy("module").agg(F.count_distinct("file_path").alias("files"), F.count_if(called).alias("callables"))
    roots = boundaries.select(F.col("root_key").alias("ancestor")).distinct()
    closure = boundaries.select(F.col("root_key").alias("module")).distinct().select("module", F.inline(path_prefixes(F.col("module")))).join(roots, F.col("root") == F.col("ancestor")).select("module", "ancestor")
    joined = closure.join(direct, "module", "left")
    zero = F.lit(0).cast("long")
    whole = joined.groupBy("ancestor").agg(F.coalesce(F.sum("files"), zero).alias("all_files"), F.coalesce(F.sum("callables"), zero).alias("all_callables"))
    return whole.join(direct, F.col("ancestor") == F.col("module"), "left").select(F.col("ancestor").alias("module"), F.coalesce("files", zero).alias("files"), F.coalesce("callables", zero).alias("callables"), "all_files", "all_callables")


def boundary_merge(boundaries: DataFrame, order: tuple[str, ...] = ("workspacePackage", "frameworkRoot", "sourceArea", "workspaceRoot")) -> DataFrame:
    """One boundary per root, by the best basis; all bases are kept."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("basis"))
    return boundaries.groupBy("root_key").agg(F.min_by("basis", rank).alias("basis"), F.array_join(F.array_sort(F.collect_set("basis")), ",").alias("bases"))


def merged_evidence(found: DataFrame) -> DataFrame:
    """One row per (root, ecosystem, name): strongest confidence, smallest path, all evidence once, sorted.

    ``found`` has root, ecosystem, name, confidence, path and evidence; evidence kinds are a fixed handful.
    """
    merged = found.groupBy("root", "ecosystem", "name").agg(F.min(confidence_rank(F.col("confidence"))).alias("rank"), F.min("path").alias("path"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"))
    return merged.select("root", "ecosystem", "name", confidence_name(F.col("rank")).alias("confidence"), "path", "evidence")


def preferred_roots(found: DataFrame) -> DataFrame:
    """Each framework's root to show: strongest confidence, then the shallowest path, then the smallest."""
    depth = F.size(F.filter(F.split("root", "/"), lambda x: x != ""))
    return found.groupBy("name").agg(F.min_by("root", F.struct(confidence_rank(F.col("confidence")), depth, F.col("root"))).alias("root"), F.count(F.lit(1)).alias("roots"))


# What a module's kind of boundary adds to its score.
BASIS_SCORES = {"workspacePackage": 10_000, "frameworkRoot": 8_000, "sourceArea": 6_000, "workspaceRoot": 4_000}


def module_scores(boundaries: DataFrame, rolled: DataFrame, located: DataFrame, units: DataFrame) -> DataFrame:
    """(module, score): basis, 100 an entry point, evidence in and out, callables of all descendants.

    ``boundaries`` has one basis for each root, ``units`` (module, kind).
    """
    cross = located.filter("source_module <> target_module")
    out = cross.groupBy(F.col("source_module").alias("o")).agg(F.count(F.lit(1)).alias("n_out"))
    into = cross.groupBy(F.col("target_module").alias("i")).agg(F.count(F.lit(1)).alias("n_in"))
    entry = units.filter(F.col("kind").isin("route", "operation")).groupBy(F.col("module").alias("e")).agg(F.count(F.lit(1)).alias("n_entry"))
    basis = F.lit(0)
    for name, value in BASIS_SCORES.items():
        basis = F.when(F.col("basis") == name, value).otherwise(basis)
    zero = F.lit(0).cast("long")
    joined = rolled.join(boundaries.select(F.col("root_key").alias("b"), basis.alias("base")), F.col("module") == F.col("b")).join(out, F.col("module") == F.col("o"), "left").join(into, F.col("module") == F.col("i"), "left").join(entry, F.col("module") == F.col("e"), "left")
    score = F.col("base") + F.coalesce("n_entry", zero) * 100 + F.coalesce("n_in", zero) + F.coalesce("n_out", zero) + F.col("all_callables")
    return joined.select("module", score.cast("long").alias("score"))


def drop_shadowed_parents(roots: DataFrame) -> DataFrame:
    """Roots that no other root lies below."""
    inner = roots.select(F.col("root_key").alias("child")).select("child", F.inline(path_prefixes(F.col("child")))).filter("root <> child").select(F.col("root").alias("parent")).distinct()
    return roots.join(inner, F.col("root_key") == F.col("parent"), "left_anti")


def ancestor_closed_top(modules: DataFrame, limit: int) -> DataFrame:
    """Modules by score, each only with its whole missing chain of ancestors, skipped if that exceeds the budget.

    A greedy choice that depends on all before it.  ``modules`` (module, parent, score) is one scene; the
    choice is made among its best rows, with the chains above them, and again among four times as many
    while the budget is not full and rows are left.
    """

    def choose(pdf):
        parent = dict(zip(pdf["module"], pdf["parent"], strict=True))
        chosen: list[str] = []
        for module in pdf[pdf["ranked"]].sort_values(["score", "module"], ascending=[False, True])["module"]:
            chain, at = [], module
            while at is not None and at in parent and at not in chosen:
                chain.append(at)
                at = parent[at]
            if chain and len(chosen) + len(chain) <= limit:
                chosen += reversed(chain)
        out = pdf[pdf["module"].isin(chosen)].copy()
        out["position"] = [chosen.index(m) + 1 for m in out["module"]]
        return out[["module", "position"]]

    total, size = modules.count(), limit * 4
    while True:
        best = modules.orderBy(F.desc("score"), "module").limit(size).select("module")
        chains = best.select("module", F.inline(path_prefixes(F.col("module")))).groupBy(F.col("root").alias("module")).agg(F.max(F.col("root") == F.col("module")).alias("ranked"))
        rows = modules.join(chains, "module")
        chosen = rows.withColumn("scene", F.lit(1)).groupBy("scene").applyInPandas(choose, "module string, position int")
        if size >= total or chosen.count() >= limit:
            return chosen
        size *= 4


def confidence_window(edges: DataFrame) -> DataFrame:
    """Best target per source by confidence; ties at the best rank are ambiguous."""
    own = Window.partitionBy("source_id").orderBy(confidence_rank(F.col("confidence")))
    best = edges.withColumn("r", F.rank().over(own)).filter("r = 1")
    return best.groupBy("source_id").agg(F.count_distinct("target_id").alias("candidates"), F.min("target_id").alias("target_id"), F.min("confidence").alias("confidence")).withColumn("ambiguous", F.col("candidates") > 1)
