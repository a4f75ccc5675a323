"""Function index: callables, their call relations, counters, roles, tags, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import CALLABLE_KINDS, confidence_rank


def callables(nodes: DataFrame) -> DataFrame:
    """Nodes that can be called."""
    return nodes.filter(F.col("kind").isin(*CALLABLE_KINDS))


def resolved_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Call edges with their target, and whether the call is unresolved or external.

    An unresolved confidence overrides an existing target.
    """
    target = nodes.select(F.col("id").alias("node_id"), F.col("kind").alias("target_kind"), F.col("name").alias("target_name"))
    calls = edges.filter(F.col("kind") == "calls").join(target, F.col("target_id") == F.col("node_id"), "left")
    unresolved = (F.col("confidence") == "unresolved") | F.col("node_id").isNull()
    external = ~unresolved & (F.col("target_kind") == "external")
    related = F.when(unresolved, F.concat(F.lit("unresolved:"), F.coalesce("target_id", "id"))).otherwise(F.col("target_id"))
    return calls.withColumns({"is_unresolved": unresolved, "is_external": external, "related_id": related})


def call_relations(calls: DataFrame) -> DataFrame:
    """A1: parallel call edges collapsed per (source, related)."""
    return calls.groupBy("source_id", "related_id").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.array_sort(F.collect_list("id")).alias("edge_ids"),
        F.array_sort(F.collect_set("confidence")).alias("confidences"),
    )


def fan(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """A2: distinct callers and callees of every callable, and its unresolved and external calls per edge."""
    out = calls.groupBy(F.col("source_id").alias("out_id")).agg(F.count_distinct("related_id").alias("callees"), F.count_if("is_unresolved").alias("unresolved_calls"), F.count_if("is_external").alias("external_calls"))
    into = calls.groupBy(F.col("related_id").alias("in_id")).agg(F.count_distinct("source_id").alias("callers"))
    zero = F.lit(0).cast("long")
    joined = callables(nodes).join(out, F.col("id") == F.col("out_id"), "left").join(into, F.col("id") == F.col("in_id"), "left")
    counts = ["callers", "callees", "unresolved_calls", "external_calls"]
    return joined.select("id", "kind", "name", "file_path", "start_line", *[F.coalesce(c, zero).alias(c) for c in counts])


def role(kind: Column, callers: Column, callees: Column, unresolved: Column | None = None) -> Column:
    """External, unresolved, entrypoint (called by none, calls some), utility (several callers) or unknown."""
    flag = F.lit(False) if unresolved is None else unresolved
    return F.when(flag, "unresolved").when(kind == "external", "external").when((callers == 0) & (callees > 0), "entrypoint").when(callers > 1, "utility").otherwise("unknown")


def tags(external_calls: Column, unresolved_calls: Column, callers: Column, callees: Column) -> Column:
    """Tags in their fixed order."""
    return F.array_compact(
        F.array(
            F.when(external_calls > 0, "externalCall"),
            F.when(unresolved_calls > 0, "unresolvedCall"),
            F.when(callees == 0, "leaf"),
            F.when(callers > 1, "sharedUtility"),
        )
    )


def described(fanned: DataFrame) -> DataFrame:
    return fanned.select("*", role(F.col("kind"), F.col("callers"), F.col("callees")).alias("role"), tags(F.col("external_calls"), F.col("unresolved_calls"), F.col("callers"), F.col("callees")).alias("tags"))


def missing_label(call_name: Column, call_expression: Column, target_id: Column) -> Column:
    """P5: what a call without a target is called: its name, else its expression, else the target's id."""
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(told(call_name), told(call_expression), F.nullif(target_id, F.lit("")), F.lit("unresolved call"))


def records(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """One record per callable, external target and missing target: (id, kind, name, qualified_name, role, confidence).

    Empty texts count as missing.  ``calls`` comes from :func:`resolved_calls`, with call_name and call_expression.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    own = callables(nodes).select("id", "kind", "name", F.coalesce(some("qualified_name"), F.col("name")).alias("qualified_name"), F.lit("unknown").alias("role"), F.lit("exact").alias("confidence"))
    used = calls.filter("is_external").select(F.col("related_id").alias("u")).distinct()
    outside = nodes.join(used, F.col("id") == F.col("u"), "left_semi").select(
        "id",
        F.lit("external").alias("kind"),
        F.coalesce(some("name"), some("qualified_name"), F.lit("external")).alias("name"),
        F.coalesce(some("qualified_name"), some("name"), F.lit("external")).alias("qualified_name"),
        F.lit("external").alias("role"),
        F.lit("resolved").alias("confidence"),
    )
    # Of several edges to a missing target the first by id names it.
    label = F.coalesce(some("target_name"), missing_label(F.col("call_name"), F.col("call_expression"), F.col("target_id")))
    lost = calls.filter("is_unresolved").groupBy("related_id").agg(F.min_by(label, "id").alias("name"))
    lost = lost.select(F.col("related_id").alias("id"), F.lit("unresolved").alias("kind"), "name", F.concat(F.lit("unresolved:"), "name").alias("qualified_name"), F.lit("unresolved").alias("role"), F.lit("unresolved").alias("confidence"))
    return own.unionByName(outside).unionByName(lost)


def is_parser_failure(code: Column, message: Column) -> Column:
    """P13."""
    c, m = F.lower(code), F.lower(message)
    return F.contains(c, F.lit("parse")) | F.contains(c, F.lit("syntax")) | F.contains(m, F.lit("parse"))


def is_excluded_file(code: Column, message: Column) -> Column:
    """P13."""
    c, m = F.lower(code), F.lower(message)
    return F.contains(c, F.lit("exclude")) | F.contains(c, F.lit("skip")) | F.contains(m, F.lit("excluded"))


def full_summary(nodes: DataFrame, calls: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """A3: the eleven counters of the index, one row; ``diagnostics`` has code and message."""
    fanned = fan(nodes, calls)
    edges = calls.agg(
        F.count(F.lit(1)).alias("call_edges"),
        F.count_distinct(F.when(F.col("is_external"), F.col("related_id"))).alias("external_callables"),
        F.count_distinct(F.when(F.col("is_unresolved"), F.col("related_id"))).alias("unresolved_callables"),
        F.count_if("is_external").alias("external_call_edges"),
        F.count_if("is_unresolved").alias("unresolved_call_edges"),
        F.count_if(F.col("confidence") == "inferred").alias("inferred_call_edges"),
    )
    own = fanned.agg(F.count(F.lit(1)).alias("concrete"), F.count_if((F.col("callers") == 0) & (F.col("callees") > 0)).alias("visible"))
    told = diagnostics.agg(F.count_if(is_parser_failure(F.col("code"), F.col("message"))).alias("parser_failures"), F.count_if(is_excluded_file(F.col("code"), F.col("message"))).alias("excluded_files"))
    all_ = F.col("concrete") + F.col("external_callables") + F.col("unresolved_callables")
    return edges.crossJoin(own).crossJoin(told).select(*edges.columns, all_.alias("callables"), "visible", F.greatest(all_ - F.col("visible"), F.lit(0)).alias("hidden"), "parser_failures", "excluded_files")  # one row each


def summary(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """A3: the counters of the whole index, one row."""
    made = callables(nodes).agg(F.count(F.lit(1)).alias("callables"))
    edges = calls.agg(
        F.count(F.lit(1)).alias("call_edges"),
        F.count_if("is_external").alias("external_calls"),
        F.count_if("is_unresolved").alias("unresolved_calls"),
        F.count_if(F.col("confidence") == "inferred").alias("inferred_edges"),
        F.count_distinct(F.when(F.col("is_external"), F.col("related_id"))).alias("external_targets"),
        F.count_distinct(F.when(F.col("is_unresolved"), F.col("related_id"))).alias("unresolved_targets"),
    )
    return made.crossJoin(edges)  # one row each


def issues(calls: DataFrame) -> DataFrame:
    """A4: external and unresolved calls grouped by (kind, source, target)."""
    kind = F.when(F.col("is_unresolved"), "unresolved").when(F.col("is_external"), "external")
    found = calls.withColumn("issue", kind).filter("issue IS NOT NULL")
    return found.groupBy("issue", "source_id", "related_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("confidence")), ",").alias("confidences"))


def hotspots(fanned: DataFrame, limit: int = 8) -> DataFrame:
    """K3: the functions with most distinct callers or callees; the number of candidates comes along."""
    scored = fanned.select("id", "name", "callers", "callees", F.greatest("callers", "callees").alias("score"), (F.col("callers") + F.col("callees")).alias("total"), "file_path", "start_line").filter("score > 1")
    candidates = scored.agg(F.count(F.lit(1)).alias("candidates"))
    top = scored.orderBy(F.desc("score"), F.desc("total"), "file_path", "start_line", "name", "id").limit(limit)
    return top.crossJoin(F.broadcast(candidates)).drop("total")  # one row


def strongest_edges(edges: DataFrame, by: tuple[str, ...] = ("target_id", "source_id")) -> DataFrame:
    """One call edge per pair, the strongest by confidence, then earliest line, then id."""
    order = F.struct(confidence_rank(F.col("confidence")), F.col("start_line"), F.col("id"))
    return edges.filter(F.col("kind") == "calls").groupBy(*by).agg(F.min_by(F.struct("id", "confidence", "start_line"), order).alias("best")).select(*by, "best.id", "best.confidence", "best.start_line")


def last_wins(rows: DataFrame, key: str, ordinal: str, first: bool = False) -> DataFrame:
    """One row per key; the last written, or the first."""
    own = Window.partitionBy(key).orderBy(F.asc(ordinal) if first else F.desc(ordinal))
    return rows.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def induced_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col("id").alias("n"))
    return edges.join(ids, F.col("source_id") == F.col("n"), "left_semi").join(ids, F.col("target_id") == F.col("n"), "left_semi")


def language_summary(files: DataFrame, language: str, decimals: int = 1) -> DataFrame:
    """Files per language with their share in percent."""
    from ..functions.scalars import rounded

    counts = files.groupBy(language).agg(F.count(F.lit(1)).alias("files"))
    total = counts.agg(F.sum("files").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(language, "files", rounded(F.col("files") * 100.0 / F.col("total"), decimals).alias("percentage"))
