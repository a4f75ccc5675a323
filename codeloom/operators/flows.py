"""Semantic flows from entry points to handlers and below, and the risks that their gaps show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import CALLABLE_KINDS, confidence_name, confidence_rank
from . import index, traverse
from .lineage import kept
from .selection import smallest_values

#: The confidence that a binding by place counts for.
PLACE_RANKS = {"contains": 0, "overlaps": 2}
RISK_LIMIT = 5
RISK_KINDS = ("analysisCoverage", "entrypointCoverage", "unresolvedExecution")


def route_targets(unit_edges: DataFrame) -> DataFrame:
    """(route_id, target_unit, rank): each route's target units with their strongest routesTo edge; no confidence counts as unresolved."""
    edges = unit_edges.filter("kind = 'routesTo'")
    return edges.groupBy(F.col("source_id").alias("route_id"), F.col("target_id").alias("target_unit")).agg(F.min(confidence_rank(F.col("confidence"))).alias("rank"))


def semantic_flows(units: DataFrame, bindings: DataFrame, unit_edges: DataFrame) -> DataFrame:
    """One row per entry point (route or operation): its handler, or the gap.

    Callables bound to the entry unit itself are taken if there are any, else for routes those bound to
    the units it routes to, each as sure as the weaker of edge and binding.  Several callables at the best rank
    are ambiguous; none is ``handlerNotMapped``, with the weakest of its routesTo edges as confidence.
    ``bindings`` has unit_id, function_id and evidence, and for those of :func:`binding.places` the number of functions.
    """
    entries = units.filter(F.col("kind").isin("route", "operation")).select(F.col("id").alias("entry_id"), F.col("kind").alias("entry_kind"), "framework", F.col("file_path").alias("entry_path"), F.col("start_line").alias("entry_line"))
    place = F.lit(3)
    for evidence, rank in PLACE_RANKS.items():
        place = F.when(F.col("evidence") == evidence, rank).otherwise(place)
    number = F.col("functions") if "functions" in bindings.columns else F.lit(1).cast("long")
    bound = bindings.select("unit_id", "function_id", place.alias("place"), number.alias("functions"))
    targets = route_targets(unit_edges)
    direct = entries.join(bound, F.col("entry_id") == F.col("unit_id")).select("entry_id", "function_id", "functions", F.col("place").alias("rank"), F.lit(0).alias("via"))
    routes = entries.filter("entry_kind = 'route'").select("entry_id").join(targets, F.col("entry_id") == F.col("route_id"))
    known = units.select(F.col("id").alias("known"))
    routes = routes.join(known, F.col("target_unit") == F.col("known"), "left_semi")
    routed = routes.join(bound, F.col("target_unit") == F.col("unit_id")).select("entry_id", "function_id", "functions", F.greatest("rank", "place").alias("rank"), F.lit(1).alias("via"))
    # The smallest (via, rank) of an entry point names the candidates that count.
    best = direct.unionByName(routed).groupBy("entry_id", "function_id").agg(F.min(F.struct("via", "rank")).alias("at"), F.max("functions").alias("functions"))
    lowest = best.groupBy("entry_id").agg(F.min("at").alias("lowest"))
    tied = best.join(lowest, "entry_id").filter(F.col("at") == F.col("lowest"))
    per = tied.groupBy("entry_id").agg(F.sum("functions").alias("candidates"), F.min("function_id").alias("first_id"), F.min("at").alias("at"))
    weakest = routes.groupBy("entry_id").agg(F.count(F.lit(1)).alias("target_units"), F.max("rank").alias("weakest"))
    joined = entries.join(per, "entry_id", "left").join(weakest, "entry_id", "left")
    status = F.when(F.col("candidates").isNull(), "handlerNotMapped").when(F.col("candidates") > 1, "ambiguous").otherwise("mapped")
    zero = F.lit(0).cast("long")
    return joined.select(
        "entry_id",
        "entry_kind",
        "framework",
        "entry_path",
        "entry_line",
        status.alias("status"),
        F.when(status == "mapped", F.col("first_id")).alias("handler_id"),
        F.coalesce("candidates", zero).alias("candidates"),
        F.coalesce("target_units", zero).alias("target_units"),
        F.when(F.col("candidates").isNull(), F.col("weakest")).otherwise(F.col("at.rank")).alias("rank"),
    )


def flow_summary(flows: DataFrame) -> DataFrame:
    """Counters over all flows, one row."""
    is_, route, operation = (lambda s: F.col("status") == s), F.col("entry_kind") == "route", F.col("entry_kind") == "operation"
    return flows.agg(
        F.count(F.lit(1)).alias("entrypoints"),
        F.count_if(route).alias("routes"),
        F.count_if(operation).alias("operations"),
        F.count_if(is_("mapped")).alias("mapped"),
        F.count_if(is_("ambiguous")).alias("ambiguous"),
        F.count_if(is_("ambiguous") & route).alias("ambiguous_routes"),
        F.count_if(is_("ambiguous") & operation).alias("ambiguous_operations"),
        F.count_if(is_("handlerNotMapped")).alias("not_mapped"),
    )


def flow_steps(flows: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, max_steps: int = 25) -> tuple[DataFrame, DataFrame]:
    """The call steps below all mapped handlers, and each flow's gaps.

    Steps are (entry_id, source_id, target_id, depth, position, edge_id, edge_confidence, resolution), in the order
    of the walk, ``max_steps`` of each flow at most.  Gaps are (entry_id, steps, omitted, step_gap, depth_gap): how many
    steps the limit leaves out, else whether calls of functions at the deepest level lead on.
    Handlers are walked once, whatever the number of flows that share them.
    """
    mapped = kept(flows.filter("handler_id IS NOT NULL").select("entry_id", "handler_id"))
    starts = mapped.select(F.col("handler_id").alias("start")).distinct()
    walked = traverse.downstream(starts, nodes, edges, max_depth, None)
    strongest = index.strongest_edges(edges, ("source_id", "target_id")).select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("id").alias("edge_id"), F.col("confidence").alias("edge_confidence"))
    kinds = nodes.select(F.col("id").alias("n"), F.col("kind").alias("target_kind"))
    below = walked.filter("depth > 0").join(strongest, (F.col("parent") == F.col("s")) & (F.col("node") == F.col("t"))).join(kinds, F.col("node") == F.col("n"), "left")
    unresolved = (F.col("edge_confidence") == "unresolved") | F.col("n").isNull()
    resolution = F.when(unresolved, "unresolved").when(F.col("target_kind") == "external", "external").otherwise("concrete")
    steps = below.select(F.col("start"), F.col("parent").alias("source_id"), F.col("node").alias("target_id"), "depth", "position", "edge_id", "edge_confidence", resolution.alias("resolution"))
    deepest = below.filter((F.col("depth") == max_depth) & F.col("target_kind").isin(*CALLABLE_KINDS)).select("start", F.col("node").alias("s"))
    seen = walked.select(F.col("start"), F.col("node").alias("t"))
    onward = deepest.join(strongest.select("s", "t"), "s").join(seen, ["start", "t"], "left_anti").select("start").distinct().withColumn("leads_on", F.lit(True))
    counts = walked.groupBy("start").agg(F.count_if(F.col("depth") > 0).alias("all_steps")).join(onward, "start", "left")
    omitted = F.greatest(F.col("all_steps") - max_steps, F.lit(0))
    gaps = mapped.join(counts, F.col("handler_id") == F.col("start")).select("entry_id", F.least("all_steps", F.lit(max_steps)).cast("long").alias("steps"), omitted.cast("long").alias("omitted"), (omitted > 0).alias("step_gap"), (F.coalesce("leads_on", F.lit(False)) & (omitted == 0)).alias("depth_gap"))
    visible = steps.filter(F.col("position") <= max_steps)
    return mapped.join(visible, F.col("handler_id") == F.col("start")).drop("handler_id", "start"), gaps


def analysis_risk(diagnostics: DataFrame, gaps: DataFrame) -> DataFrame:
    """Errors, warnings and walks that met a limit, as one risk; no row if there are none."""
    told = diagnostics.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.min(F.when(F.col("severity").isin("error", "warning") & (F.col("file_path") != ""), F.col("file_path"))).alias("location"))
    cut = gaps.filter("step_gap OR depth_gap").agg(F.count(F.lit(1)).alias("limits"), F.count_distinct("entry_id").alias("affected"))
    evidence = F.col("errors") + F.col("warnings") + F.col("limits")
    row = told.crossJoin(cut).select(F.lit(RISK_KINDS[0]).alias("kind"), F.lit("analysis-coverage").alias("id"), "affected", evidence.alias("evidence"), F.lit(None).cast("string").alias("confidence"), "location", "errors", "warnings", "limits")  # one row each
    return row.filter("evidence > 0")


def entrypoint_risks(flows: DataFrame, roots: DataFrame) -> DataFrame:
    """Mapping gaps per framework and root: evidence, distinct affected entry points, weakest confidence, first location.

    ``roots`` (path, root) gives the root of every entry's file.
    """
    gaps = flows.filter("status <> 'mapped'").join(roots, F.col("entry_path") == F.col("path"), "left")
    return gaps.groupBy("framework", F.coalesce("root", F.lit("")).alias("root")).agg(
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("status") == "handlerNotMapped").alias("not_mapped"),
        F.count(F.lit(1)).alias("evidence"),
        F.count_distinct("entry_id").alias("affected"),
        confidence_name(F.max("rank")).alias("confidence"),
        F.min(F.struct("entry_path", "entry_line")).alias("first"),
    ).select("framework", "root", "ambiguous", "not_mapped", "evidence", "affected", "confidence", F.col("first.entry_path").alias("location"), F.col("first.entry_line").alias("line"))


#: Identities of evidence that a risk names.
EVIDENCE_IDS = 3


def with_sources(risks: DataFrame, steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """:func:`unresolved_risks` with the calling function's name and place, and its first edges as evidence."""
    missing = steps.filter("resolution = 'unresolved'").select("source_id", "edge_id").distinct()
    ids = smallest_values(missing, ["source_id"], "edge_id", EVIDENCE_IDS, "ids").select(F.col("source_id").alias("e"), F.array_join("ids", ",").alias("evidence_ids"))
    named = nodes.select(F.col("id").alias("f"), F.col("name").alias("source_name"), F.col("file_path").alias("location"), F.col("start_line").alias("line"))
    return risks.join(named, F.col("source_id") == F.col("f"), "left").join(ids, F.col("source_id") == F.col("e"), "left").drop("f", "e")


def unresolved_risks(steps: DataFrame) -> DataFrame:
    """Unresolved calls in flows per calling function; an edge counts once however many flows run over it."""
    missing = steps.filter("resolution = 'unresolved'")
    return missing.groupBy("source_id").agg(F.count_distinct("edge_id").alias("evidence"), F.count_distinct("entry_id").alias("affected"), confidence_name(F.max(confidence_rank(F.col("edge_confidence")))).alias("confidence"))


def risk_radar(analysis: DataFrame, entrypoints: DataFrame, unresolved: DataFrame, limit: int = RISK_LIMIT) -> DataFrame:
    """The best risk of each kind first, the other places by reach, evidence, kind and id.

    Every row carries the number of candidates that the limit leaves out, and of its own evidence what the given risks have:
    where it stands, the function's name, identities, and the counters behind the sum.
    """
    details = {"location": "string", "line": "int", "source_name": "string", "evidence_ids": "string", "errors": "long", "warnings": "long", "limits": "long", "ambiguous": "long", "not_mapped": "long"}
    columns = ["kind", "id", "affected", "evidence", "confidence", *details]
    told = lambda df: df.select(*df.columns, *[F.lit(None).cast(t).alias(c) for c, t in details.items() if c not in df.columns])
    analysis, entrypoints, unresolved = told(analysis), told(entrypoints), told(unresolved)
    by_entry = entrypoints.select(F.lit(RISK_KINDS[1]).alias("kind"), F.concat_ws(":", "framework", "root").alias("id"), "affected", "evidence", "confidence", *details)
    by_source = unresolved.select(F.lit(RISK_KINDS[2]).alias("kind"), F.col("source_id").alias("id"), "affected", "evidence", "confidence", *details)
    all_ = analysis.select(*columns).unionByName(by_entry).unionByName(by_source)
    order = [F.desc("affected"), F.desc("evidence"), F.asc("id")]
    # No more than ``limit`` rows of a kind can be chosen; Spark cuts them before the shuffle.
    own = Window.partitionBy("kind").orderBy(*order)
    numbered = all_.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= limit)
    kind_order = F.array_position(F.array(*map(F.lit, RISK_KINDS)), F.col("kind"))
    chosen = numbered.orderBy(F.when(F.col("n") == 1, kind_order).otherwise(len(RISK_KINDS) + 1), *order[:2], "kind", "id").limit(limit)
    total = all_.agg(F.count(F.lit(1)).alias("candidates"))
    return chosen.crossJoin(F.broadcast(total)).select(*columns, F.greatest(F.col("candidates") - limit, F.lit(0)).alias("omitted"))  # one row


# --- what a project's brief counts -----------------------------------------------------------------------------

#: Groups shown, and entry points named for each.
GROUP_LIMIT, GROUP_EXAMPLES = 3, 3
# The roots of GraphQL operations that have a name of their own.
GRAPHQL_ROOTS = ("Query", "Mutation", "Subscription")


def operation_type() -> Column:
    """Query, Mutation, Subscription or Other of an operation by the root of its qualified name; null for routes."""
    root = F.split_part("qualified_name", F.lit("."), F.lit(1))
    return F.when(F.col("entry_kind") == "operation", F.when(root.isin(*GRAPHQL_ROOTS), root).otherwise("Other"))


def entrypoint_groups(flows: DataFrame, limit: int = GROUP_LIMIT, examples: int = GROUP_EXAMPLES) -> DataFrame:
    """The largest groups of entry points by framework, root, kind and operation, with what the limit leaves out.

    ``flows`` has entry_id, framework, root_path, entry_kind, qualified_name and status.  Ties go by framework, root, kind and operation.
    """
    keys = ["framework", "root_path", "entry_kind", "operation"]
    own = flows.withColumn("operation", F.coalesce(operation_type(), F.lit("http")))
    named = smallest_values(own, keys, "entry_id", examples, "examples").drop("n")
    groups = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("entrypoints"), F.count_if(F.col("status") == "mapped").alias("mapped"), F.count_if(F.col("status").isin("ambiguous", "handlerNotMapped")).alias("gaps"))
    totals = groups.agg(F.count(F.lit(1)).alias("all_groups"), F.sum("entrypoints").alias("all_entrypoints"))
    top = groups.orderBy(F.desc("entrypoints"), *keys).limit(limit)
    shown = top.agg(F.count(F.lit(1)).alias("shown_groups"), F.sum("entrypoints").alias("shown_entrypoints"))
    counted = top.crossJoin(totals).crossJoin(shown)  # one row each
    return counted.join(named, keys).select(*keys, "entrypoints", "mapped", "gaps", F.array_join("examples", ",").alias("examples"), (F.col("all_groups") - F.col("shown_groups")).alias("omitted_groups"), (F.col("all_entrypoints") - F.col("shown_entrypoints")).alias("omitted_entrypoints"))


def analysis_coverage(diagnostics: DataFrame, nodes: DataFrame, edges: DataFrame, flows: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row of counters of what limits the analysis: diagnostics, calls, entry points, walks cut short."""
    severity = F.col("severity")
    told = diagnostics.agg(F.count_if(severity == "error").alias("errors"), F.count_if(severity == "warning").alias("warnings"), F.count_if(~severity.isin("error", "warning")).alias("infos"))
    known = nodes.select(F.col("id").alias("n")).distinct()
    calls = edges.filter("kind = 'calls'").join(known, F.col("target_id") == F.col("n"), "left")
    called = calls.agg(F.count_if((F.col("confidence") == "unresolved") | F.col("n").isNull()).alias("unresolved_calls"), F.count_if(F.col("confidence") == "inferred").alias("inferred_calls"))
    entered = flows.agg(F.count_if(F.col("status") == "ambiguous").alias("ambiguous_entrypoints"), F.count_if(F.col("status") == "handlerNotMapped").alias("handlers_not_mapped"))
    cut = gaps.agg((F.count_if("step_gap") + F.count_if("depth_gap")).alias("traversal_limits"))
    return told.crossJoin(called).crossJoin(entered).crossJoin(cut)  # one row each


def execution_counts(flows: DataFrame, scope: str) -> DataFrame:
    """Entry points of each scope: mapped, with a gap, over HTTP, and of each kind of GraphQL operation."""
    kind = operation_type()
    of = {"graphql_queries": "Query", "graphql_mutations": "Mutation", "graphql_subscriptions": "Subscription", "graphql_others": "Other"}
    return flows.groupBy(scope).agg(
        F.count(F.lit(1)).alias("entrypoints"),
        F.count_if(F.col("status") == "mapped").alias("mapped"),
        F.count_if(F.col("status").isin("ambiguous", "handlerNotMapped")).alias("gaps"),
        F.count_if(F.col("entry_kind") == "route").alias("http_routes"),
        *[F.count_if(F.coalesce(kind, F.lit("")) == value).alias(name) for name, value in of.items()],
    )
