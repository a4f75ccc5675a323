"""The queries of the graph operators, by inventory id, and their SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import binding, components, dataflow, index, ownership, search, traverse, views
from .fixtures import Graph, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *relations: str):
    """Register a function of a :class:`Graph`; ``sql`` runs after the relations' table expressions."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(*relations, query=sql) if relations else sql
        return f

    return add


NE = ("fx_nodes", "fx_call_edges")
_CALLS = """with calls as (
  select e.*, n.id as node_id, n.kind as target_kind,
    (e.confidence = 'unresolved' or n.id is null) as is_unresolved,
    (not (e.confidence = 'unresolved' or n.id is null) and n.kind = 'external') as is_external,
    case when e.confidence = 'unresolved' or n.id is null then concat('unresolved:', e.target_id) else e.target_id end as related_id
  from fx_call_edges e left join fx_nodes n on e.target_id = n.id where e.kind = 'calls')"""
_FAN = _CALLS + """, outs as (select source_id, count(distinct related_id) as callees, count(*) filter (where is_unresolved) as unresolved_calls, count(*) filter (where is_external) as external_calls from calls group by 1),
ins as (select related_id, count(distinct source_id) as callers from calls group by 1),
fan as (select n.id, n.kind, n.name, n.qualified_name, n.file_path, n.start_line, coalesce(callers, 0) as callers, coalesce(callees, 0) as callees, coalesce(unresolved_calls, 0) as unresolved_calls, coalesce(external_calls, 0) as external_calls
  from fx_nodes n left join outs on n.id = outs.source_id left join ins on n.id = ins.related_id where n.kind in ('function', 'method', 'constructor'))"""
_ROLE = "case when callers = 0 and callees > 0 then 'entrypoint' when callers > 1 then 'utility' else 'unknown' end"
_RANK = "case confidence when 'exact' then 0 when 'resolved' then 1 when 'inferred' then 2 else 3 end"


def _calls(g: Graph) -> DataFrame:
    return index.resolved_calls(g.nodes, g.edges)


def _fan(g: Graph) -> DataFrame:
    return index.fan(g.nodes, _calls(g))


# --- function index ----------------------------------------------------------------------------


@query("P1_callables", "select id, kind, name from fx_nodes where kind in ('function', 'method', 'constructor')", "fx_nodes")
def _(g):
    return index.callables(g.nodes).select("id", "kind", "name")


@query("J1_P3_resolved_calls", _CALLS + " select id, source_id, related_id, is_unresolved, is_external from calls", *NE)
def _(g):
    return _calls(g).select("id", "source_id", "related_id", "is_unresolved", "is_external")


@query("J2_both_ends", "select e.id, s.name as source_name, t.name as target_name from fx_call_edges e join fx_nodes s on s.id = e.source_id join fx_nodes t on t.id = e.target_id", *NE)
def _(g):
    s, t = (g.nodes.select(F.col("id").alias(f"{k}_id"), F.col("name").alias(f"{k}_name")) for k in ("s", "t"))
    return g.edges.join(s, F.col("source_id") == F.col("s_id")).join(t, F.col("target_id") == F.col("t_id")).select("id", F.col("s_name").alias("source_name"), F.col("t_name").alias("target_name"))


@query("J3_semi_concrete_sources", "select id from fx_call_edges e where exists (select 1 from fx_nodes n where n.id = e.source_id and n.kind = 'method')", *NE)
def _(g):
    m = g.nodes.filter("kind = 'method'").select(F.col("id").alias("n"))
    return g.edges.join(m, F.col("source_id") == F.col("n"), "left_semi").select("id")


@query("J4_U4_induced_subgraph", "select e.id from fx_call_edges e where e.source_id in (select id from fx_nodes where kind <> 'constructor') and e.target_id in (select id from fx_nodes where kind <> 'constructor')", *NE)
def _(g):
    return index.induced_subgraph(g.nodes.filter("kind <> 'constructor'"), g.edges).select("id")


@query("J5_U5_uncalled", "select id from fx_nodes n where kind in ('function', 'method', 'constructor') and not exists (select 1 from fx_call_edges e where e.target_id = n.id)", *NE)
def _(g):
    return index.callables(g.nodes).join(g.edges.select("target_id"), F.col("id") == F.col("target_id"), "left_anti").select("id")


@query("A1_call_relations", _CALLS + " select source_id, related_id, count(*) as call_count, string_agg(id, ',' order by id) as edge_ids, string_agg(distinct confidence, ',' order by confidence) as confidences from calls group by 1, 2", *NE)
def _(g):
    return index.call_relations(_calls(g)).select("source_id", "related_id", "call_count", F.array_join("edge_ids", ",").alias("edge_ids"), F.array_join("confidences", ",").alias("confidences"))


@query("A2_fan", _FAN + " select id, callers, callees, unresolved_calls, external_calls from fan", *NE)
def _(g):
    return _fan(g).select("id", "callers", "callees", "unresolved_calls", "external_calls")


@query("A4_issues", _CALLS + " select case when is_unresolved then 'unresolved' else 'external' end as issue, source_id, related_id, count(*) as n, string_agg(distinct confidence, ',' order by confidence) as confidences from calls where is_unresolved or is_external group by 1, 2, 3", *NE)
def _(g):
    return index.issues(_calls(g))


@query(
    "P6_P7_roles_tags",
    _FAN + f""" select id, {_ROLE} as role, concat_ws(',', case when external_calls > 0 then 'externalCall' end, case when unresolved_calls > 0 then 'unresolvedCall' end, case when callees = 0 then 'leaf' end, case when callers > 1 then 'sharedUtility' end) as tags from fan""",
    *NE,
)
def _(g):
    return index.described(_fan(g)).select("id", "role", F.array_join("tags", ",").alias("tags"))


@query(
    "K3_hotspots",
    _FAN + """, scored as (select *, greatest(callers, callees) as score, callers + callees as total from fan where greatest(callers, callees) > 1)
    select id, name, callers, callees, score, file_path, start_line, (select count(*) from scored) as candidates from scored order by score desc, total desc, file_path, start_line, name, id limit 8""",
    *NE,
)
def _(g):
    return index.hotspots(_fan(g))


@query("A5_language_summary", "select lang, count(*) as files, floor(count(*) * 1000.0 / (select count(*) from documents) + 0.5) / 10 as percentage from documents group by 1")
def _(g):
    return index.language_summary(g["documents"].select("lang"), "lang", 1)


@query("A6_language_summary_fine", "select lang, count(*) as files, floor(count(*) * 10000.0 / (select count(*) from documents) + 0.5) / 100 as percentage from documents group by 1")
def _(g):
    return index.language_summary(g["documents"].select("lang"), "lang", 2)


@query("A7_strongest_callers", f"select target_id, source_id, id, confidence, start_line from (select *, row_number() over (partition by target_id, source_id order by {_RANK}, start_line, id) as r from fx_call_edges) t where r = 1", "fx_call_edges")
def _(g):
    return index.strongest_edges(g.edges)


@query("A9_A10_W2_best_targets", f"""select source_id, count(distinct target_id) as candidates, min(target_id) as target_id, min(confidence) as confidence, count(distinct target_id) > 1 as ambiguous
    from (select *, rank() over (partition by source_id order by {_RANK}) as r from fx_call_edges) t where r = 1 group by 1""", "fx_call_edges")
def _(g):
    return ownership.confidence_window(g.edges)


@query("A11_A12_confidence_extremes", f"select source_id, min({_RANK}) as strongest, max({_RANK}) as weakest from fx_call_edges group by 1", "fx_call_edges")
def _(g):
    r = S.confidence_rank(F.col("confidence"))
    return g.edges.groupBy("source_id").agg(F.min(r).alias("strongest"), F.max(r).alias("weakest"))


@query("A28_first_location", "select target_id, min(start_line) as line, count(*) as n from fx_call_edges group by 1", "fx_call_edges")
def _(g):
    return g.edges.groupBy("target_id").agg(F.min("start_line").alias("line"), F.count(F.lit(1)).alias("n"))


@query("U1_last_write_wins", "select * from (select event_id % 1000 as id, event_id as ordinal, event_type, row_number() over (partition by event_id % 1000 order by event_id desc) as r from events) t where r = 1")
def _(g):
    rows = g["events"].select((F.col("event_id") % 1000).alias("id"), F.col("event_id").alias("ordinal"), "event_type")
    return index.last_wins(rows, "id", "ordinal").withColumn("r", F.lit(1))


@query("U2_first_write_wins", "select id, ordinal, event_type from (select event_id % 1000 as id, event_id as ordinal, event_type, row_number() over (partition by event_id % 1000 order by event_id) as r from events) t where r = 1")
def _(g):
    return index.last_wins(g["events"].select((F.col("event_id") % 1000).alias("id"), F.col("event_id").alias("ordinal"), "event_type"), "id", "ordinal", first=True)


# --- search ------------------------------------------------------------------------------------

_SEARCH = _FAN + f""", matched as (select *, {_ROLE} as role,
  greatest(case when lower(trim(name)) = 'blue' then 600 when starts_with(lower(trim(name)), 'blue') then 500 when contains(lower(trim(name)), 'blue') then 400 else 0 end,
    case when lower(trim(qualified_name)) = 'blue' then 550 when starts_with(lower(trim(qualified_name)), 'blue') then 450 when contains(lower(trim(qualified_name)), 'blue') then 350 else 0 end,
    case when lower(trim(file_path)) = 'blue' then 325 when starts_with(lower(trim(file_path)), 'blue') then 300 when contains(lower(trim(file_path)), 'blue') then 250 else 0 end) as score from fan),
found as (select *, case role when 'entrypoint' then 100 when 'utility' then 25 else 0 end + callers * 4 + callees * 3 + unresolved_calls * 2 + external_calls as relevance from matched where score > 0)"""


def _found(g: Graph) -> DataFrame:
    names = g.nodes.select(F.col("id").alias("n"), "qualified_name")
    return search.scored(index.described(_fan(g)).join(names, F.col("id") == F.col("n")), "blue")


@query("K4_K5_search_scores", _SEARCH + " select id, score, relevance from found", *NE)
def _(g):
    return _found(g).select("id", "score", "relevance")


@query("K6_search_page", _SEARCH + " select id, score, relevance, (select count(*) from found) as total, greatest((select count(*) from found) - 20, 0) as omitted from found order by score desc, relevance desc, name, qualified_name, file_path, start_line, id limit 20", *NE)
def _(g):
    return search.top(_found(g), 20).select("id", "score", "relevance", "total", "omitted")


@query("K7_second_page", _SEARCH + " select id, score, relevance from found order by score desc, relevance desc, name, qualified_name, file_path, start_line, id limit 20 offset 20", *NE)
def _(g):
    found = _found(g)
    cursor = search.Cursor("blue", "fixture", 20).at(20)
    return search.page(found, "blue", "fixture", 20, cursor)[0].select("id", "score", "relevance")


# --- modules -----------------------------------------------------------------------------------

MOD = ("fx_nodes", "fx_call_edges", "fx_boundaries")
_OWN = """with paths as (select distinct file_path from fx_nodes where file_path <> ''), owner as (
  select file_path as path, max_by(root_key, length(root_key)) as module from paths join (select distinct root_key from fx_boundaries) b on file_path = root_key or starts_with(file_path, concat(root_key, '/')) group by 1)"""
_LOCATED = _OWN + """, homes as (select id, module from fx_nodes left join owner on file_path = path),
located as (select e.*, s.module as source_module, t.module as target_module from fx_call_edges e left join homes s on s.id = e.source_id left join homes t on t.id = e.target_id)"""
_RELATED = _LOCATED + """, related as (select source_module, target_module, kind, count(*) as evidence, count(*) filter (where confidence = 'exact') as exact, count(*) filter (where confidence = 'resolved') as resolved, count(*) filter (where confidence = 'inferred') as inferred, count(*) filter (where confidence = 'unresolved') as unresolved,
  array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') as representatives, greatest(count(*) - 5, 0) as omitted from located where source_module <> target_module group by 1, 2, 3)"""


def _owner(g: Graph) -> DataFrame:
    return ownership.owners(g.nodes, g["fx_boundaries"])


def _located(g: Graph) -> DataFrame:
    return ownership.module_edges(g.nodes, g.edges, _owner(g))


@query("J10_longest_prefix", _OWN + " select path, module from owner", *MOD)
def _(g):
    return _owner(g)


@query("J11_owned_edges", _LOCATED + " select id, source_module, target_module from located", *MOD)
def _(g):
    return _located(g).select("id", "source_module", "target_module")


@query("A16_relation_coverage", _LOCATED + " select count(*) filter (where source_module <> target_module) as cross_module, count(*) filter (where source_module = target_module) as internal, count(*) filter (where target_module is null and source_module is not null) as \"external\", count(*) filter (where source_module is null) as unowned from located", *MOD)
def _(g):
    return ownership.coverage(_located(g))


@query("A17_pair_totals", _RELATED + " select source_module, target_module, cast(sum(evidence) as bigint) as evidence, count(*) as kinds, cast(sum(exact) as bigint) as exact, cast(sum(resolved) as bigint) as resolved, cast(sum(inferred) as bigint) as inferred, cast(sum(unresolved) as bigint) as unresolved from related group by 1, 2", *MOD)
def _(g):
    return ownership.pair_totals(ownership.relations(_located(g)))


@query(
    "A18_rollup",
    _OWN + """, homes as (select n.*, module from fx_nodes n join owner on file_path = path), direct as (select module, count(distinct file_path) as files, count(*) filter (where kind in ('function', 'method', 'constructor')) as callables from homes group by 1),
    roots as (select distinct root_key from fx_boundaries), closure as (select a.root_key as module, b.root_key as ancestor from roots a join roots b on a.root_key = b.root_key or starts_with(a.root_key, concat(b.root_key, '/')))
    select c.ancestor as module, coalesce(max(d2.files), 0) as files, coalesce(max(d2.callables), 0) as callables, cast(coalesce(sum(d.files), 0) as bigint) as all_files, cast(coalesce(sum(d.callables), 0) as bigint) as all_callables
    from closure c left join direct d on d.module = c.module left join direct d2 on d2.module = c.ancestor group by 1""",
    *MOD,
)
def _(g):
    return ownership.rollup(g.nodes, _owner(g), g["fx_boundaries"])


@query("A19_boundary_merge", "select root_key, min_by(basis, case basis when 'workspacePackage' then 1 when 'frameworkRoot' then 2 when 'sourceArea' then 3 else 4 end) as basis, string_agg(distinct basis, ',' order by basis) as bases from fx_boundaries group by 1", "fx_boundaries")
def _(g):
    return ownership.boundary_merge(g["fx_boundaries"])


@query("A21_unshadowed_roots", "select distinct root_key, basis from fx_boundaries b where not exists (select 1 from fx_boundaries c where starts_with(c.root_key, concat(b.root_key, '/')))", "fx_boundaries")
def _(g):
    return ownership.drop_shadowed_parents(g["fx_boundaries"]).distinct()


# --- units and flows ---------------------------------------------------------------------------

_BOUND = "with bound as (select u.id as unit_id, u.framework, u.kind as unit_kind, p.id as function_id, case when u.start_line <= p.start_line and u.end_line >= p.end_line then 'contains' else 'overlaps' end as evidence from fx_units u join fx_parts p on u.file_path = p.file_path and u.start_line <= p.end_line and p.start_line <= u.end_line)"


def _bound(g: Graph) -> DataFrame:
    return binding.place_bindings(g["fx_units"], g["fx_parts"])


@query("J7_J8_place_bindings", _BOUND + " select * from bound", "fx_units", "fx_parts")
def _(g):
    return _bound(g)


@query(
    "J9_name_bindings",
    """with u as (select concat('u:', id) as unit_id, file_path, regexp_replace(lower(case when start_line % 20 = 0 then name else qualified_name end), '[^a-z0-9]+', '', 'g') as key from fx_parts), f as (
      select id as function_id, file_path, 0 as r, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') as key from fx_parts union all
      select id, file_path, 1, regexp_replace(lower(qualified_name), '[^a-z0-9]+', '', 'g') from fx_parts union all
      select id, file_path, 2, regexp_replace(lower(list_filter(regexp_split_to_array(qualified_name, '[.#:/\\\\]+'), lambda x: x <> '')[-1]), '[^a-z0-9]+', '', 'g') from fx_parts)
    select unit_id, function_id, case min(r) when 0 then 'name' when 1 then 'qualifiedName' else 'segment' end as evidence from u join f on u.file_path = f.file_path and u.key = f.key and u.key <> '' where r < 2 or length(f.key) >= 3 group by 1, 2""",
    "fx_parts",
)
def _(g):
    units = g["fx_parts"].select(F.concat(F.lit("u:"), "id").alias("id"), "file_path", F.when(F.col("start_line") % 20 == 0, F.col("name")).otherwise(F.col("qualified_name")).alias("name"))
    return binding.name_bindings(units, g["fx_parts"])


@query("J19_nearest_edge", """select callsite_id, min_by(id, (d, id)) as edge_id, min(d) as distance from (select c.id as callsite_id, e.id, abs(c.start_line + 3 - e.start_line) as d from fx_call_edges c join fx_call_edges e on c.source_id = e.source_id) t group by 1""", "fx_call_edges")
def _(g):
    sites = g.edges.select(F.col("id").alias("callsite_id"), F.col("source_id").alias("function_id"), (F.col("start_line") + 3).alias("line"))
    return binding.nearest_edge(sites, g.edges)


@query("J20_innermost", """select point_id, range_id from (select p.id as point_id, r.id as range_id, row_number() over (partition by p.id order by r.end_line - r.start_line, -r.start_line, r.id) as n from fx_parts p join fx_units r on p.file_path = r.file_path and r.start_line <= p.start_line + 4 and p.start_line + 4 <= r.end_line) t where n = 1""", "fx_units", "fx_parts")
def _(g):
    points = g["fx_parts"].select(F.col("id").alias("point_id"), F.col("file_path").alias("point_path"), (F.col("start_line") + 4).alias("line"))
    return binding.innermost(points, g["fx_units"])


@query("A22_entrypoint_groups", "select framework, kind, count(*) as entrypoints, count(distinct file_path) as files from fx_units group by 1, 2", "fx_units")
def _(g):
    return g["fx_units"].groupBy("framework", "kind").agg(F.count(F.lit(1)).alias("entrypoints"), F.count_distinct("file_path").alias("files"))


@query(
    "K12_one_per_category",
    """with ranked as (select id, kind as category, end_line - start_line as score, row_number() over (partition by kind order by end_line - start_line desc, id) as r from fx_units), placed as (select *, row_number() over (order by case when r = 1 then 0 else 1 end, score desc, category, id) as position from ranked)
    select id, category, score from placed where position <= 10""",
    "fx_units",
)
def _(g):
    from ..operators.selection import one_per_category

    rows = g["fx_units"].select("id", F.col("kind").alias("category"), (F.col("end_line") - F.col("start_line")).alias("score"))
    return one_per_category(rows, 10)


@query("K17_top_per_scope", "select framework, id, score from (select framework, id, end_line - start_line as score, row_number() over (partition by framework order by end_line - start_line desc, file_path, id) as r from fx_units) t where r <= 3", "fx_units")
def _(g):
    from ..operators.selection import top_per_group

    rows = g["fx_units"].select("framework", "id", (F.col("end_line") - F.col("start_line")).alias("score"), "file_path")
    return top_per_group(rows, "framework", [F.desc("score"), F.asc("file_path"), F.asc("id")], 3).select("framework", "id", "score")


@query("K9_catalog", "select id, framework, kind, name, (select count(*) from fx_units where contains(lower(name), '1')) - 24 as omitted from fx_units where contains(lower(name), '1') order by framework, name, id limit 24", "fx_units")
def _(g):
    from ..operators.selection import catalog

    return catalog(g["fx_units"].select("id", "framework", "kind", "name"), "1", 24)


# --- traversal ---------------------------------------------------------------------------------

_SEEDS = "seeds as (select id from fx_parts where cast(substr(id, 6) as bigint) % 50 = 0)"
_REACH = "with recursive " + _SEEDS + ", walk(start, node, depth) as (select id, id, 0 from seeds union select w.start, e.{there}, w.depth + 1 from walk w join fx_call_edges e on e.{here} = w.node where w.depth < {depth})"


def _seeds(g: Graph) -> DataFrame:
    return g["fx_parts"].filter("try_cast(substr(id, 6) as bigint) % 50 = 0").select(F.col("id").alias("start"))


@query("G1_G2_traverse_callees", _REACH.format(here="source_id", there="target_id", depth=3) + " select start, node, min(depth) as depth from walk group by 1, 2", "fx_call_edges", "fx_parts")
def _(g):
    return traverse.ordered_bfs(_seeds(g), g.edges, "out", 3).select("start", "node", "depth")


@query("G4_I4_change_impact", _REACH.format(here="target_id", there="source_id", depth=4) + ", best as (select start, node, min(depth) as depth from walk group by 1, 2) select start as target_id, node as caller_id, depth from best where depth > 0", "fx_call_edges", "fx_parts")
def _(g):
    return traverse.change_impact(_seeds(g), g.edges, 4, 1_000_000).select("target_id", "caller_id", "depth")


@query("G4_impact_limited")
def _(g):
    return traverse.change_impact(_seeds(g), g.edges, 4, 5).select("target_id", "caller_id", "depth", "confidence", "position")


@query("G5_downstream", "with recursive " + _SEEDS + ", walk(start, node, depth) as (select id, id, 0 from seeds union select w.start, e.target_id, w.depth + 1 from walk w join fx_call_edges e on e.source_id = w.node where w.depth < 3 and (w.depth = 0 or w.node in (select id from fx_parts))) select start, node, min(depth) as depth from walk group by 1, 2", "fx_call_edges", "fx_parts")
def _(g):
    return traverse.downstream(_seeds(g), g.nodes, g.edges, 3, 1_000_000).select("start", "node", "depth")


@query("J14_affected_flows", _REACH.format(here="target_id", there="source_id", depth=2) + ", " + _BOUND[5:] + " select distinct start as target_id, unit_id from walk join bound on function_id = node where evidence = 'contains'", "fx_call_edges", "fx_parts", "fx_units")
def _(g):
    reached = traverse.ordered_bfs(_seeds(g), g.edges, "in", 2).select(F.col("start").alias("target_id"), "node")
    own = g["fx_parts"].join(reached.select(F.col("node").alias("r")), F.col("id") == F.col("r"), "left_semi")
    flows = binding.place_bindings(g["fx_units"], own).filter("evidence = 'contains'").select("unit_id", "function_id")
    return reached.join(flows, F.col("node") == F.col("function_id")).select("target_id", "unit_id").distinct()


@query("C1_strong_components", "with recursive e as (select distinct source_id as s, target_id as t from fx_call_edges where starts_with(target_id, 'part:')), reach(a, b) as (select s, t from e union select r.a, e.t from reach r join e on r.b = e.s), pairs as (select r.a, r.b from reach r join reach q on r.a = q.b and r.b = q.a) select a as node, min(b) as component from pairs group by 1 having count(distinct b) > 1", "fx_call_edges")
def _(g):
    edges = g.edges.filter(F.startswith("target_id", F.lit("part:"))).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return components.strong_components(edges)


# --- control and data flow -----------------------------------------------------------------------


@query(
    "D2_reaching_definitions",
    """with recursive walk(f, b, rd, cur, d) as (select function_id, binding, block_id, block_id, 0 from fx_blocks where access = 'read'
      union select w.f, w.b, w.rd, e.src, w.d + 1 from walk w join fx_block_edges e on e.function_id = w.f and e.dst = w.cur where w.d < 5 and (w.d = 0 or not exists (select 1 from fx_blocks x where x.function_id = w.f and x.block_id = w.cur and x.binding = w.b and x.access = 'define')))
    select f as function_id, b as binding, cur as definition, rd as "read", min(d) as depth from walk join fx_blocks x on x.function_id = f and x.block_id = cur and x.binding = b and x.access = 'define' where d > 0 group by 1, 2, 3, 4""",
    "fx_blocks",
    "fx_block_edges",
)
def _(g):
    return dataflow.reaching_definitions(g["fx_blocks"], g["fx_block_edges"], 5)


@query("D6_reachable_blocks", "with recursive walk(f, b, d) as (select function_id, block_id, 0 from fx_blocks where block_id = 2 union select w.f, e.dst, w.d + 1 from walk w join fx_block_edges e on e.function_id = w.f and e.src = w.b where e.kind = 'next' and w.d < 3) select distinct f as function_id, b as block_id from walk", "fx_blocks", "fx_block_edges")
def _(g):
    starts = g["fx_blocks"].filter("block_id = 2")
    return dataflow.reachable_blocks(starts, g["fx_block_edges"], ("next",), 3)


@query("W4_next_block", "select function_id, block_id, lead(block_id) over (partition by function_id order by block_id) as next_block from fx_blocks", "fx_blocks")
def _(g):
    return dataflow.next_blocks(g["fx_blocks"])


@query("A33_function_summary", "select function_id, count(*) as blocks, count(*) filter (where access = 'define') as definitions, count(*) filter (where access = 'read') as reads, count(distinct binding) as bindings from fx_blocks group by 1", "fx_blocks")
def _(g):
    return dataflow.function_summary(g["fx_blocks"])


# --- scalars -----------------------------------------------------------------------------------


@query("F3_identifier", "select id, regexp_replace(lower(qualified_name), '[^a-z0-9]+', '', 'g') as identifier from fx_parts", "fx_parts")
def _(g):
    return g["fx_parts"].select("id", S.normalise_identifier(F.col("qualified_name")).alias("identifier"))


@query("F9_sha256", "select doc_id, sha256(text) as digest from documents")
def _(g):
    return g["documents"].select("doc_id", F.sha2("text", 256).alias("digest"))


@query("F11_bounded_text", "select id, case when length(file_path) > 12 then concat(left(file_path, 11), '…') else file_path end as head, case when length(file_path) > 12 then concat('…', right(file_path, 11)) else file_path end as tail from fx_parts", "fx_parts")
def _(g):
    return g["fx_parts"].select("id", S.bounded_text(F.col("file_path"), 12).alias("head"), S.bounded_text(F.col("file_path"), 12, tail=True).alias("tail"))


@query("F17_json_probe", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def _(g):
    return g["events"].select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("P11_relation_modes", "select confidence, count(*) as n from fx_call_edges where kind in ('calls', 'routesTo', 'usesModel', 'renders', 'injects', 'configures') group by 1", "fx_call_edges")
def _(g):
    from ..operators.selection import relation_mode

    return g.edges.filter(relation_mode(F.col("kind"), "execution")).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@query("A18_cube", "select r_name, n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def _(g):
    j = g["customer"].join(g["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(g["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


# --- more scalars, limits and extensions -----------------------------------------------------------


@query("F4_segments", "select id, list_filter(regexp_split_to_array(qualified_name, '[.#:/\\\\]+'), lambda x: x <> '')[-1] as last, len(list_filter(regexp_split_to_array(qualified_name, '[.#:/\\\\]+'), lambda x: x <> '')) as n from fx_parts", "fx_parts")
def _(g):
    parts = S.name_segments(F.col("qualified_name"))
    return g["fx_parts"].select("id", F.element_at(parts, -1).alias("last"), F.size(parts).alias("n"))


@query("F7_source_areas", "select case when len(p) > 1 then p[1] end as area, count(*) as files from (select string_split(substr(file_path, 5), '/') as p from (select distinct file_path from fx_parts) t) u group by 1", "fx_parts")
def _(g):
    files = g["fx_parts"].select(F.substr("file_path", F.lit(5)).alias("path")).distinct()
    return files.groupBy(S.source_area(F.col("path")).alias("area")).agg(F.count(F.lit(1)).alias("files"))


@query("F10_weaker_confidence", f"select target_id, count(*) as n, ['exact', 'resolved', 'inferred', 'unresolved'][max({_RANK}) + 1] as confidence from fx_call_edges group by 1", "fx_call_edges")
def _(g):
    return g.edges.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), S.confidence_name(F.max(S.confidence_rank(F.col("confidence")))).alias("confidence"))


@query("F12_safe_labels", "select conv_id, turn, count(*) as n, max(length(coalesce(nullif(trim(regexp_replace(text, '[\\x00-\\x1F\\x7F]+', ' ', 'g'), ' '), ''), 'unnamed'))) as chars from conversations group by 1, 2")
def _(g):
    return g["conversations"].groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.max(F.length(S.safe_label(F.col("text"), "unnamed"))).alias("chars"))


@query("F14_utf16", "select doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as units from documents")
def _(g):
    return g["documents"].select("doc_id", S.utf16_length(F.col("text")).alias("units"))


@query("P3_unresolved_edges", "select e.id from fx_call_edges e left join fx_nodes n on n.id = e.target_id where e.confidence = 'unresolved' or n.id is null", *NE)
def _(g):
    return _calls(g).filter("is_unresolved").select("id")


@query("P8_completeness_filters", _CALLS + " select id from calls where not is_external and not is_unresolved", *NE)
def _(g):
    return _calls(g).filter("NOT is_external AND NOT is_unresolved").select("id")


@query("P9_file_view", "select distinct file_path as id, count(*) as callables from fx_parts group by 1", "fx_parts")
def _(g):
    return index.callables(g.nodes).groupBy(F.col("file_path").alias("id")).agg(F.count(F.lit(1)).alias("callables"))


@query("P12_drop_weak_relations", _RELATED + " select source_module, target_module, evidence from related where exact + resolved > 0", *MOD)
def _(g):
    return ownership.relations(_located(g)).filter("exact + resolved > 0").select("source_module", "target_module", "evidence")


@query("P17_mapped_flows", _BOUND + " select id from fx_units u where exists (select 1 from bound b where b.unit_id = u.id)", "fx_units", "fx_parts")
def _(g):
    bound = binding.place_bindings(g["fx_units"], binding.places(g["fx_parts"]))
    return g["fx_units"].join(bound.select("unit_id"), F.col("id") == F.col("unit_id"), "left_semi").select("id")


@query("A24_coverage_counters", "select count(*) as files, count(*) filter (where file_path like '/ws/promo/%') as promo, count(distinct regexp_replace(file_path, '/[^/]*$', '')) as dirs from (select distinct file_path from fx_parts) t", "fx_parts")
def _(g):
    files = g["fx_parts"].select("file_path").distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.startswith("file_path", F.lit("/ws/promo/"))).alias("promo"), F.count_distinct(S.parent_path(F.col("file_path"))).alias("dirs"))


@query("A29_execution_counts", "select framework, count(*) filter (where kind = 'route') as route, count(*) filter (where kind = 'operation') as operation, count(*) filter (where kind = 'controller') as controller from fx_units group by 1", "fx_units")
def _(g):
    return g["fx_units"].groupBy("framework").pivot("kind", ["route", "operation", "controller"]).count().na.fill(0)


@query("A34_drill_targets", _CALLS + f" select source_id, related_id, count(*) as callsites, min({_RANK}) as strongest from calls group by 1, 2", *NE)
def _(g):
    return _calls(g).groupBy("source_id", "related_id").agg(F.count(F.lit(1)).alias("callsites"), F.min(S.confidence_rank(F.col("confidence"))).alias("strongest"))


@query("A35_barycentre", "select target_id, avg(start_line) as centre from fx_call_edges group by 1", "fx_call_edges")
def _(g):
    return g.edges.groupBy("target_id").agg(F.avg("start_line").alias("centre"))


@query("K1_function_order", "select id, file_path, start_line from fx_parts order by file_path, start_line, name, id limit 250", "fx_parts")
def _(g):
    return g["fx_parts"].orderBy("file_path", "start_line", "name", "id").select("id", "file_path", "start_line").limit(250)


@query("K2_relation_order", _CALLS + " select source_id, related_id, r from (select source_id, related_id, row_number() over (partition by source_id order by related_id) as r from (select distinct source_id, related_id from calls) d) t where r <= 3", *NE)
def _(g):
    from ..operators.selection import top_per_group

    pairs = _calls(g).select("source_id", "related_id").distinct()
    from pyspark.sql import Window

    return top_per_group(pairs.withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy("related_id"))), "source_id", [F.asc("r")], 3)


@query("K14_edge_order", _RELATED + " select source_module, target_module, evidence from related order by evidence desc, source_module, target_module limit 160", *MOD)
def _(g):
    return ownership.relations(_located(g)).orderBy(F.desc("evidence"), "source_module", "target_module").select("source_module", "target_module", "evidence").limit(160)


@query("G8_lineage", _REACH.format(here="source_id", there="target_id", depth=2) + ", up(start, node, depth) as (select id, id, 0 from seeds union select w.start, e.source_id, w.depth + 1 from up w join fx_call_edges e on e.target_id = w.node where w.depth < 2) select start, node from walk union select start, node from up", "fx_call_edges", "fx_parts")
def _(g):
    down = traverse.ordered_bfs(_seeds(g), g.edges, "out", 2).select("start", "node")
    return down.unionByName(traverse.ordered_bfs(_seeds(g), g.edges, "in", 2).select("start", "node")).distinct()


@query("S12_cache_retention", "select cache_key from (select *, sum(bytes) over (order by saved_at desc, scope, cache_key rows unbounded preceding) as running from (select *, row_number() over (partition by scope order by saved_at desc, cache_key) as n from (select event_type as scope, event_id as cache_key, ts as saved_at, cast(event_id % 97 as bigint) as bytes from events) e) t where n <= 8) u where running <= 1000")
def _(g):
    from ..sources.workspace import retained

    shots = g["events"].select(F.col("event_type").alias("scope"), F.col("event_id").alias("cache_key"), F.col("ts").alias("saved_at"), (F.col("event_id") % 97).cast("long").alias("bytes"))
    return retained(shots, 8, 1000).select("cache_key")


@query("X_documents_as_sources")
def _(g):
    """X9-X11 over every document taken for a Python file: each becomes facts or a diagnostic."""
    from ..operators.extract import extract

    files = g["documents"].select(F.concat(F.lit("/ws/"), F.col("doc_id"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.col("text").alias("content"))
    return extract(files).groupBy("fact", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("ST_sessions", "with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as before, event_id from events), s as (select *, sum(case when before is null or ts - before >= interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from e) select user_id, min(ts) as start_ts, count(*) as n from s group by user_id, k")
def _(g):
    grouped = g["events"].groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("start_ts"), "n")


@query("J16_without_orphans", "select id, kind from fx_nodes n where kind <> 'external' or exists (select 1 from fx_call_edges e where e.target_id = n.id or e.source_id = n.id)", *NE)
def _(g):
    return views.without_orphans(g.nodes, g.edges).select("id", "kind")


@query("J21_at_cursor", "select id from fx_parts where file_path = '/ws/economy/brand2/p0.py' and start_line <= 3 and end_line >= 3 order by start_line <> 3, end_line - start_line, id limit 1", "fx_parts")
def _(g):
    return views.at_cursor(g["fx_parts"], "/ws/economy/brand2/p0.py", 3).select("id")


@query("J22_origins", _BOUND + " select distinct unit_id from bound where function_id in (select source_id from fx_call_edges)", "fx_units", "fx_parts", "fx_call_edges")
def _(g):
    return _bound(g).join(g.edges.select("source_id"), F.col("function_id") == F.col("source_id"), "left_semi").select("unit_id").distinct()


@query("K15_boundary_functions", _LOCATED + " select source_module, source_id, count(*) as degree from located where source_module is not null and coalesce(target_module <> source_module, true) group by 1, 2", *MOD)
def _(g):
    return views.boundary_functions(_located(g))


@query("G10_call_tree", _CALLS + """, o as (select source_id as id, count(distinct related_id) as n_out, array_to_string(list_slice(list_sort(list_distinct(list(related_id))), 1, 3), ',') as callees from calls group by 1),
    i as (select related_id as id, count(distinct source_id) as n_in, array_to_string(list_slice(list_sort(list_distinct(list(source_id))), 1, 3), ',') as callers from calls group by 1)
    select coalesce(o.id, i.id) as id, coalesce(n_out, 0) as n_out, coalesce(callees, '') as callees, coalesce(n_in, 0) as n_in, coalesce(callers, '') as callers from o full join i on o.id = i.id""", *NE)
def _(g):
    return views.call_tree(_calls(g))


@query("D15_drill_targets", _CALLS + ", per as (select source_id, related_id, count(*) as callsites from calls where source_id <> related_id group by 1, 2), r as (select *, row_number() over (partition by source_id order by callsites desc, related_id) as position, count(*) over (partition by source_id) as total from per) select source_id, related_id, callsites, position, greatest(total - 2, 0) as omitted from r where position <= 2", *NE)
def _(g):
    return views.direct_callees(_calls(g), 2)


@query("U6_canonical_edges", "select source_id, id, target_id from (select *, row_number() over (partition by source_id order by target_id, id) as n from fx_call_edges) t where n = 1", "fx_call_edges")
def _(g):
    return views.canonical(g.edges.select("source_id", "id", "target_id"), "source_id", [F.asc("target_id"), F.asc("id")])


@query("U3_distinct_sorted", "select confidence, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds, count(distinct source_id) as sources from fx_call_edges group by 1", "fx_call_edges")
def _(g):
    return g.edges.groupBy("confidence").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count_distinct("source_id").alias("sources"))


@query("W6_first_values", "select distinct file_path, first_value(name) over (partition by file_path order by start_line, id) as first_name from fx_parts", "fx_parts")
def _(g):
    return g["fx_parts"].groupBy("file_path").agg(F.min_by("name", F.struct("start_line", "id")).alias("first_name"))


@query("D5_nearest_uses", "select function_id, binding, block_id as \"read\", nearest from (select *, lag(block_id) over (partition by function_id, binding order by block_id) as nearest from fx_blocks) t where access = 'read' and nearest is not null", "fx_blocks")
def _(g):
    return views.nearest_uses(g["fx_blocks"])


@query("D3_flows_of_a_binding", "select function_id, block_id from fx_blocks b where binding = 1 and access = 'define' and exists (select 1 from fx_block_edges e where e.function_id = b.function_id and e.src = b.block_id and e.kind not in ('defines', 'deferred'))", "fx_blocks", "fx_block_edges")
def _(g):
    run = dataflow.runtime_edges(g["fx_block_edges"]).select(F.col("function_id").alias("f"), "src")
    b = g["fx_blocks"].filter("binding = 1 AND access = 'define'")
    return b.join(run, (F.col("function_id") == F.col("f")) & (F.col("block_id") == F.col("src")), "left_semi").select("function_id", "block_id")


@query("G3_subgraph_counts", "select n.kind, count(*) as nodes, count(distinct file_path) as files from fx_nodes n where n.id in (select source_id from fx_call_edges union select target_id from fx_call_edges) group by 1", *NE)
def _(g):
    ids = g.edges.select(F.col("source_id").alias("n")).union(g.edges.select("target_id")).distinct()
    return g.nodes.join(ids, F.col("id") == F.col("n"), "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"))


@query("G6_symbol_flow", _REACH.format(here="source_id", there="target_id", depth=3) + ", best as (select start, node, min(depth) as depth from walk group by 1, 2) select start, count(*) as nodes, max(depth) as depth from best group by 1", "fx_call_edges", "fx_parts")
def _(g):
    return traverse.ordered_bfs(_seeds(g), g.edges, "out", 3).groupBy("start").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


@query("F16_range_spans", "select id, (end_line - start_line) * 1000000 as span from fx_parts", "fx_parts")
def _(g):
    zero = F.lit(0)
    return g["fx_parts"].select("id", S.range_span(F.col("start_line"), zero, F.col("end_line"), zero).alias("span"))


@query("F1_F2_normalise", "select id, lower(trim(name)) as name, replace(file_path, '/', '/') as path from fx_parts", "fx_parts")
def _(g):
    return g["fx_parts"].select("id", S.normalise_text(F.col("name")).alias("name"), S.forward_slashes(F.replace(F.col("file_path"), F.lit("/"), F.lit("\\"))).alias("path"))


@query("K18_primary_path", "select framework, id, score from (select framework, id, end_line - start_line as score from fx_units order by score desc, framework, id limit 1) t", "fx_units")
def _(g):
    return g["fx_units"].select("framework", "id", (F.col("end_line") - F.col("start_line")).alias("score")).orderBy(F.desc("score"), "framework", "id").limit(1)


@query("K19_scope_order", "select framework, count(*) as n from fx_units group by 1 order by n desc, framework limit 3", "fx_units")
def _(g):
    return g["fx_units"].groupBy("framework").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "framework").limit(3)
