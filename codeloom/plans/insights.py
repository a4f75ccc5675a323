"""Queries of the composed operators: file graph, records, semantic flows, risks, layers, condensation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import binding, components, dataflow, files, flows, index, layers, ownership, selection, traverse, views
from ..sources import workspace
from .fixtures import Graph
from .registry import _BOUND, _CALLS, _FAN, _LOCATED, _OWN, _RANK, MOD, NE, _calls, _located, _owner, _seeds, query

_NAMES = "['exact', 'resolved', 'inferred', 'unresolved']"


# --- files and imports ---------------------------------------------------------------------------

_LANGUAGE = "case regexp_extract(lower(path), '\\.([^./]*)$', 1) " + " ".join(f"when '{e}' then '{lang}'" for e, lang in workspace.LANGUAGES.items()) + " end"
_EXCLUDED = "regexp_matches(path, '(^|/)(" + "|".join(d.replace(".", "\\.") for d in workspace.EXCLUDED_DIRECTORIES) + ")/')"
_SCORE = "case " + " ".join(f"when regexp_matches(path, '{p}') then {s}" for s, p in files.ENTRY_SCORES) + " else 0 end"
_NON_APPLICATION = " or ".join(f"regexp_matches(path, '{p}')" for p in files.NON_APPLICATION)
_ROOTS = "roots as (select path from fx_files where path in (select source from fx_imports) and path not in (select target from fx_imports))"


@query("S1_S2_S3_source_files", f"select path, {_LANGUAGE} as language, {_EXCLUDED} as excluded from fx_files", "fx_files")
def _(g):
    return g["fx_files"].select("path", workspace.language_of(F.col("path")).alias("language"), workspace.excluded(F.col("path")).alias("excluded"))


@query("S4_S5_found_files", "select path from fx_files where regexp_matches(path, '^(.*/)?[^/]*\\.(ts|py)$') and not regexp_matches(path, '^node_modules/.*$') order by path limit 10000", "fx_files")
def _(g):
    return workspace.find_source_files(g["fx_files"], "**/*.{ts,py}", "node_modules/**")


@query("P15_non_application_paths", f"select path from fx_files where {_NON_APPLICATION}", "fx_files")
def _(g):
    return g["fx_files"].filter(files.non_application(F.col("path")))


@query("K20_entry_scores", f"select path, {_SCORE} as score from fx_files", "fx_files")
def _(g):
    return g["fx_files"].select("path", files.entry_score(F.col("path")).alias("score"))


# Scored files that nothing imports; if there are none, the roots with most imports, where possible such of an application.
_ENTRIES = f"""{_ROOTS}, scored as (select * from (select path, {_SCORE} as score from fx_files) t where score > 0 and path not in (select target from fx_imports)),
  own as (select path from roots where not ({_NON_APPLICATION})), chosen as (select path from own union all select path from roots where not exists (select 1 from own)),
  degree as (select source, count(*) as n from fx_imports group by 1), ordered as (select path, row_number() over (order by coalesce(n, 0) desc, path) as k from chosen left join degree on source = path),
  entries as (select path, score from scored union all select path, 0 from ordered where k <= 24 and not exists (select 1 from scored))"""


@query("K20_entry_files", f"with {_ENTRIES} select path, score from entries", "fx_files", "fx_imports")
def _(g):
    return files.application_entries(g["fx_files"], g["fx_imports"])


@query("J6_roots", f"with {_ROOTS} select path from roots", "fx_files", "fx_imports")
def _(g):
    return files.import_roots(g["fx_files"], g["fx_imports"])


@query(
    "A32_import_summary",
    f"""with {_ENTRIES} select count(*) as import_edges, count(distinct source) as importer_files, count(distinct case when target in (select path from fx_files) then target end) as imported_files,
    count(*) filter (where target not in (select path from fx_files)) as external_imports, (select count(*) from fx_files) as file_nodes,
    (select count(*) from entries) as application_entrypoints, (select count(*) from roots) as entry_roots from fx_imports""",
    "fx_files",
    "fx_imports",
)
def _(g):
    return files.import_summary(g["fx_files"], g["fx_imports"])


@query("A32_root_directories", f"with {_ROOTS} select case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as path, count(*) as count from roots group by 1 order by count desc, path limit 12", "fx_files", "fx_imports")
def _(g):
    return files.root_directories(files.import_roots(g["fx_files"], g["fx_imports"]))


@query(
    "J23_resolved_imports",
    """with spec as (select distinct source, case when regexp_replace(source, '/[^/]*$', '') = regexp_replace(target, '/[^/]*$', '') and contains(source, '/') then concat('./', regexp_replace(regexp_extract(target, '[^/]*$'), '\\.[^.]*$', ''))
      when ends_with(target, '.py') then replace(regexp_replace(target, '\\.py$', ''), '/', '.') else target end as specifier from fx_imports),
    py as (select path, regexp_replace(path, '(/__init__)?\\.py$', '') as module from fx_files where ends_with(path, '.py')),
    dotted as (select s.source, s.specifier, min(path) as target from spec s join py on replace(module, '/', '.') = specifier or ends_with(replace(module, '/', '.'), concat('.', specifier)) where not starts_with(specifier, '.') group by 1, 2 having count(*) = 1),
    ending(rank, e) as (values (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '/index.ts'), (7, '/index.tsx'), (8, '/index.js'), (9, '/__init__.py')),
    direct as (select source, specifier, min_by(path, rank) as target from spec, ending, fx_files where starts_with(specifier, './') and path = concat(regexp_replace(source, '/[^/]*$', ''), substr(specifier, 2), e) group by 1, 2)
    select s.source, s.specifier, coalesce(direct.target, case when dotted.target <> s.source then dotted.target end) as target from spec s left join direct using (source, specifier) left join dotted using (source, specifier)""",
    "fx_files",
    "fx_imports",
)
def _(g):
    source, target = F.col("source"), F.col("target")
    name = F.regexp_replace(F.regexp_extract(target, "[^/]*$", 0), r"\.[^.]*$", "")
    same = (S.parent_path(source) == S.parent_path(target)) & F.contains(source, F.lit("/"))
    spec = F.when(same, F.concat(F.lit("./"), name)).when(F.endswith(target, F.lit(".py")), F.replace(F.regexp_replace(target, r"\.py$", ""), F.lit("/"), F.lit("."))).otherwise(target)
    return files.resolve_imports(g["fx_imports"].select("source", spec.alias("specifier")), g["fx_files"])


# --- function index --------------------------------------------------------------------------------

_LABEL = "coalesce(nullif(trim(call_name), ''), nullif(trim(call_expression), ''), nullif(target_id, ''), 'unresolved call')"


@query("P5_missing_labels", _CALLS + f" select id, {_LABEL} as label from calls where is_unresolved", *NE)
def _(g):
    return _calls(g).filter("is_unresolved").select("id", index.missing_label(F.col("call_name"), F.col("call_expression"), F.col("target_id")).alias("label"))


@query(
    "P4_records",
    _CALLS + f""", lost as (select related_id as id, min_by(coalesce(nullif(n.name, ''), {_LABEL}), c.id) as name from calls c left join fx_nodes n on n.id = c.target_id where is_unresolved group by 1)
    select id, kind, name, coalesce(nullif(qualified_name, ''), name) as qualified_name, 'unknown' as role, 'exact' as confidence from fx_nodes where kind in ('function', 'method', 'constructor')
    union all select id, 'external', coalesce(nullif(name, ''), nullif(qualified_name, ''), 'external'), coalesce(nullif(qualified_name, ''), nullif(name, ''), 'external'), 'external', 'resolved' from fx_nodes where id in (select related_id from calls where is_external)
    union all select id, 'unresolved', name, concat('unresolved:', name), 'unresolved', 'unresolved' from lost""",
    *NE,
)
def _(g):
    return index.records(g.nodes, _calls(g))


_PARSER = "contains(lower(code), 'parse') or contains(lower(code), 'syntax') or contains(lower(message), 'parse')"
_SKIPPED = "contains(lower(code), 'exclude') or contains(lower(code), 'skip') or contains(lower(message), 'excluded')"


@query("P13_diagnostics", f"select id, ({_PARSER}) as parser_failure, ({_SKIPPED}) as excluded_file from fx_diagnostics", "fx_diagnostics")
def _(g):
    code, message = F.col("code"), F.col("message")
    return g["fx_diagnostics"].select("id", index.is_parser_failure(code, message).alias("parser_failure"), index.is_excluded_file(code, message).alias("excluded_file"))


@query("A3_summary", _CALLS + """ select (select count(*) from fx_nodes where kind in ('function', 'method', 'constructor')) as callables, count(*) as call_edges, count(*) filter (where is_external) as external_calls, count(*) filter (where is_unresolved) as unresolved_calls,
    count(*) filter (where confidence = 'inferred') as inferred_edges, count(distinct case when is_external then related_id end) as external_targets, count(distinct case when is_unresolved then related_id end) as unresolved_targets from calls""", *NE)
def _(g):
    return index.summary(g.nodes, _calls(g))


@query(
    "A3_I1_index_summary",
    _FAN + f""", c as (select count(*) as call_edges, count(distinct case when is_external then related_id end) as external_callables, count(distinct case when is_unresolved then related_id end) as unresolved_callables, count(*) filter (where is_external) as external_call_edges,
      count(*) filter (where is_unresolved) as unresolved_call_edges, count(*) filter (where confidence = 'inferred') as inferred_call_edges from calls), f as (select count(*) as concrete, count(*) filter (where callers = 0 and callees > 0) as visible from fan),
    d as (select count(*) filter (where {_PARSER}) as parser_failures, count(*) filter (where {_SKIPPED}) as excluded_files from fx_diagnostics)
    select c.*, concrete + external_callables + unresolved_callables as callables, visible, concrete + external_callables + unresolved_callables - visible as hidden, parser_failures, excluded_files from c, f, d""",
    *NE,
    "fx_diagnostics",
)
def _(g):
    return index.full_summary(g.nodes, _calls(g), g["fx_diagnostics"])


@query("A27_distinct_smallest", "select source_id, array_to_string(list_slice(list_sort(list_distinct(list(target_id))), 1, 8), ',') as targets, count(distinct target_id) as n from fx_call_edges group by 1", "fx_call_edges")
def _(g):
    return selection.smallest_values(g.edges, ["source_id"], "target_id", 8, "t").select("source_id", F.array_join("t", ",").alias("targets"), "n")


@query("A30_area_counts", "select split_part(file_path, '/', 3) as area, count(distinct file_path) as files, count(*) as callables, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 3), ',') as representatives from fx_parts group by 1", "fx_parts")
def _(g):
    parts = g["fx_parts"].withColumn("area", F.split_part("file_path", F.lit("/"), F.lit(3)))
    counted = parts.groupBy("area").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("callables"))
    return counted.join(selection.smallest_values(parts, ["area"], "name", 3, "r"), "area").select("area", "files", "callables", F.array_join("r", ",").alias("representatives"))


@query("K21_bounded_labels", "select source_id, array_to_string(case when len(t) > 3 then list_concat(list_slice(t, 1, 2), [concat(len(t) - 2, ' additional')]) else t end, ',') as labels from (select source_id, list_sort(list_distinct(list(target_id))) as t from fx_call_edges group by 1) u", "fx_call_edges")
def _(g):
    first = selection.smallest_values(g.edges, ["source_id"], "target_id", 3, "t")
    return first.select("source_id", F.array_join(selection.bounded_labels(F.col("t"), 3, F.col("n")), ",").alias("labels"))


# --- modules -----------------------------------------------------------------------------------------

_ALL_LOCATED = _OWN + """, homes as (select id, module from fx_nodes left join owner on file_path = path),
located as (select e.*, s.module as source_module, t.module as target_module from fx_edges e left join homes s on s.id = e.source_id left join homes t on t.id = e.target_id)"""
_ALL_RELATED = _ALL_LOCATED + """, related as (select source_module, target_module, kind, count(*) as evidence, count(*) filter (where confidence = 'exact') as exact, count(*) filter (where confidence = 'resolved') as resolved, count(*) filter (where confidence = 'inferred') as inferred, count(*) filter (where confidence = 'unresolved') as unresolved,
  array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') as representatives, greatest(count(*) - 5, 0) as omitted from located where source_module <> target_module group by 1, 2, 3)"""
ALL = ("fx_nodes", "fx_edges", "fx_boundaries")
_KINDS = ", ".join(f"count(*) filter (where kind = '{k}') as \"{k}\"" for k in ownership.INTERNAL_KINDS)


def _all_located(g: Graph):
    return ownership.module_edges(g.nodes, g["fx_edges"], _owner(g))


@query("A14_module_relations", _ALL_RELATED + " select * from related", *ALL)
def _(g):
    return ownership.relations(_all_located(g))


@query("A15_internal_relations", _ALL_LOCATED + f" select source_module as module, {_KINDS} from located where source_module = target_module group by 1", *ALL)
def _(g):
    return ownership.internal_counts(_all_located(g))


_MERGE = "select regexp_replace(file_path, '/[^/]*$', '') as root, lower(framework) as ecosystem, framework as name, split_part('inferred;resolved;exact;unresolved', ';', cast(start_line % 4 as int) + 1) as confidence, file_path as path, kind as evidence from fx_units"


def _found_frameworks(g: Graph):
    confidence = F.element_at(F.array(*map(F.lit, ("inferred", "resolved", "exact", "unresolved"))), (F.col("start_line") % 4 + 1).cast("int"))
    return g["fx_units"].select(S.parent_path(F.col("file_path")).alias("root"), F.lower("framework").alias("ecosystem"), F.col("framework").alias("name"), confidence.alias("confidence"), F.col("file_path").alias("path"), F.col("kind").alias("evidence"))


@query("A19_A20_merged_evidence", f"with found as ({_MERGE}) select root, ecosystem, name, {_NAMES}[min({_RANK}) + 1] as confidence, min(path) as path, string_agg(distinct evidence, ',' order by evidence) as evidence from found group by 1, 2, 3", "fx_units")
def _(g):
    return ownership.merged_evidence(_found_frameworks(g))


@query("A23_preferred_roots", f"with found as ({_MERGE}) select name, min_by(root, ({_RANK}, len(string_split(root, '/')), root)) as root, count(*) as roots from found group by 1", "fx_units")
def _(g):
    return ownership.preferred_roots(_found_frameworks(g))


@query(
    "K13_module_scores",
    _LOCATED + """, kept as (select root_key, min_by(basis, case basis when 'workspacePackage' then 1 when 'frameworkRoot' then 2 when 'sourceArea' then 3 else 4 end) as basis from fx_boundaries group by 1),
    direct as (select module, count(*) as callables from fx_nodes join owner on file_path = path where kind in ('function', 'method', 'constructor') group by 1),
    rolled as (select k.root_key as module, coalesce(sum(callables), 0) as n from kept k left join direct d on d.module = k.root_key or starts_with(d.module, concat(k.root_key, '/')) group by 1),
    o as (select source_module as m, count(*) as n from located where source_module <> target_module group by 1), i as (select target_module as m, count(*) as n from located where source_module <> target_module group by 1),
    u as (select module as m, count(*) as n from fx_units join owner on file_path = path where kind in ('route', 'operation') group by 1)
    select k.root_key as module, cast(case basis when 'workspacePackage' then 10000 when 'frameworkRoot' then 8000 when 'sourceArea' then 6000 when 'workspaceRoot' then 4000 else 0 end + coalesce(u.n, 0) * 100 + coalesce(o.n, 0) + coalesce(i.n, 0) + rolled.n as bigint) as score
    from kept k join rolled on rolled.module = k.root_key left join o on o.m = k.root_key left join i on i.m = k.root_key left join u on u.m = k.root_key""",
    *MOD,
    "fx_units",
)
def _(g):
    return _module_scores(g)


def _module_scores(g: Graph):
    owner = _owner(g)
    units = ownership.owned(g["fx_units"], owner).select("module", "kind")
    return ownership.module_scores(ownership.boundary_merge(g["fx_boundaries"]), ownership.rollup(g.nodes, owner, g["fx_boundaries"]), _located(g), units)


# A greedy choice; tested against a version by hand.
@query("K13_ancestor_closed_top")
def _(g):
    scored = _module_scores(g)
    return ownership.ancestor_closed_top(scored.select("module", S.parent_path(F.col("module")).alias("parent"), "score"), 10)


@query("K16_boundary_edges", _ALL_RELATED + " select id, kind, evidence from (select concat(source_module, '>', target_module, ':', kind) as id, kind, evidence, case when kind = 'imports' then 0 else 1 end as p from related where kind in ('imports', 'calls')) t order by p, evidence desc, id limit 96", *ALL)
def _(g):
    related = ownership.relations(_all_located(g)).select(F.concat("source_module", F.lit(">"), "target_module", F.lit(":"), "kind").alias("id"), "kind", "evidence")
    return selection.boundary_edges(related.filter("kind = 'imports'"), related.filter("kind = 'calls'"), 96)


# --- flows and risks ---------------------------------------------------------------------------------

_PLACE = "case evidence when 'contains' then 0 else 2 end"
_FLOWS = _BOUND + f""", target as (select source_id as route_id, target_id as unit_id, min({_RANK}) as r from fx_unit_edges where kind = 'routesTo' and target_id in (select id from fx_units) group by 1, 2),
  entry as (select id as entry_id, kind as entry_kind, framework, file_path as entry_path, start_line as entry_line from fx_units where kind in ('route', 'operation')),
  candidate as (select entry_id, function_id, {_PLACE} as r, 0 as via from entry join bound on unit_id = entry_id
    union all select entry_id, function_id, greatest(t.r, {_PLACE}), 1 from entry join target t on route_id = entry_id and entry_kind = 'route' join bound b on b.unit_id = t.unit_id),
  once as (select entry_id, function_id, min((via, r)) as a from candidate group by 1, 2), low as (select entry_id, min(a) as l from once group by 1),
  per as (select entry_id, count(*) as candidates, min(function_id) as first_id, min(a) as a from once join low using (entry_id) where a = l group by 1),
  routed as (select route_id as entry_id, count(*) as target_units, max(r) as weakest from target where route_id in (select entry_id from entry where entry_kind = 'route') group by 1),
  flow as (select e.*, case when candidates is null then 'handlerNotMapped' when candidates > 1 then 'ambiguous' else 'mapped' end as status, case when candidates = 1 then first_id end as handler_id, coalesce(candidates, 0) as candidates, coalesce(target_units, 0) as target_units, case when candidates is null then weakest else a[2] end as r
    from entry e left join per using (entry_id) left join routed using (entry_id))"""
_FLOW_TABLES = ("fx_units", "fx_parts", "fx_unit_edges")
# All steps below handlers with their depth, and the strongest edge of each step's first parent.
_STEPS = _FLOWS.replace("with bound", "with recursive bound", 1) + f""", concrete as (select id from fx_nodes where kind in ('function', 'method', 'constructor')),
  walk(start, node, depth) as (select distinct handler_id, handler_id, 0 from flow where handler_id is not null union select w.start, e.target_id, w.depth + 1 from walk w join fx_call_edges e on e.source_id = w.node where w.depth < 3 and (w.depth = 0 or w.node in (select id from concrete))),
  reached as (select start, node, min(depth) as depth from walk group by 1, 2)"""
_STEP_TABLES = (*_FLOW_TABLES, *NE)


def _flows(g: Graph):
    return flows.semantic_flows(g["fx_units"], binding.place_bindings(g["fx_units"], binding.places(g["fx_parts"])), g["fx_unit_edges"])


@query("J12_J13_I3_entrypoint_flows", _FLOWS + f" select entry_id, entry_kind, framework, status, handler_id, candidates, target_units, {_NAMES}[r + 1] as confidence from flow", *_FLOW_TABLES)
def _(g):
    return _flows(g).select("entry_id", "entry_kind", "framework", "status", "handler_id", "candidates", "target_units", S.confidence_name(F.col("rank")).alias("confidence"))


@query(
    "A13_flow_summary",
    _FLOWS + """ select count(*) as entrypoints, count(*) filter (where entry_kind = 'route') as routes, count(*) filter (where entry_kind = 'operation') as operations, count(*) filter (where status = 'mapped') as mapped, count(*) filter (where status = 'ambiguous') as ambiguous,
    count(*) filter (where status = 'ambiguous' and entry_kind = 'route') as ambiguous_routes, count(*) filter (where status = 'ambiguous' and entry_kind = 'operation') as ambiguous_operations, count(*) filter (where status = 'handlerNotMapped') as not_mapped from flow""",
    *_FLOW_TABLES,
)
def _(g):
    return flows.flow_summary(_flows(g))


@query("I3_W5_flow_gaps", _STEPS + """, gap as (select r.start, count(*) filter (where depth > 0) as n, coalesce(bool_or(depth = 3 and node in (select id from concrete) and exists (select 1 from fx_call_edges e where e.source_id = r.node and not exists (select 1 from reached q where q.start = r.start and q.node = e.target_id))), false) as leads_on from reached r group by 1)
    select entry_id, least(n, 8) as steps, greatest(n - 8, 0) as omitted, n > 8 as step_gap, leads_on and n <= 8 as depth_gap from flow join gap on start = handler_id""", *_STEP_TABLES)
def _(g):
    return flows.flow_steps(_flows(g), g.nodes, g.edges, 3, 8)[1]


@query("A25_entrypoint_coverage", _FLOWS + "," + _OWN[5:] + f""" select framework, coalesce(module, '') as root, count(*) filter (where status = 'ambiguous') as ambiguous, count(*) filter (where status = 'handlerNotMapped') as not_mapped, count(*) as evidence, count(distinct entry_id) as affected, {_NAMES}[max(r) + 1] as confidence,
    min((entry_path, entry_line))[1] as location, min((entry_path, entry_line))[2] as line from flow left join owner on entry_path = path where status <> 'mapped' group by 1, 2""", *_FLOW_TABLES, *MOD)
def _(g):
    return flows.entrypoint_risks(_flows(g), _owner(g).withColumnRenamed("module", "root"))


# At depth 1 every step's parent is the handler, so the calling function and its strongest edge are plain.
@query("A26_unresolved_by_source", _FLOWS + f""", step as (select entry_id, e.source_id, e.target_id, min_by(e.id, ({_RANK.replace('confidence', 'e.confidence', 1)}, e.start_line, e.id)) as edge_id, min({_RANK.replace('confidence', 'e.confidence', 1)}) as r from flow join fx_call_edges e on e.source_id = handler_id where e.target_id <> handler_id group by 1, 2, 3)
    select source_id, count(distinct edge_id) as evidence, count(distinct entry_id) as affected, {_NAMES}[max(r) + 1] as confidence from step where r = 3 or target_id not in (select id from fx_nodes) group by 1""", *_STEP_TABLES)
def _(g):
    return flows.unresolved_risks(flows.flow_steps(_flows(g), g.nodes, g.edges, 1, 1_000_000)[0])


# The walk's order of parents is not SQL's; tested on a small graph by hand.
@query("I7_risk_radar")
def _(g):
    flow = _flows(g)
    steps, gaps = flows.flow_steps(flow, g.nodes, g.edges)
    by_entry = flows.entrypoint_risks(flow, _owner(g).withColumnRenamed("module", "root"))
    return flows.risk_radar(flows.analysis_risk(g["fx_diagnostics"], gaps), by_entry, flows.with_sources(flows.unresolved_risks(steps), steps, g.nodes))


# --- layers --------------------------------------------------------------------------------------------


def _words(words) -> str:
    return "list_has_any(p, [" + ", ".join(f"'{w}'" for w in words) + "])"


_TEST = " or ".join([_words(layers.TEST_DIRECTORIES), *[f"regexp_matches(p[-1], '{x}')" for x in layers.TEST_FILE_NAMES]])
_LAYERS = f"""with parts as (select id, list_filter(string_split(lower(path), '/'), lambda x: x <> '') as p, lower(path) as low from fx_part_files),
  by_path as (select id, case when {_TEST} then 'test' when regexp_extract(concat('/', low), '.*/adapters/([^/]*)', 1) = 'in' then 'interface' when regexp_extract(concat('/', low), '.*/adapters/([^/]*)', 1) = 'out' then 'infrastructure'
    when list_contains(p, 'domain') then 'domain' when {_words(layers.APPLICATION_DIRECTORIES)} then 'application' when {_words(layers.DATA_DIRECTORIES)} then 'dataAccess' when {_words(layers.INTERFACE_DIRECTORIES)} then 'interface'
    when {_words(layers.CROSS_CUTTING_DIRECTORIES)} then 'crossCutting' when {_words(layers.INFRASTRUCTURE_DIRECTORIES)} then case when list_has_any(p, ['repository', 'repositories']) then 'dataAccess' else 'infrastructure' end end as layer,
    list_contains(p, 'domain') and regexp_matches(low, '(^|/)domain/(.*/)?(ports|repositories)(/|$)') as port from parts),
  evidence as (select id, layer from by_path where layer is not null union select function_id, l from (select function_id, case when unit_kind in ('route', 'operation', 'controller', 'view', 'serializer', 'component', 'command') then 'interface' when unit_kind = 'service' then 'application' when unit_kind in ('repository', 'model', 'entity') then 'dataAccess' end as l from bound) t
    where l is not null and function_id not in (select id from by_path where layer = 'test')),
  merged as (select b.id, b.port and coalesce(b.layer = 'domain', false) as port, count(distinct e.layer) as n, min(e.layer) as layer from by_path b left join evidence e on e.id = b.id group by 1, 2),
  assessed as (select id, case when n = 1 then layer else 'unclassified' end as layer, n > 1 as conflicted, case when port then 'notBusinessLogic' when n = 1 and layer = 'domain' then 'domainRuleCandidate' when n = 1 and layer = 'application' then 'applicationWorkflowCandidate' end as business from merged)"""
_LAYERS = _BOUND + "," + _LAYERS[4:]
_LAYER_TABLES = ("fx_units", "fx_parts", "fx_part_files")


def _assessed(g: Graph):
    return layers.assess(g["fx_part_files"].withColumnRenamed("path", "file_path"), binding.place_bindings(binding.unit_places(g["fx_units"]), g["fx_parts"]))


@query("I6_layers", _LAYERS + " select * from assessed", *_LAYER_TABLES)
def _(g):
    return _assessed(g)


@query("A31_layer_summary", _LAYERS + " select count(*) as callables, count(*) filter (where layer <> 'unclassified') as classified, count(*) filter (where business in ('domainRuleCandidate', 'applicationWorkflowCandidate')) as business, count(*) filter (where conflicted) as conflicted from assessed", *_LAYER_TABLES)
def _(g):
    return layers.layer_summary(_assessed(g))


# --- condensation and ranks ------------------------------------------------------------------------------

_SCC = """with recursive e as (select distinct source_id as s, target_id as t from fx_call_edges), reach(a, b) as (select s, t from e union select r.a, e.t from reach r join e on r.b = e.s),
  node as (select s as n from e union select t from e), mate as (select r.a, r.b from reach r join reach q on r.a = q.b and r.b = q.a),
  member as (select n as node, least(n, coalesce(min(b), n)) as component, exists (select 1 from e where s = n and t = n) as loop from node left join mate on a = n group by 1),
  size as (select component, count(*) as size, count(*) > 1 or bool_or(loop) as cyclic from member group by 1),
  between as (select distinct x.component as s, y.component as t from e join member x on x.node = s join member y on y.node = t where x.component <> y.component)"""


@query("C1_condensation", _SCC + " select node, component, size, cyclic from member join size using (component)", "fx_call_edges")
def _(g):
    return components.condensation(g.edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))[0]


@query("C2_longest_path_ranks", _SCC + ", walk(c, r) as (select distinct component, 0 from member union select t, r + 1 from walk join between on s = c), top as (select c, max(r) as r from walk group by 1) select node, component, r as \"rank\" from member join top on c = component", "fx_call_edges")
def _(g):
    return components.longest_path_ranks(g.edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))


@query("C4_forward_ranks", "with recursive walk(f, b, r) as (select function_id, block_id, 0 from fx_blocks union select w.f, e.dst, w.r + 1 from walk w join fx_block_edges e on e.function_id = w.f and e.src = w.b and e.kind <> 'repeat' and e.src <> e.dst) select f as function_id, b as block_id, max(r) as \"rank\" from walk group by 1, 2", "fx_blocks", "fx_block_edges")
def _(g):
    return components.forward_ranks(g["fx_blocks"], g["fx_block_edges"])


# The order of a rank follows from the ranks before it, one after the other; tested by hand.
@query("C3_A35_rank_order")
def _(g):
    ranks = components.forward_ranks(g["fx_blocks"], g["fx_block_edges"]).select(F.col("function_id").alias("scene"), F.col("block_id").alias("node"), "rank")
    return components.rank_order(ranks, g["fx_block_edges"].filter("kind = 'next'").select(F.col("function_id").alias("scene"), "src", "dst"))


@query("G1_allowed_edges", "with recursive seeds as (select id from fx_parts where cast(substr(id, 6) as bigint) % 50 = 0), walk(start, node, depth) as (select id, id, 0 from seeds union select w.start, e.target_id, w.depth + 1 from walk w join fx_call_edges e on e.source_id = w.node where w.depth < 2), best as (select start, node, min(depth) as depth from walk group by 1, 2) select start, e.id from best join fx_call_edges e on e.source_id = node where depth < 2", "fx_call_edges", "fx_parts")
def _(g):
    reached = traverse.ordered_bfs(_seeds(g), g.edges, "out", 2)
    return traverse.allowed_edges(reached, g.edges, 2).select("start", "id")


# --- scalars and sources -----------------------------------------------------------------------------------

_PATH = "list_reduce(list_prepend('', string_split(regexp_replace(url, '^[a-z]+://', '/'), '/')), lambda a, x: case when x in ('', '.') then a when x = '..' then regexp_replace(a, '/[^/]*$', '') else concat(a, '/', x) end)"


@query("F5_F6_paths", f"select page_id, coalesce(nullif({_PATH}, ''), '/') as path, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) as depth from pages")
def _(g):
    key = S.path_key(F.regexp_replace("url", "^[a-z]+://", "/"))
    return g["pages"].select("page_id", key.alias("path"), S.path_depth(key).alias("depth"))


@query("F8_uri_component", "select page_id, replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') as encoded from pages")
def _(g):
    return g["pages"].select("page_id", S.encode_uri_component(F.col("url")).alias("encoded"))


_GRAPHQL = "concat(split_part('Query;mutation;Subscription;type;', ';', cast(start_line / 10 % 5 as int) + 1), '.', name)"


@query("F15_graphql", f"select id, case when lower(split_part({_GRAPHQL}, '.', 1)) in ('query', 'mutation', 'subscription') then lower(split_part({_GRAPHQL}, '.', 1)) else 'other' end as operation from (select id, name, cast(floor(start_line / 10) * 10 as int) as start_line from fx_parts) t", "fx_parts")
def _(g):
    head = F.element_at(F.array(*map(F.lit, ("Query", "mutation", "Subscription", "type", ""))), (F.floor(F.col("start_line") / 10) % 5 + 1).cast("int"))
    return g["fx_parts"].select("id", S.graphql_operation(F.concat(head, F.lit("."), F.col("name"))).alias("operation"))


_HOST = " or ".join(f"regexp_matches(t, '{p}')" for p in S.HOST_PATHS)


@query("F13_host_paths", f"with l as (select doc_id, replace(lower(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), '\\', '/') as t from documents) select doc_id, ({_HOST}) as leaks from l")
def _(g):
    return g["documents"].select("doc_id", S.leaks_host_path(F.col("text")).alias("leaks"))


@query("F20_constraints", "select event_id, coalesce(value > 50, false) as gt, value is not null and value <> 0 as truthy, value is null or value = 0 as falsy, user_id is not distinct from 7 as eq, user_id is distinct from 7 as ne, coalesce(value <= 10, false) as lte from (select event_id, case when event_id % 5 = 0 then null when event_id % 7 = 0 then 0 else value end as value, case when event_id % 11 > 0 then user_id end as user_id from events) t")
def _(g):
    value = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, 0).otherwise(F.col("value"))
    e = g["events"].select("event_id", value.alias("value"), F.when(F.col("event_id") % 11 > 0, F.col("user_id")).alias("user_id"))
    bounds = {"gt": ("value", 50), "truthy": ("value", None), "falsy": ("value", None), "eq": ("user_id", 7), "ne": ("user_id", 7), "lte": ("value", 10)}
    return e.select("event_id", *[views.constraint(name, F.col(c), F.lit(b)).alias(name) for name, (c, b) in bounds.items()])


@query(
    "S13_fingerprint",
    """with f as (select url as path, concat_ws('|', url, cast(length(html) as varchar), cast(page_id as varchar), case when page_id % 9 = 0 then sha256(html) else '' end) as line from pages),
    p as (select left(sha256(path), 2) as part, sha256(string_agg(line, ',' order by line)) as digest from f group by 1) select sha256(concat('config', ',', string_agg(part || digest, ',' order by part || digest))) as fingerprint from p""",
)
def _(g):
    pages = g["pages"].select(F.col("url").alias("path"), F.length("html").alias("size"), F.col("page_id").alias("mtime"), F.when(F.col("page_id") % 9 == 0, F.sha2("html", 256)).alias("dirty_hash"))
    return workspace.fingerprint(pages, "config")


@query("S15_supplement", """with base as (select id, kind from fx_nodes where kind <> 'method'), extra as (select id, 'supplement' as kind from fx_nodes where kind in ('method', 'function')),
    edges as (select id, source_id from fx_call_edges where start_line % 2 = 0 union all select id, source_id from fx_call_edges e where start_line % 2 <> 0 and source_id in (select id from extra) and target_id in (select id from extra))
    select 'node' as what, id, kind as detail from base union all select 'node', id, kind from extra where id not in (select id from base) union all select 'edge', id, source_id from edges""", *NE)
def _(g):
    base, extra = g.nodes.filter("kind <> 'method'").select("id", "kind"), g.nodes.filter(F.col("kind").isin("method", "function")).select("id", F.lit("supplement").alias("kind"))
    nodes = workspace.merge_supplement(base, extra).select(F.lit("node").alias("what"), "id", F.col("kind").alias("detail"))
    edges = workspace.merge_supplement_edges(g.edges.filter("start_line % 2 = 0"), g.edges, extra)
    return nodes.unionByName(edges.select(F.lit("edge").alias("what"), "id", F.col("source_id").alias("detail")))


# --- conditions, bodies, scenes ------------------------------------------------------------------------------


@query(
    "D7_condition_cases",
    """with recursive walk(f, g, b, n, vals, way, target, result) as (select function_id, group_id, 1, n, cast([] as varchar[]), cast([] as bigint[]), cast(null as bigint), cast(null as varchar) from fx_conditions where member_index = 0 and n <= 6
      union all select f, g, e.dst, n, list_append(vals, e.kind), list_append(way, e.edge_id), case when e.dst >= 100 then e.dst end, e.kind from walk w join fx_condition_edges e on e.function_id = w.f and e.src = w.b where w.target is null),
    placed as (select *, row_number() over (partition by f, g order by len(way), way, target) as position, count(*) over (partition by f, g) as total from walk where target is not null)
    select f as function_id, g as group_id, position, array_to_string(list_concat(vals, list_transform(range(n - len(vals)), lambda x: 'skipped')), ',') as vals, result, target, greatest(total - 32, 0) as omitted from placed where position <= 32""",
    "fx_conditions",
    "fx_condition_edges",
)
def _(g):
    return dataflow.condition_cases(g["fx_conditions"], g["fx_condition_edges"]).withColumn("vals", F.array_join("values", ",")).drop("values")


@query("D16_body_ancestors", "with recursive up(f, b, a, d) as (select function_id, block_id, cast(floor(block_id / 2) as bigint), 1 from fx_blocks where block_id > 1 union all select f, b, cast(floor(a / 2) as bigint), d + 1 from up where a > 1) select f as function_id, b as block_id, a as ancestor, d as depth from up", "fx_blocks")
def _(g):
    parent = F.when(F.col("block_id") > 1, F.floor(F.col("block_id") / 2))
    return dataflow.body_ancestors(g["fx_blocks"].select("function_id", "block_id", parent.alias("parent_id")))


@query("G9_scene", "select scene, expansion, nodes from (select *, row_number() over w as n, sum(nodes) over (partition by scene order by seen_at desc, expansion rows unbounded preceding) as total from (select user_id % 100 as scene, event_id as expansion, ts as seen_at, event_id % 97 + 1 as nodes from events) e window w as (partition by scene order by seen_at desc, expansion)) t where n = 1 or total <= 500")
def _(g):
    e = g["events"].select((F.col("user_id") % 100).alias("scene"), F.col("event_id").alias("expansion"), F.col("ts").alias("seen_at"), (F.col("event_id") % 97 + 1).alias("nodes"))
    return selection.retained_scene(e)
