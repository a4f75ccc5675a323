"""Queries of call resolution, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import binding, call_resolution, control, dataflow, detection, flows, modules, ownership, reading, traverse, views
from ..operators.lineage import kept, shared_dir
from ..streaming import snapshots
from .fixtures import oracle
from .insights import _flows
from .registry import _SEEDS, ORACLE_SQL, _seeds, query

_ID = "[A-Za-z_$][A-Za-z0-9_$]*"


def _ids(text: str) -> str:
    return f"regexp_extract_all({text}, '{_ID}')"


def _word(code: str, word: str) -> str:
    return f"regexp_extract({code}, '(?:^|[^A-Za-z0-9]){word}(?:$|([^A-Za-z0-9_].*$))', 1)"


_BRACKET = r"'^[^(]*\(([^)]*)\)', 1"
_ARROW = "rtrim(regexp_extract(code, '^(.*?)=>', 1))"
_SCRIPT = "list_distinct(flatten([" + ", ".join(
    [
        *[_ids(f"regexp_extract({_word('code', w)}, '^([^=]*)', 1)") for w in ("const", "let", "var")],
        *[f"list_slice({_ids(_word('code', w))}, 1, 1)" for w in ("function", "class")],
        f"case when contains(code, 'function') then {_ids(f'regexp_extract(code, {_BRACKET})')} else [] end",
        f"case when regexp_matches({_ARROW}, '^[^(]*\\([^)]*\\)') then {_ids(f'regexp_extract({_ARROW}, {_BRACKET})')} else {_ids(_ARROW)} end",
        f"case when starts_with(code, 'catch') then {_ids(f'regexp_extract(code, {_BRACKET})')} else [] end",
        f"case when regexp_matches(code, '^{_ID}\\s*=($|[^=])') then [regexp_extract(code, '^({_ID})', 1)] else [] end",
    ]
) + "]))"
_PYTHON = "list_distinct(flatten([" + ", ".join(
    [
        f"list_slice({_ids("regexp_extract(decl, '^def (.*)$', 1)")}, 1, 1)",
        _ids(f"regexp_extract(regexp_extract(decl, '^def (.*)$', 1), {_BRACKET})"),
        f"list_slice({_ids("regexp_extract(decl, '^class (.*)$', 1)")}, 1, 1)",
        _ids("split_part(regexp_extract(code, '^for (.*)$', 1), ' in ', 1)"),
        f"case when regexp_matches(code, '^(with|except) ') then list_filter(list_transform(list_slice(string_split(code, ' as '), 2, 99), lambda p: regexp_extract(p, '{_ID}')), lambda x: x <> '') else [] end",
        _ids("regexp_extract(code, '^((?:[^=!<>]|[!<>=]=|[<>!][^=])*)=(?:$|[^=])', 1)"),
        f"case when regexp_matches(code, '^{_ID}\\s*:') then [regexp_extract(code, '^({_ID})', 1)] else [] end",
    ]
) + "]))"
#: The fixture has one comment in a string, and no other quotes around slashes.
_BOUND = f"""bare as (select path, line, language, trim(case when contains(code, '''//''') then code else regexp_replace(code, '//.*$', '') end) as code, regexp_replace(code, '^async ', '') as decl from fx_code_lines),
  bound as (select path, line, unnest(case when language = 'python' then (case when regexp_matches(code, '^(import|from) ') then {_ids('code')} else {_PYTHON} end)
    when starts_with(code, 'import ') then {_ids("split_part(code[8:], ' from ', 1)")} else {_SCRIPT} end) as name from bare), names as (select distinct path, line, name from bound)"""


@query("X12_shadowing_lines", f"with {_BOUND} select path, line, name from names", "fx_code_lines")
def _(g):
    return call_resolution.possible_bindings(g["fx_code_lines"]).distinct()


_IMPORTED = f"""with {_BOUND}, single as (select path, local_name, min(import_line) as import_line, min(target_path) as target_path, min(imported_name) as imported_name from fx_named_imports group by 1, 2 having count(*) = 1),
  free as (select * from single s where not exists (select 1 from names n where n.path = s.path and n.name = s.local_name and n.line <> s.import_line)),
  top as (select n.file_path, n.name, min(n.id) as target_id from fx_code_nodes n join fx_code_nodes f on f.kind = 'file' and f.file_path = n.file_path and n.parent_id = f.id where n.kind = 'function' and n.qualified_name = n.name group by 1, 2 having count(*) = 1),
  found as (select e.id, t.target_id from fx_code_edges e join fx_code_nodes x on x.id = e.target_id join fx_code_nodes s on s.id = e.source_id and s.file_path = e.file_path join free i on i.path = e.file_path and i.local_name = x.name
    join top t on t.file_path = i.target_path and t.name = i.imported_name where e.kind = 'calls' and e.confidence = 'unresolved' and x.kind = 'external' and x.name = x.qualified_name and regexp_matches(x.name, '^{_ID}$'))"""


@query("J15_imported_calls", _IMPORTED + " select e.id, e.kind, e.source_id, coalesce(f.target_id, e.target_id) as target_id, case when f.id is null then e.confidence else 'resolved' end as confidence, e.file_path from fx_code_edges e left join found f on f.id = e.id", "fx_code_edges", "fx_code_nodes", "fx_named_imports", "fx_code_lines")
def _(g):
    g.keep("fx_code", "l_orderkey", "ord", "k", "a", "b", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    edges = g["fx_code_edges"]
    return call_resolution.with_resolved_calls(edges, call_resolution.resolve_imported_calls(edges, g["fx_code_nodes"], g["fx_named_imports"], g["fx_code_lines"]))


_SCOPED = """with callable as (select * from fx_scoped_symbols where kind in ('function', 'method', 'constructor')),
  first_of as (select file_path, qualified_name, arg_min(id, (ord, id)) as found from callable group by 1, 2),
  only_one as (select file_path, name, min(id) as found from callable group by 1, 2 having count(*) = 1),
  seen as (select c.*, case when scope = '' then [] else string_split(scope, '.') end as parts from fx_scoped_calls c where not (qualifier is null and exists (select 1 from fx_lexical l where l.source_id = c.source_id and l.name = c.name))),
  prefix as (select *, unnest(range(0, len(parts) + 1)) as k from seen),
  tried as (
    select call_id, file_path, -k as rank, case when k = 0 then name else concat(array_to_string(parts[1:k], '.'), '.', name) end as q from prefix where qualifier is null
    union all select call_id, file_path, -k, concat(array_to_string(parts[1:k], '.'), '.', name) from prefix where k between 1 and len(parts) - 1 and (language = 'python' and qualifier in ('self', 'cls') or language <> 'python' and qualifier = 'this')
    union all select call_id, file_path, case when language = 'python' then 1000 else -1000 end, concat(qualifier, '.', name) from seen where qualifier is not null and not (language <> 'python' and qualifier = 'this')
    union all select call_id, file_path, -k, concat(array_to_string(parts[1:k], '.'), '.', qualifier, '.', name) from prefix where k between 1 and len(parts) - 1 and language <> 'python' and qualifier <> 'this'),
  hit as (select call_id, rank, f.found, 'resolved' as how from tried t join first_of f on f.file_path = t.file_path and f.qualified_name = q
    union all select call_id, 5000, o.found, 'inferred' from seen s join only_one o on o.file_path = s.file_path and o.name = s.name where qualifier is null),
  best as (select call_id, arg_min(found, rank) as found, arg_min(how, rank) as how from hit group by 1)"""


def _resolved(g):
    return call_resolution.resolve_scoped_calls(g["fx_scoped_calls"], g["fx_scoped_symbols"], g["fx_lexical"])


@query("J17_J18_scoped_calls", _SCOPED + " select c.call_id, found as target_id, coalesce(how, 'unresolved') as confidence from fx_scoped_calls c left join best b on b.call_id = c.call_id", "fx_scoped_calls", "fx_scoped_symbols", "fx_lexical")
def _(g):
    return _resolved(g)


# --- callsites and their edges ---------------------------------------------------------------------------

_MATCHED = """with recursive name_of as (select id, name as target_name from fx_site_targets union select id, regexp_replace(qualified_name, '^.*[.]', '') from fx_site_targets),
  fit as (select s.function_id, s.site_id, s.start_line, s.start_character, e.id as edge_id, abs(e.start_line - s.start_line) * 1000000 + abs(e.start_character - s.start_character) as distance, e.start_line as el, e.start_character as ec
    from fx_sites s join fx_site_edges e on e.source_id = s.function_id and e.file_path = s.file_path join name_of n on n.id = e.target_id and n.target_name = s.callee_name
    where (e.start_line, e.start_character) <= (s.end_line, s.end_character) and (s.start_line, s.start_character) <= (e.end_line, e.end_character)),
  choice as (select function_id, site_id, row_number() over (partition by function_id order by start_line, start_character, site_id) as k, list(edge_id order by distance, el, ec, edge_id) as edges from (select distinct * from fit) t group by function_id, site_id, start_line, start_character),
  pick(function_id, k, used, site_id, edge_id) as (
    select distinct function_id, cast(0 as bigint), cast([] as varchar[]), cast(null as varchar), cast(null as varchar) from choice
    union all select c.function_id, c.k, list_append(p.used, list_filter(c.edges, lambda e: not list_contains(p.used, e))[1]), c.site_id, list_filter(c.edges, lambda e: not list_contains(p.used, e))[1]
    from pick p join choice c on c.function_id = p.function_id and c.k = p.k + 1),
  matched as (select p.function_id, p.site_id, p.edge_id, (select min(distance) from fit f where f.site_id = p.site_id and f.edge_id = p.edge_id)::bigint as distance from pick p where edge_id is not null)"""


def _matched(g):
    return binding.matched_callsites(g["fx_sites"], g["fx_site_edges"], g["fx_site_targets"])


@query("J19_matched_callsites", _MATCHED + " select function_id, site_id, edge_id, distance from matched", "fx_sites", "fx_site_edges", "fx_site_targets")
def _(g):
    return _matched(g)


@query("D15_J19_drill_targets", _MATCHED + """, per as (select function_id, target_id, count(*) as callsites from matched m join fx_site_edges e on e.id = m.edge_id where target_id <> function_id group by 1, 2),
  r as (select *, row_number() over (partition by function_id order by callsites desc, target_id) as position, count(*) over (partition by function_id) as total from per)
  select function_id, target_id, callsites, position, greatest(total - 3, 0) as omitted from r where position <= 3""", "fx_sites", "fx_site_edges", "fx_site_targets")
def _(g):
    return binding.drill_targets(_matched(g), g["fx_site_edges"], 3)


# --- symbol flow with counters -----------------------------------------------------------------------------

_STEPS = 5


def _flow_sql(depth: int, steps: int) -> str:
    text = _SEEDS + """, adj as (select source_id as f, target_id as t, min({'r': case confidence when 'exact' then 0 when 'resolved' then 1 when 'inferred' then 2 else 3 end, 'l': start_line, 'i': id}) as o from fx_call_edges group by 1, 2),
  l0 as (select id as start, id as node, 0 as depth, cast(0 as bigint) as pos, cast(null as varchar) as parent from seeds), v0 as (select * from l0)"""
    for d in range(1, depth + 1):
        grow = "" if d == 1 else " and l.node in (select id from fx_parts)"
        text += f"""
  , n{d} as (select l.start, a.t as node, min({{'p': l.pos, 'o': a.o, 'f': a.f}}) as via from l{d - 1} l join adj a on a.f = l.node{grow} where not exists (select 1 from v{d - 1} v where v.start = l.start and v.node = a.t) group by 1, 2)
  , l{d} as (select start, node, {d} as depth, pos, parent from (select n.start, node, via.f as parent, (select max(pos) from v{d - 1} v where v.start = n.start) + row_number() over (partition by n.start order by via.p, via.o, node) as pos from n{d} n) q where pos <= {steps - 1})
  , v{d} as (select * from v{d - 1} union all select * from l{d})"""
    return (
        "with "
        + text
        + f""", met as (select v.start, v.depth, {{'p': v.pos, 'o': a.o}} as at, a.f, a.t from v{depth} v join adj a on a.f = v.node where v.depth = 0 or v.node in (select id from fx_parts)),
  fin as (select m.start, m.at as fin_at from met m join v{depth} v on v.start = m.start and v.pos = {steps - 1} and v.parent = m.f and v.node = m.t),
  cnt as (select m.start, count(*) filter (where m.depth < {depth} and fin_at is not null and m.at > fin_at) as step_limited, count(*) filter (where m.depth < {depth} and (fin_at is null or m.at <= fin_at)) as seen, count(*) filter (where m.depth = {depth}) as depth_limited from met m left join fin f on f.start = m.start group by 1)
  select v.start, count(*) as steps, max(v.depth) as depth, coalesce(max(seen), 0) - (count(*) - 1) as duplicates, coalesce(max(depth_limited), 0) as depth_limited, coalesce(max(step_limited), 0) as step_limited from v{depth} v left join cnt c on c.start = v.start group by 1"""
    )


@query("G6_symbol_flow_counters", _flow_sql(3, _STEPS), "fx_call_edges", "fx_parts")
def _(g):
    return traverse.symbol_flow(_seeds(g), g.nodes, g.edges, 3, _STEPS)


# --- structured control flow ---------------------------------------------------------------------------------

_CONTROL = """with recursive held as (select *, row_number() over (partition by function_id, container order by ord, block) as k from fx_logic_blocks),
  head as (select function_id, container, block from held where k = 1),
  sib as (select a.function_id, a.block, b.block as nxt from held a join held b on b.function_id = a.function_id and b.container = a.container and b.k = a.k + 1),
  up as (select b.function_id, b.block, c.owner, c.role, o.kind as okind, o.confidence as oconf, h.block as fin from fx_logic_blocks b left join fx_logic_containers c on c.function_id = b.function_id and c.container = b.container
    left join fx_logic_controls o on o.function_id = b.function_id and o.block = c.owner left join head h on h.function_id = b.function_id and h.container = o.final and o.kind = 'try' and c.role <> 'finally'),
  climb(function_id, block, spot, target, kind, confidence) as (
    select function_id, block, block, cast(null as bigint), cast(null as varchar), cast(null as varchar) from fx_logic_blocks
    union all select c.function_id, c.block, u.owner, case when s.nxt is not null then s.nxt when u.owner is null then -2 when u.role = 'loopBody' then u.owner when u.fin is not null then u.fin end,
      case when s.nxt is not null or u.owner is null then 'next' when u.role = 'loopBody' then 'repeat' when u.fin is not null then 'next' end,
      case when s.nxt is null and u.role = 'loopBody' then coalesce(u.oconf, 'exact') else 'exact' end
    from climb c join up u on u.function_id = c.function_id and u.block = c.spot left join sib s on s.function_id = c.function_id and s.block = c.spot where c.target is null),
  onward as (select function_id, block, target, kind, confidence from climb where target is not null),
  loops(function_id, block, jump, spot, found) as (
    select b.function_id, b.block, b.kind, u.owner, cast(null as bigint) from fx_logic_blocks b join up u on u.function_id = b.function_id and u.block = b.block where b.kind in ('break', 'continue')
    union all select l.function_id, l.block, l.jump, u.owner, case when o.kind = 'loop' or l.jump = 'break' and o.kind = 'switch' then l.spot end from loops l join up u on u.function_id = l.function_id and u.block = l.spot
      left join fx_logic_controls o on o.function_id = l.function_id and o.block = l.spot where l.found is null),
  landed as (select l.function_id, l.block, case when l.jump = 'continue' then l.found else o.target end as target from loops l join onward o on o.function_id = l.function_id and o.block = l.found where l.found is not null),
  ctl as (select c.*, o.target as onward, coalesce(c.confidence, 'exact') as sure from fx_logic_controls c join onward o on o.function_id = c.function_id and o.block = c.block),
  edge as (
    select f.function_id, -1 as source, coalesce(h.block, -2) as target, 'next' as kind, cast(null as varchar) as label, 'exact' as confidence from (select distinct function_id from fx_logic_blocks) f left join head h on h.function_id = f.function_id and h.container = 0
    union all select c.function_id, c.block, coalesce(h.block, case when c.kind = 'try' then coalesce(hf.block, c.onward) else c.onward end), b.kind, b.label, case when h.block is not null and b.kind = 'exception' then 'inferred' else sure end
      from ctl c join fx_logic_branches b on b.function_id = c.function_id and b.block = c.block left join head h on h.function_id = c.function_id and h.container = b.container left join head hf on hf.function_id = c.function_id and hf.container = c.final
      where b.container is distinct from c.final and (h.block is not null or b.kind <> 'exception')
    union all select function_id, block, onward, 'false', 'false', sure from ctl c where kind = 'condition' and not exists (select 1 from fx_logic_branches b where b.function_id = c.function_id and b.block = c.block and b.kind = 'false')
    union all select function_id, block, onward, 'exit', 'exit loop', sure from ctl c where kind = 'loop' and not exists (select 1 from fx_logic_branches b where b.function_id = c.function_id and b.block = c.block and b.kind = 'exit')
    union all select function_id, block, onward, 'exit', 'no case matched', sure from ctl c where kind = 'switch' and not has_default
    union all select b.function_id, b.block, case when b.kind in ('return', 'throw') then -2 when b.kind in ('break', 'continue') then coalesce(l.target, -2) else o.target end, case when b.kind in ('return', 'throw', 'break', 'continue') then b.kind else o.kind end,
      case when b.kind in ('return', 'throw', 'break', 'continue') then b.kind when o.kind = 'repeat' then 'repeat' end, case when b.kind in ('return', 'throw') then 'exact' when b.kind in ('break', 'continue') then (case when l.target is null then 'inferred' else 'exact' end) else o.confidence end
      from fx_logic_blocks b join onward o on o.function_id = b.function_id and o.block = b.block left join landed l on l.function_id = b.function_id and l.block = b.block where not exists (select 1 from fx_logic_controls c where c.function_id = b.function_id and c.block = b.block))
  select distinct function_id, cast(source as bigint) as source, cast(target as bigint) as target, kind, label, confidence from edge"""


@query("D1_control_edges", _CONTROL, "fx_logic_blocks", "fx_logic_containers", "fx_logic_controls", "fx_logic_branches")
def _(g):
    return control.structured_control_edges(*(g[f"fx_logic_{n}"] for n in ("blocks", "containers", "controls", "branches")))


# --- a bounded view ------------------------------------------------------------------------------------------

VIEW_NODES = 200


@query("G7_bounded_view")
def _(g):
    """Without SQL: a walk whose order depends on all before it; tested against a queue."""
    callables = g.nodes.filter("kind IN ('function', 'method', 'constructor')").select("id", "kind")
    return traverse.bounded_view(callables, g.edges, traverse.view_seeds(callables, g.edges), VIEW_NODES)


# --- module boundaries from evidence ---------------------------------------------------------------------------

_RANKS = "case basis when 'workspacePackage' then 0 when 'frameworkRoot' then 1 when 'sourceArea' then 2 else 3 end, case confidence when 'exact' then 0 when 'resolved' then 1 else 2 end"
_AREAS = ", ".join(f"'{a}'" for a in scalars.TWO_SEGMENT_CONTAINERS)
_FOUND = f"""with told as (
  select root_path as key, cast(null as varchar) as name, 'workspacePackage' as basis, 'exact' as confidence, concat('manifest|Manifest root: ', manifest) as evidence, manifest, ecosystem, cast(null as varchar) as framework from fx_packages
  union all select root_path, nullif(trim(name), ''), basis, coalesce(confidence, case when basis = 'workspacePackage' then 'exact' else 'resolved' end), concat('explicitRoot|', coalesce(label, concat('Explicit ', basis, ': ', root_path))), null, null, nullif(trim(framework), '') from fx_explicit_roots
  union all select coalesce(root_path, '/ws'), null, 'frameworkRoot', 'resolved', concat('framework|', name, ' root: ', coalesce(root_path, '/ws')), null, null, name from fx_found_frameworks
  union all select root_path, null, 'frameworkRoot', 'resolved', concat('frameworkUnit|', framework, ' ', kind, ' root: ', root_path), null, null, framework from fx_unit_roots
  union all select '/ws', null, 'workspaceRoot', 'inferred', 'workspace|Analyzed workspace root', null, null, null),
  inside as (select * from told where key = '/ws' or starts_with(key, '/ws/')),
  file as (select distinct file_path, string_split(substr(file_path, 5), '/') as parts from fx_module_files where starts_with(file_path, '/ws/')),
  homeless as (select * from file f where not exists (select 1 from inside i where i.key <> '/ws' and (starts_with(f.file_path, concat(i.key, '/')) or i.key = f.file_path))),
  area as (select distinct case when lower(parts[1]) in ({_AREAS}) and len(parts) > 2 then concat(parts[1], '/', parts[2]) else parts[1] end as a from homeless where len(parts) > 1),
  every as (select * from inside union all select concat('/ws/', a), null, 'sourceArea', 'inferred', concat('sourceArea|Inferred source area: ', a), null, null, null from area),
  merged as (select key, min(name) as name, array_to_string(list_sort(list_distinct(list(evidence))), ';') as evidence, array_to_string(list_sort(list_distinct(list(manifest) filter (where manifest is not null))), ',') as manifests,
    array_to_string(list_sort(list_distinct(list(ecosystem) filter (where ecosystem is not null))), ',') as ecosystems, array_to_string(list_sort(list_distinct(list(framework) filter (where framework is not null))), ',') as frameworks from every group by 1),
  best as (select key, basis, confidence, row_number() over (partition by key order by {_RANKS}) as k from every)
select m.key, coalesce(m.name, case when m.key = '/ws' then 'ws' else regexp_replace(m.key, '^.*/', '') end) as name, case when m.key = '/ws' then '.' else substr(m.key, 5) end as display_path, basis, confidence, evidence, coalesce(manifests, '') as manifests, coalesce(ecosystems, '') as ecosystems, coalesce(frameworks, '') as frameworks,
  (select arg_max(p.key, length(p.key)) from merged p where starts_with(m.key, concat(p.key, '/'))) as parent
from merged m join best b on b.key = m.key and b.k = 1"""


def _modules(g):
    return modules.module_boundaries(modules.boundary_evidence(g["fx_packages"], g["fx_explicit_roots"], g["fx_found_frameworks"], g["fx_unit_roots"], "/ws"), g["fx_module_files"], "/ws")


@query("I5_module_boundaries", _FOUND, "fx_packages", "fx_explicit_roots", "fx_found_frameworks", "fx_unit_roots", "fx_module_files")
def _(g):
    return _modules(g)


@query("I5_module_owners", f"with found as ({_FOUND}) select f.file_path as path, (select arg_max(key, length(key)) from found where starts_with(f.file_path, concat(key, '/')) or key = f.file_path) as module from (select distinct file_path from fx_module_files where starts_with(file_path, '/ws/')) f", "fx_packages", "fx_explicit_roots", "fx_found_frameworks", "fx_unit_roots", "fx_module_files")
def _(g):
    return ownership.owners(g["fx_module_files"], _modules(g).select(F.col("key").alias("root_key")))


# --- reading paths ---------------------------------------------------------------------------------------------

_SURE = "case {c} when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end"
_PATHS = f"""with recursive raw as (select s.*, case when s.kind in ('route', 'operation') then 'entrypoint' when s.resolution = 'unresolved' then 'unclassified' when role = 'sideEffect' then 'infrastructure' when s.resolution = 'external' or role = 'external' then 'unclassified' else coalesce(a.layer, 'unclassified') end as layer,
    case when s.kind in ('route', 'operation') then 'medium' when s.resolution = 'unresolved' then 'unknown' when role = 'sideEffect' then 'medium' when s.resolution = 'external' or role = 'external' then 'unknown' else coalesce(a.sureness, 'unknown') end as sureness,
    case when s.kind in ('route', 'operation') then 'notBusinessLogic' when s.resolution = 'unresolved' then 'unknown' when role = 'sideEffect' then 'notBusinessLogic' when s.resolution = 'external' or role = 'external' then 'unknown' else coalesce(a.business, 'unknown') end as business,
    case when s.kind in ('route', 'operation') or s.resolution in ('unresolved', 'external') or coalesce(role, '') in ('sideEffect', 'external') then false else coalesce(a.conflicted, false) end as conflicted
    from fx_flow_steps s join fx_reading_flows f on f.flow_id = s.flow_id and f.mapped left join fx_flow_assessed a on a.function_id = s.function_id),
  st as (select *, row_number() over (partition by flow_id order by depth, case when kind in ('route', 'operation') then 0 when kind = 'handler' then 1 else 2 end, file_path, start_line nulls last, start_character nulls last, coalesce(function_id, ''), coalesce(unit_id, ''), coalesce(edge_id, ''), step_id) as o from raw),
  ent as (select flow_id, min(o) as o from st where kind in ('route', 'operation') group by 1),
  han as (select flow_id, arg_min(function_id, o) as fn, min(o) as o from st where kind = 'handler' and resolution = 'concrete' and function_id is not null group by 1),
  callee as (select flow_id, function_id, min(o) as o from st where kind = 'call' and function_id is not null group by 1, 2),
  walk(flow_id, start, o, up, path, seen) as (
    select s.flow_id, s.o, s.o, s.parent_function_id, [s.o], cast([] as varchar[]) from st s join han h on h.flow_id = s.flow_id where s.kind = 'call'
    union all select w.flow_id, w.start, c.o, s.parent_function_id, list_prepend(c.o, w.path), list_append(w.seen, w.up) from walk w join han h on h.flow_id = w.flow_id join callee c on c.flow_id = w.flow_id and c.function_id = w.up join st s on s.flow_id = w.flow_id and s.o = c.o
      where w.up <> h.fn and not list_contains(w.seen, w.up)),
  chain as (select w.flow_id, w.start as o, w.path from walk w join han h on h.flow_id = w.flow_id and w.up = h.fn),
  bnd as (select s.flow_id, s.o, c.path, case when role = 'repository' then 0 when role = 'model' then 1 when resolution = 'external' or role = 'external' then 2 when role = 'sideEffect' then 3 when resolution = 'unresolved' then 4
      when function_id is not null and not exists (select 1 from st t where t.flow_id = s.flow_id and t.kind = 'call' and t.parent_function_id = s.function_id) then 5 end as b from st s join chain c on c.flow_id = s.flow_id and c.o = s.o where s.kind = 'call'),
  biz as (select s.flow_id, s.o, s.function_id, c.path, row_number() over (partition by s.flow_id order by case business when 'domainRuleCandidate' then 0 else 1 end, {_SURE.format(c="sureness")}, depth, case confidence when 'exact' then 0 when 'resolved' then 1 when 'inferred' then 2 else 3 end, s.o) as n
    from st s join chain c on c.flow_id = s.flow_id and c.o = s.o where s.kind = 'call' and resolution = 'concrete' and function_id is not null and business in ('domainRuleCandidate', 'applicationWorkflowCandidate')),
  item as (select b.*, unnest(path) as x, unnest(range(1, len(path) + 1)) as i from bnd b where b.b is not null),
  via as (select i.flow_id, i.o, i.b, i.path, row_number() over (partition by i.flow_id order by i.b, i.o) as n from item i join biz z on z.flow_id = i.flow_id and z.n = 1 join st s on s.flow_id = i.flow_id and s.o = i.x and s.function_id = z.function_id),
  bridge as (select i.flow_id, i.o, i.b, i.path, arg_min(i.x, i.i) as br, arg_min(s.depth, i.i) as bd from item i join st s on s.flow_id = i.flow_id and s.o = i.x
    where i.b in (0, 1, 3) and i.i < len(path) and s.resolution = 'concrete' and s.function_id is not null and coalesce(s.role, '') not in ('repository', 'model', 'external', 'sideEffect') and s.layer = 'unclassified' and s.business = 'unknown' and not s.conflicted group by 1, 2, 3, 4),
  bridged as (select *, row_number() over (partition by flow_id order by b, bd, br, o) as n from bridge),
  plain as (select *, row_number() over (partition by flow_id order by b, o) as n from bnd where b is not null),
  pick as (select f.flow_id, e.o as eo, h.o as ho, z.o as zo, case when z.o is null then g.br end as br, case when z.o is not null then v.o when g.o is not null then g.o else p.o end as bo,
      case when z.o is not null then coalesce(v.path, z.path) when g.o is not null then g.path else p.path end as path, case when z.o is not null then v.b when g.o is not null then g.b else p.b end as b
    from (select distinct flow_id from st) f left join ent e on e.flow_id = f.flow_id left join han h on h.flow_id = f.flow_id left join biz z on z.flow_id = f.flow_id and z.n = 1 left join via v on v.flow_id = f.flow_id and v.n = 1
      left join bridged g on g.flow_id = f.flow_id and g.n = 1 left join plain p on p.flow_id = f.flow_id and p.n = 1),
  room as (select *, list_filter([eo, ho], lambda x: x is not null) as head, {reading.STEP_LIMIT} - len(list_filter([eo, ho], lambda x: x is not null)) as room, list_distinct(list_filter([1, list_position(path, coalesce(zo, br)), list_position(path, bo)], lambda x: x is not null and x > 0)) as must from pick),
  cut as (select *, case when path is null or ho is null then [] when len(path) <= room then path when room = 1 then [coalesce(zo, br, bo, path[1])]
      else list_transform(list_slice(list_sort(list_concat(must, list_slice(list_filter(range(1, len(path) + 1), lambda x: not list_contains(must, x)), 1, greatest(0, room - len(must))))), 1, room), lambda x: path[x]) end as tail from room),
  seq as (select flow_id, list_concat(head, tail) as os, case when list_contains(tail, bo) then bo end as bo, case when list_contains(tail, br) then br end as br, ho, b from cut),
  at_step as (select q.flow_id, s.*, j from (select flow_id, unnest(os) as x, unnest(range(1, len(os) + 1)) as j from seq) q join st s on s.flow_id = q.flow_id and s.o = q.x),
  sum_of as (select flow_id, string_agg(step_id, ',' order by j) as steps, min(j) filter (where business = 'domainRuleCandidate') as dj, min(j) filter (where business = 'applicationWorkflowCandidate') as aj, count(*) as n, bool_or(layer in ('dataAccess', 'infrastructure')) as stored, min(j) filter (where kind = 'handler') as hj from at_step group by 1),
  tot as (select flow_id, count(*) as n, count(*) filter (where kind = 'call' and resolution = 'unresolved') as u from st group by 1),
  tgt as (select q.*, u.steps, u.n, u.stored, t.n as total, t.u, case when dj is not null then dj when aj is not null then aj when q.br is not null then list_position(q.os, q.br) else hj end as tj, case when dj is not null then 'domainCandidateReached' when aj is not null then 'applicationCandidateReached' when q.br is not null then 'workflowBridgeCandidateReached' else '' end as reach
    from seq q join tot t on t.flow_id = q.flow_id left join sum_of u on u.flow_id = q.flow_id),
  paths as (select g.flow_id, coalesce(g.steps, '') as steps, case when g.bo is not null then ['repository', 'model', 'externalCall', 'sideEffect', 'unresolvedCall', 'observedTerminal'][g.b + 1] end as boundary_kind, s.step_id as target, c.step_id as context,
      case when reach <> '' then reach when f.depth_limit or f.step_limit then 'analysisLimited' else 'noCandidateObserved' end as business_reach, g.total - coalesce(g.n, 0) as omitted_steps, g.u as unresolved_calls, s.sureness as target_sureness, coalesce(s.depth, {reading.NO_DEPTH}) as target_depth, coalesce(g.stored, false) as stored,
      f.scope_id, f.confidence as mapping, case when f.depth_limit or f.step_limit then 'limited' when g.u > 0 then 'unresolved' else 'mapped' end as trace_status
    from tgt g join fx_reading_flows f on f.flow_id = g.flow_id left join at_step s on s.flow_id = g.flow_id and s.j = g.tj left join st c on c.flow_id = g.flow_id and c.o = g.br)"""
_READING = ("fx_flow_steps", "fx_flow_assessed", "fx_reading_flows")


def _paths(g):
    return reading.reading_paths(reading.step_architecture(g["fx_flow_steps"], g["fx_flow_assessed"]), g["fx_reading_flows"])


@query("I8_reading_paths", _PATHS + " select * from paths", *_READING)
def _(g):
    return _paths(g)


_RANKED = """, parts as (select *, case trace_status when 'mapped' then 2 when 'unresolved' then 1 else 0 end as tr, stored::int as bd from paths),
  ranked as (select *, row_number() over (partition by scope_id order by case when tr = 2 and stored then 3 when tr = 2 then 2 else bd end desc, case mapping when 'exact' then 4 when 'resolved' then 3 when 'inferred' then 2 when 'unresolved' then 1 else 0 end desc,
    case business_reach when 'domainCandidateReached' then 4 when 'applicationCandidateReached' then 3 when 'workflowBridgeCandidateReached' then 2 when 'noCandidateObserved' then 1 else 0 end desc, case target_sureness when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end desc, tr desc, bd desc, unresolved_calls, target_depth, flow_id) as position from parts),
  counts as (select scope_id, count(*) filter (where mapped) as mapped_flows, count(*) filter (where not mapped) as unmapped_entrypoints from fx_reading_flows group by 1)"""


@query("K17_K18_I9_scope_paths", _PATHS + _RANKED + f" select r.scope_id, position, flow_id, steps, target, business_reach, trace_status, mapped_flows, greatest(0, mapped_flows - {reading.PATH_LIMIT}) as omitted_flows, unmapped_entrypoints from ranked r join counts c on c.scope_id = r.scope_id where position <= {reading.PATH_LIMIT}", *_READING)
def _(g):
    return reading.scope_paths(_paths(g), g["fx_reading_flows"])


# --- frameworks by manifests -------------------------------------------------------------------------------------

_RULES = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in detection.RULES)
_QUOTES = "chr(39) || chr(34)"
_DEPENDENCY = f"translate(lower(split_part(trim(trim({{x}}), {_QUOTES}), '[', 1)), '_', '-')"


def _requirement(x: str) -> str:
    bare = f"trim(split_part({x}, '#', 1))"
    return f"case when regexp_matches({bare}, '^(-|https?://|git\\+)') then '' else {_DEPENDENCY.format(x=f"regexp_extract({bare}, '^([A-Za-z0-9_.-]*)', 1)")} end"


#: Texts in double or single quotes; \x27 is the single quote.
_QUOTED = "list_transform(regexp_extract_all(b, '\"[^\"]*\"|\\x27[^\\x27]*\\x27'), lambda q: trim(q[2:len(q) - 1]))"
_FILES = ", ".join(f"'{n}'" for n in (*detection.PYTHON_MANIFESTS, *detection.JVM_MANIFESTS, *detection.OTHER_MANIFESTS))
_TABLE = "^(?:(?:.*\\.)?(?:dev-)?dependencies|build-dependencies)"
_DETECTED = f"""with rule(rule, token, framework, ecosystem, category) as (values {_RULES}),
  man as (select regexp_replace(path, '/[^/]*$', '') as root, regexp_extract(path, '([^/]*)$', 1) as manifest, content from fx_manifest_files where regexp_extract(path, '([^/]*)$', 1) in ({_FILES})),
  line as (select root, manifest, i, string_split(content, chr(10))[i] as line from (select *, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i from man) t),
  bare as (select *, trim(split_part(line, '#', 1)) as b from line),
  cargo as (select *, last_value(case when regexp_matches(b, '^\\[.*\\]$') then b end ignore nulls) over (partition by root, manifest order by i) as h, regexp_matches(b, '^\\[.*\\]$') as is_header from bare where manifest = 'Cargo.toml'),
  go as (select *, last_value(case when g in ('require (', ')') then g end ignore nulls) over (partition by root, manifest order by i) as m from (select *, trim(split_part(line, '//', 1)) as g from line where manifest = 'go.mod') t),
  module as (select root, manifest, case when g in ('require (', ')', '') then '' when m = 'require (' then regexp_extract(g, '^(\\S+)', 1) else regexp_extract(g, '^require (\\S+)', 1) end as whole from go),
  told as (
    select root, manifest, 'package' as rule, unnest(json_keys(json_extract(content, '$.dependencies'))) as token, 'package.json dependency: ' as lead, cast(null as varchar) as shown from man where manifest = 'package.json'
    union all select root, manifest, 'package', unnest(json_keys(json_extract(content, '$.devDependencies'))), 'package.json devDependency: ', null from man where manifest = 'package.json'
    union all select root, manifest, 'script', unnest(list_distinct(regexp_extract_all(lower(json_extract(content, '$.scripts')::varchar), '[A-Za-z0-9_/@.:-]+'))), 'package.json script: ', null from man where manifest = 'package.json'
    union all select root, manifest, 'composer', unnest(json_keys(json_extract(content, '$.require'))), 'composer.json require: ', null from man where manifest = 'composer.json'
    union all select root, manifest, 'composer', unnest(json_keys(json_extract(content, '$."require-dev"'))), 'composer.json require-dev: ', null from man where manifest = 'composer.json'
    union all select root, manifest, 'jvm', 'org.springframework.boot', manifest || ' plugin: ', null from man where manifest in ('build.gradle', 'build.gradle.kts', 'pom.xml') and contains(content, 'org.springframework.boot')
    union all select root, manifest, 'jvm', 'spring-boot-starter', manifest || ' dependency: ', null from man where manifest in ('build.gradle', 'build.gradle.kts', 'pom.xml') and contains(content, 'spring-boot-starter')
    union all select root, manifest, 'python', {_requirement("line")}, manifest || ' dependency: ', null from bare where manifest = 'requirements.txt'
    union all select root, manifest, 'python', {_DEPENDENCY.format(x="split_part(b, '=', 1)")}, manifest || ' dependency: ', null from bare where manifest in ('pyproject.toml', 'setup.py', 'Pipfile') and contains(b, '=')
    union all select root, manifest, 'python', {_requirement("q")}, manifest || ' dependency: ', null from (select *, unnest({_QUOTED}) as q from bare where manifest in ('pyproject.toml', 'setup.py', 'Pipfile')) t
    union all select root, manifest, 'cargo', case when is_header then regexp_extract(trim(b, '[]'), '{_TABLE}\\.([^.]+)$', 1) when regexp_matches(trim(h, '[]'), '{_TABLE}$') and contains(b, '=') then trim(trim(split_part(b, '=', 1)), '"') else '' end, 'Cargo.toml dependency: ', null from cargo
    union all select root, manifest, 'go', array_to_string(string_split(whole, '/')[1:k], '/'), 'go.mod require: ', whole from (select *, unnest(range(1, len(string_split(whole, '/')) + 1)) as k from module where whole <> '') t
    union all select root, manifest, 'gem', {_QUOTED}[1], 'Gemfile gem: ', null from bare where manifest = 'Gemfile' and regexp_matches(b, '^gem\\s*["\\x27]')),
  hit as (select t.root, r.*, lead || coalesce(shown, t.token) as label from told t join rule r on r.rule = t.rule and r.token = t.token),
  detected as (select root, framework, min(ecosystem) as ecosystem, min(category) as category, case when bool_or(rule <> 'script') then 'high' else 'medium' end as confidence, array_to_string(list_sort(list_distinct(list(label))), '; ') as evidence from hit group by 1, 2)"""


def _detected(g):
    return detection.detected_frameworks(detection.manifests(g["fx_manifest_files"]))


@query("X1_X2_detected_frameworks", _DETECTED + " select * from detected", "fx_manifest_files")
def _(g):
    return _detected(g)


_CONCRETE = """, concrete as (select regexp_replace(path, '/[^/]*$', '') as root, concat('manage.py Django entrypoint: ', path) as evidence from fx_manifest_files
    where regexp_matches(path, '(^|/)manage.py$') and contains(content, 'DJANGO_SETTINGS_MODULE') and (contains(content, 'django.core.management') or contains(content, 'execute_from_command_line'))),
  every as (select root, framework, evidence from detected union all select root, 'Django', evidence from concrete)
  select root, framework, array_to_string(list_sort(list_distinct(list(evidence))), '; ') as evidence from every e where not (framework = 'Django' and exists (select 1 from concrete c where starts_with(c.root, concat(e.root, '/')))) group by 1, 2"""


@query("X3_A21_concrete_roots", _DETECTED + _CONCRETE, "fx_manifest_files")
def _(g):
    return detection.with_concrete_roots(_detected(g), detection.django_roots(g["fx_manifest_files"]))


# --- keyed state over a stream -----------------------------------------------------------------------------------


@query("ST_newest_snapshots", "select path, max(version) as version, arg_max(content_hash, {'v': version, 'h': content_hash}) as content_hash from (select concat('/f', user_id % 997) as path, event_id * 7919 % 10007 as version, md5(concat(event_type, user_id)) as content_hash from events) t group by 1")
def _(g):
    """The events table as a stream of snapshots whose versions come out of order, followed to its end in keyed state."""
    spark = g.spark
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(g["events"].schema).option("maxFilesPerTrigger", 2).parquet(f"{g.sf_dir}/[e]vents.parquet")  # a pattern, as the table may be one file
    version = (F.col("event_id") * 7919 % 10007).cast("long")
    told = events.select(F.concat(F.lit("/f"), F.col("user_id") % 997).alias("path"), version.alias("version"), F.md5(F.concat("event_type", F.col("user_id").cast("string"))).alias("content_hash"))
    snapshots.follow_snapshots(told, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return snapshots.current(spark, f"{home}/out")


# --- counters of briefs, hops and choices -----------------------------------------------------------------------

_OPERATION = "case when entry_kind = 'operation' then (case when split_part(qualified_name, '.', 1) in ('Query', 'Mutation', 'Subscription') then split_part(qualified_name, '.', 1) else 'Other' end) end"


@query(
    "A22_entrypoint_group_view",
    f"""with own as (select *, coalesce({_OPERATION}, 'http') as operation from fx_brief_flows), g as (select framework, root_path, entry_kind, operation, count(*) as entrypoints, count(*) filter (where status = 'mapped') as mapped, count(*) filter (where status in ('ambiguous', 'handlerNotMapped')) as gaps,
      array_to_string(list_slice(list_sort(list_distinct(list(entry_id))), 1, 3), ',') as examples from own group by 1, 2, 3, 4), r as (select *, row_number() over (order by entrypoints desc, framework, root_path, entry_kind, operation) as k from g)
    select framework, root_path, entry_kind, operation, entrypoints, mapped, gaps, examples, (select count(*) from r where k > 3) as omitted_groups, (select cast(coalesce(sum(entrypoints), 0) as bigint) from r where k > 3) as omitted_entrypoints from r where k <= 3""",
    "fx_brief_flows",
)
def _(g):
    return flows.entrypoint_groups(g["fx_brief_flows"])


@query(
    "A29_scope_execution_counts",
    f"""with own as (select *, coalesce({_OPERATION}, '') as op from fx_brief_flows) select scope_id, count(*) as entrypoints, count(*) filter (where status = 'mapped') as mapped, count(*) filter (where status in ('ambiguous', 'handlerNotMapped')) as gaps, count(*) filter (where entry_kind = 'route') as http_routes,
      count(*) filter (where op = 'Query') as graphql_queries, count(*) filter (where op = 'Mutation') as graphql_mutations, count(*) filter (where op = 'Subscription') as graphql_subscriptions, count(*) filter (where op = 'Other') as graphql_others from own group by 1""",
    "fx_brief_flows",
)
def _(g):
    return flows.execution_counts(g["fx_brief_flows"], "scope_id")


@query(
    "A33_logic_summary",
    """select function_id, count(*) as blocks, count(*) filter (where kind in ('condition', 'switch')) as branches, count(*) filter (where kind = 'loop') as loops, count(*) filter (where kind in ('call', 'effect')) as calls, count(*) filter (where kind = 'effect') as effects,
      count(*) filter (where kind = 'mutation') as mutations, cast(sum(value_changes) as bigint) as value_changes, count(*) filter (where kind in ('return', 'throw')) as exits from fx_summary_blocks group by 1""",
    "fx_summary_blocks",
)
def _(g):
    return dataflow.logic_summary(g["fx_summary_blocks"])


_REACHING = """with recursive walk(f, b, rd, cur, d) as (select function_id, binding, block_id, block_id, 0 from fx_blocks where access = 'read'
      union select w.f, w.b, w.rd, e.src, w.d + 1 from walk w join fx_block_edges e on e.function_id = w.f and e.dst = w.cur where w.d < 5 and (w.d = 0 or not exists (select 1 from fx_blocks x where x.function_id = w.f and x.block_id = w.cur and x.binding = w.b and x.access = 'define'))),
    flow as (select distinct f, b, cur as def, rd from walk join fx_blocks x on x.function_id = f and x.block_id = cur and x.binding = b and x.access = 'define' where d > 0)"""


@query(
    "D5_value_hops",
    _REACHING
    + """, related as (select f, b, def as n from flow union select f, b, rd from flow), self as (select f, b, rd from flow where def = rd),
    back(f, b, rd, cur) as (select distinct t.f, t.b, t.rd, e.src from (select distinct f, b, rd from flow) t join fx_block_edges e on e.function_id = t.f and e.dst = t.rd where e.src <> t.rd
      union select w.f, w.b, w.rd, e.src from back w join fx_block_edges e on e.function_id = w.f and e.dst = w.cur where e.src <> w.rd and not exists (select 1 from related r where r.f = w.f and r.b = w.b and r.n = w.cur)),
    near as (select w.* from back w join related r on r.f = w.f and r.b = w.b and r.n = w.cur where not exists (select 1 from self s where s.f = w.f and s.b = w.b and s.rd = w.rd))
    select f as function_id, b as binding, cur as source, rd as target from near union select f, b, rd, rd from self
    union select f, b, def, rd from flow t where not exists (select 1 from near n where n.f = t.f and n.b = t.b and n.rd = t.rd) and not exists (select 1 from self s where s.f = t.f and s.b = t.b and s.rd = t.rd)""",
    "fx_blocks",
    "fx_block_edges",
)
def _(g):
    edges = kept(g["fx_block_edges"])
    return dataflow.value_hops(dataflow.reaching_definitions(g["fx_blocks"], edges, 5), edges)


@query(
    "D6_branch_choices",
    """with recursive way as (select e.*, c.edge_id is null or c.edge_id = e.edge_id as taken from fx_condition_edges e left join (select c.* from fx_choices c join fx_condition_edges x on x.function_id = c.function_id and x.edge_id = c.edge_id and x.src = c.block_id and x.kind in ('true', 'false', 'case')) c
        on c.function_id = e.function_id and c.block_id = e.src where exists (select 1 from fx_choice_blocks b where b.function_id = e.function_id and b.block_id = e.src) and exists (select 1 from fx_choice_blocks b where b.function_id = e.function_id and b.block_id = e.dst)),
      free as (select function_id, block_id, kind from fx_choice_blocks b where not exists (select 1 from way w where w.function_id = b.function_id and w.dst = b.block_id)),
      root as (select function_id, block_id from free where kind = 'entry' union select function_id, block_id from free f where not exists (select 1 from free x where x.function_id = f.function_id and x.kind = 'entry')
        union select function_id, min(block_id) from fx_choice_blocks b where not exists (select 1 from free x where x.function_id = b.function_id) group by 1),
      walk(f, b) as (select * from root union select w.f, e.dst from walk w join way e on e.function_id = w.f and e.src = w.b and e.taken)
    select f as function_id, b as block_id, (select count(*) from way e where e.function_id = f and e.src = b and e.taken) as active_edges from walk""",
    "fx_choice_blocks",
    "fx_condition_edges",
    "fx_choices",
)
def _(g):
    return dataflow.chosen_blocks(g["fx_choice_blocks"], g["fx_condition_edges"], g["fx_choices"])


@query(
    "A24_analysis_coverage",
    f"""select errors, warnings, infos, unresolved_calls, inferred_calls, ambiguous_entrypoints, handlers_not_mapped, traversal_limits from
      (select count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity not in ('error', 'warning')) as infos from fx_diagnostics) d,
      (select count(*) filter (where confidence = 'unresolved' or n.id is null) as unresolved_calls, count(*) filter (where confidence = 'inferred') as inferred_calls from fx_call_edges e left join (select distinct id from fx_nodes) n on n.id = e.target_id) c,
      (select count(*) filter (where status = 'ambiguous') as ambiguous_entrypoints, count(*) filter (where status = 'handlerNotMapped') as handlers_not_mapped from ({ORACLE_SQL["J12_J13_I3_entrypoint_flows"]}) f) e,
      (select count(*) filter (where step_gap) + count(*) filter (where depth_gap) as traversal_limits from ({ORACLE_SQL["I3_W5_flow_gaps"]}) g) t""",
    "fx_diagnostics",
    "fx_nodes",
    "fx_call_edges",
)
def _(g):
    found = _flows(g)
    return flows.analysis_coverage(g["fx_diagnostics"], g.nodes, g.edges, found, flows.flow_steps(found, g.nodes, g.edges, 3, 8)[1])


# --- views, places, blocks -----------------------------------------------------------------------------------------

_VIEWS = "with shown as (" + " union all ".join(
    f"select '{mode}' as mode, id from fx_nodes where kind in ({', '.join(repr(k) for k in ('file', *kinds))})" for mode, kinds in views.VIEW_NODES.items()
) + " union all select distinct 'file', n.id from fx_nodes n join fx_view_edges e on e.target_id = n.id join fx_nodes s on s.id = e.source_id and s.kind = 'file' where n.kind = 'external' and e.kind in ('imports', 'exports')), kinds(mode, kind) as (values " + ", ".join(f"('{mode}', '{k}')" for mode, kinds in views.VIEW_EDGES.items() for k in kinds) + "), kept as (select k.mode, e.id from fx_view_edges e join kinds k on k.kind = e.kind where exists (select 1 from shown s where s.mode = k.mode and s.id = e.source_id) and exists (select 1 from shown s where s.mode = k.mode and s.id = e.target_id))"


@query("P9_view_projections", _VIEWS + " select mode, 'node' as what, id from shown union all select mode, 'edge', id from kept", "fx_nodes", "fx_view_edges")
def _(g):
    out = None
    for mode in views.VIEW_NODES:
        for what, rows in zip(("node", "edge"), views.view_projection(g.nodes, g["fx_view_edges"], mode), strict=True):
            part = rows.select(F.lit(mode).alias("mode"), F.lit(what).alias("what"), "id")
            out = part if out is None else out.unionByName(part)
    return out


@query("G3_call_view_counts", "with n as (select * from fx_nodes where kind in ('file', 'function', 'method', 'constructor')), e as (select * from fx_view_edges where kind in ('calls', 'contains') and source_id in (select id from n) and target_id in (select id from n)) select count(*) as symbols, count(*) filter (where kind = 'file') as files, count(*) filter (where kind = 'external') as externals, (select count(*) from e) as edges from n", "fx_nodes", "fx_view_edges")
def _(g):
    return views.graph_counts(*views.view_projection(g.nodes, g["fx_view_edges"], "call"))


@query("A28_first_places", "select target_id, file_path, start_line, start_character from (select *, row_number() over (partition by target_id order by file_path, start_line is null, start_line, start_character, end_line, end_character) as k from fx_places) t where k = 1", "fx_places")
def _(g):
    return views.first_locations(g["fx_places"], "target_id")


@query("J20_innermost_blocks", "select point_id, block_id from (select p.point_id, b.block_id, row_number() over (partition by p.point_id order by b.last - b.first, b.depth desc, b.ord) as k from fx_points p join fx_spans b on b.function_id = p.function_id and b.kind not in ('entry', 'exit') and b.first <= p.first and p.last <= b.last) t where k = 1", "fx_points", "fx_spans")
def _(g):
    return binding.innermost_blocks(g["fx_points"], g["fx_spans"])


# --- SQL of earlier queries whose order follows from the levels before ------------------------------------------------


def _impact_sql(depth: int, steps: int) -> str:
    text = _SEEDS + """, adj as (select target_id as f, source_id as t, min({'r': case confidence when 'exact' then 0 when 'resolved' then 1 when 'inferred' then 2 else 3 end, 'l': start_line, 'i': id}) as o from fx_call_edges group by 1, 2),
  v0 as (select id as start, id as node, 0 as depth, cast(0 as bigint) as pos, 0 as r from seeds)"""
    for d in range(1, depth + 1):
        text += f"""
  , n{d} as (select v.start, a.t as node, min({{'p': v.pos, 'o': a.o, 'f': a.f, 'r': v.r}}) as via from v{d - 1} v join adj a on a.f = v.node where v.depth = {d - 1} and not exists (select 1 from v{d - 1} x where x.start = v.start and x.node = a.t) group by 1, 2)
  , v{d} as (select * from v{d - 1} union all select * from (select n.start, node, {d}, (select max(pos) from v{d - 1} x where x.start = n.start) + row_number() over (partition by n.start order by via.p, via.o, node) as pos, greatest(via.r, via.o.r) from n{d} n) q where pos <= {steps})"""
    return f"with {text} select start as target_id, node as caller_id, depth, ['exact', 'resolved', 'inferred', 'unresolved'][r + 1] as confidence, pos as position from v{depth} where depth > 0"


ORACLE_SQL["G4_impact_limited"] = oracle("fx_call_edges", "fx_parts", query=_impact_sql(4, 5))


def _order_sql(ranks: int) -> str:
    """The order of drawing, a rank after the other; an order of the fixture has no more than ``ranks`` line items."""
    text = f"""with ranked as (select function_id as scene, block_id as node, "rank" from ({ORACLE_SQL["C4_forward_ranks"]}) c), way as (select function_id as scene, src, dst from fx_block_edges where kind = 'next'),
  p0 as (select scene, node, "rank", row_number() over (partition by scene order by node) - 1 as position from ranked where "rank" = 0)"""
    for r in range(1, ranks + 1):
        text += f"""
  , c{r} as (select k.scene, k.node, (select avg(p.position) from way w join p{r - 1} p on p.scene = w.scene and p.node = w.src where w.scene = k.scene and w.dst = k.node) as centre from ranked k where k."rank" = {r})
  , p{r} as (select * from p{r - 1} union all select c.scene, c.node, {r}, (select count(*) from p{r - 1} p where p.scene = c.scene) + row_number() over (partition by c.scene order by centre nulls last, node) - 1 from c{r} c)"""
    return text + f" select scene, node, \"rank\", position from p{ranks}"


ORACLE_SQL["C3_A35_rank_order"] = oracle("fx_blocks", "fx_block_edges", query=_order_sql(24))
