"""What keeps queries in proportion to their input: no step by the group in pandas, no candidate pairs beyond those that meet."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import binding, call_resolution, components, control, dataflow, flows, lineage, reading
from codeloom.plans import fixtures, registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


STEP = "flow_id string, step_id string, kind string, depth long, role string, resolution string, function_id string, parent_function_id string, confidence string, file_path string, start_line int, start_character int, unit_id string, edge_id string"


def test_reading_paths_of_many_flows(spark):
    """flows are rows of a batch, not data frames of their own."""
    own = [("route", 0, None, None), ("handler", 1, "h", None), ("call", 2, "a", "h"), ("call", 3, "b", "a")]
    rows = [(f"flow{n}", f"s{k}", kind, depth, "repository" if f == "b" else None, "concrete", f, up, "exact", "/p", None, None, None, None) for n in range(50) for k, (kind, depth, f, up) in enumerate(own)]
    assessed = spark.createDataFrame([("a", "domain", "high", "domainRuleCandidate", False)], "function_id string, layer string, sureness string, business string, conflicted boolean")
    mapped = spark.createDataFrame([(f"flow{n}", f"scope{n % 2}", n != 3, "exact", False, False) for n in range(50)], "flow_id string, scope_id string, mapped boolean, confidence string, depth_limit boolean, step_limit boolean")
    paths = reading.reading_paths(reading.step_architecture(spark.createDataFrame(rows, STEP), assessed), mapped)
    assert "FlatMapGroupsInPandas" not in plan(paths)
    assert {(r["steps"], r["boundary_kind"], r["target"], r["business_reach"]) for r in paths.collect()} == {("s0,s1,s2,s3", "repository", "s2", "domainCandidateReached")}
    assert paths.count() == 49
    best = reading.scope_paths(paths, mapped).filter("scope_id = 'scope1'").orderBy("position").collect()
    assert [(r["flow_id"], r["mapped_flows"], r["omitted_flows"], r["unmapped_entrypoints"]) for r in best] == [("flow1", 24, 21, 1), ("flow11", 24, 21, 1), ("flow13", 24, 21, 1)]


SITE = "function_id string, site_id string, file_path string, callee_name string, start_line int, start_character int, end_line int, end_character int"


def test_matched_callsites_of_many_functions(spark):
    """As above; an edge without a character comes after those with one."""
    sites = spark.createDataFrame([(f"fn{n}", f"site:{n}:{k}", "p", "f", k, 0, k + 3, 9) for n in range(50) for k in range(2)], SITE)
    edges = spark.createDataFrame([(f"edge:{n}:{k}", f"fn{n}", "t", "p", 1, c, 1, 9) for n in range(50) for k, c in enumerate((None, 2, 0))], "id string, source_id string, target_id string, file_path string, start_line int, start_character int, end_line int, end_character int")
    got = binding.matched_callsites(sites, edges, spark.createDataFrame([("t", "f", "A.f")], "id string, name string, qualified_name string"))
    assert "FlatMapGroupsInPandas" not in plan(got)
    assert sorted((r["function_id"], r["site_id"][-1], r["edge_id"][-1], r["distance"]) for r in got.collect()) == sorted((f"fn{n}", *x) for n in range(50) for x in (("0", "2", 1_000_000), ("1", "1", 2)))
    assert binding.drill_targets(got, edges).agg(F.sum("callsites")).first()[0] == 100


def test_bindings_meet_by_bins(spark):
    """Each pair of ranges that overlap once, however long they are; equal places are one row."""
    draw = random.Random(5)
    spot = lambda: (draw.choice(("/a", "/b", None)), draw.choice((None, *range(0, 400, 7))), draw.randrange(-3, 300))
    ranges = lambda n, p: [(f"{p}{k}", path, s, None if s is None else s + length) for k, (path, s, length) in enumerate(spot() for _ in range(n))]
    u, f = ranges(60, "u"), ranges(60, "f") + [("f100", "/a", 140, 260), ("f101", "/a", 140, 260)]
    columns = "id string, file_path string, start_line int, end_line int"
    units = spark.createDataFrame([(*r, "F", "route") for r in u], columns + ", framework string, kind string")
    functions = spark.createDataFrame(f, columns)
    meet = lambda x, y: x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and x[2] <= y[3] and y[2] <= x[3]
    want = sorted((x[0], y[0], "contains" if x[2] <= y[2] and x[3] >= y[3] else "overlaps") for x in u for y in f if meet(x, y))
    bound = binding.place_bindings(units, functions)
    assert want and sorted(map(tuple, bound.select("unit_id", "function_id", "evidence").collect())) == want
    assert "_bin" in plan(bound)
    grouped = binding.place_bindings(units, binding.places(functions))
    assert grouped.agg(F.sum("functions")).first()[0] == len(want) > grouped.count()
    points = spark.createDataFrame([(f"p{k}", "/a", line) for k, line in enumerate((5, 5, 63, 64, 200, 2000))], "point_id string, point_path string, line int")
    best = {k: min(((y[3] - y[2], -y[2], y[0]) for y in f if y[1] == "/a" and y[2] is not None and y[2] <= line <= y[3]), default=None) for k, line in enumerate((5, 5, 63, 64, 200, 2000))}
    assert {(r["point_id"], r["range_id"]) for r in binding.innermost(points, functions).collect()} == {(f"p{k}", b[2]) for k, b in best.items() if b}


def test_flows_of_places(spark):
    """Functions of one place count as many candidates as they are."""
    units = spark.createDataFrame([("r1", "F", "route", "/a", 1, 9), ("r2", "F", "route", "/b", 1, 9), ("r3", "F", "route", "/c", 1, 9)], "id string, framework string, kind string, file_path string, start_line int, end_line int")
    functions = spark.createDataFrame([("f1", "/a", 2, 3), ("f2", "/a", 2, 3), ("f3", "/b", 2, 3), ("f4", "/b", 8, 12)], "id string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([("r3", "r1", "exact")], "source_id string, target_id string, confidence string").withColumn("kind", F.lit("routesTo"))
    got = flows.semantic_flows(units, binding.place_bindings(units, binding.places(functions)), edges)
    assert sorted((r["entry_id"], r["status"], r["handler_id"], r["candidates"]) for r in got.collect()) == [("r1", "ambiguous", None, 2), ("r2", "mapped", "f3", 1), ("r3", "ambiguous", None, 2)]


def test_condition_cases_by_groups_and_rounds(spark):
    """functions worked out one by one have the cases that rounds of joins find."""
    draw = random.Random(9)
    sizes = [(f, g, draw.randrange(1, 8)) for f in range(12) for g in range(2)]
    members = [(f, g, 10 * g + k, k) for f, g, n in sizes for k in range(n)]
    edges = [(f, 2 * b + x, b, draw.choice((b + 1, b + 2, 100, 200, 10 * g)), k) for f, g, b, _ in members for x, k in enumerate(("true", "false"))]
    own = spark.createDataFrame(members, "function_id long, group_id long, block_id int, member_index int"), spark.createDataFrame(edges, "function_id long, edge_id int, src int, dst int, kind string")
    got, rounds = dataflow.condition_cases(*own, max_rows=5), dataflow.condition_cases(*own, max_rows=5, most=0)
    told = lambda df: sorted(repr(r.asDict()) for r in df.select(*got.columns).collect())
    assert "MapInArrow" in plan(got)
    assert got.schema.simpleString() == rounds.schema.simpleString() and told(got) == told(rounds) != []


def test_control_edges_of_many_functions(spark):
    """functions are rows of a batch, not data frames of their own."""
    blocks = spark.createDataFrame([(n, k, 0, k, "statement") for n in range(20) for k in (1, 2)], "function_id long, block long, container long, ord long, kind string")
    containers = spark.createDataFrame([(n, 0, None, "root") for n in range(20)], "function_id long, container long, owner long, role string")
    controls = spark.createDataFrame([], "function_id long, block long, kind string, confidence string, final long, has_default boolean")
    branches = spark.createDataFrame([], "function_id long, block long, ord long, container long, kind string, label string")
    got = control.structured_control_edges(blocks, containers, controls, branches)
    assert "FlatMapGroupsInPandas" not in plan(got)
    assert sorted((r["function_id"], r["source"], r["target"]) for r in got.collect()) == [(n, *x) for n in range(20) for x in ((-1, 1), (1, 2), (2, -2))]


def test_names_meet_once(spark):
    """pairs are not brought together again; an identifier with several rows still gives each pair once, with its first kind of name."""
    columns = "id string, file_path string, name string"
    units = spark.createDataFrame([("u1", "/a", "Load_Item"), ("u2", "/a", "x.load"), ("u2", "/a", "load"), ("u3", "/a", "models"), ("u4", None, "load"), ("u5", "/a", "--")], columns)
    functions = spark.createDataFrame([("f1", "/a", "loadItem", "loadItem"), ("f2", "/a", "other", "m.load"), ("f2", "/a", "xload", "q.xload"), ("f3", "/a", "a", "b.models"), ("f4", "/b", "load", "load")], columns + ", qualified_name string")
    bound = binding.name_bindings(units, functions)
    assert sorted(map(tuple, bound.collect())) == [("u1", "f1", "name"), ("u2", "f2", "name")]
    single = binding.name_bindings(units.filter("id = 'u1'"), functions.filter("id = 'f1'"))
    assert plan(single).index("Union") < plan(single).index("Join")


def test_innermost_blocks_by_function(spark):
    """a row a function and no row a pair; larger functions by a join, with the same results."""
    draw = random.Random(3)
    blocks = [(f, b, draw.choice(("entry", "x", "y")), draw.randrange(3), b, s, s + draw.randrange(9)) for f in range(4) for b in range(20 + 10 * f) for s in (draw.randrange(30),)]
    points = [(f, f"{f}:{p}", s, s + draw.randrange(3)) for f in range(5) for p in range(25) for s in (draw.randrange(32),)]
    want = {}
    for f, p, first, last in points:
        if inside := [(x[6] - x[5], -x[3], x[4], x[1]) for x in blocks if x[0] == f and x[2] != "entry" and x[5] <= first and last <= x[6]]:
            want[p] = min(inside)[3]
    args = spark.createDataFrame(points, "function_id long, point_id string, first long, last long"), spark.createDataFrame(blocks, "function_id long, block_id long, kind string, depth int, ord long, first long, last long")
    for most in (5000, 26, 1):
        got = binding.innermost_blocks(*args, most=most)
        assert want and dict(map(tuple, got.collect())) == want
    assert "collect_list" in plan(binding.innermost_blocks(*args))


def test_lines_are_spared_patterns(spark):
    """a pattern is only tried on lines that hold what it needs; names stay the same."""
    code = ["\t const a = b // c", "catch (e)", "function f(x, y)", "(p, q) => p", "z => z", "k = 1", "k == 1", "import {m, n} from './o'", "let[u, v] = w", "", None, "constant c"]
    python = [" async def f(a, b):", "for i, j in xs:", "with o as p:", "x: int", "x == y", "from m import n", "class C(B):", "", "a, b = c"]
    lines = [("s", "typescript", k, x) for k, x in enumerate(code)] + [("p", "python", k, x) for k, x in enumerate(python)]
    bound = call_resolution.possible_bindings(spark.createDataFrame(lines, "path string, language string, line int, code string"))
    names = {}
    for r in bound.collect():
        names.setdefault((r["path"], r["line"]), set()).add(r["name"])
    script = {0: "a", 1: "e", 2: "fxy", 3: "pq", 4: "z", 5: "k", 7: "mn", 8: "uv"}
    own = {0: "fab", 1: "ij", 2: "p", 3: "x", 5: ("from", "m", "import", "n"), 6: "C", 8: "ab"}
    assert names == {("s", k): set(x) for k, x in script.items()} | {("p", k): set(x) for k, x in own.items()}
    assert 'Contains(code' in plan(bound) or "contains" in plan(bound).lower()


def test_rounds_of_long_ways(spark, monkeypatch):
    """chains, trees and cycles of 400 nodes take few rounds; components and ranks stay whole."""
    rounds = []
    keep = components.kept
    monkeypatch.setattr(components, "kept", lambda df: rounds.append(1) or keep(df))
    chain, cycle = [(k, k + 1) for k in range(400)], [(1000 + k, 1000 + (k + 1) % 400) for k in range(400)]
    legs = [(k, 5000 + k) for k in range(0, 400, 7)] + [(400, 1000), (1200, 3000), (3000, 3001), (3001, 3000), (3001, 3001)]
    got = components.longest_path_ranks(spark.createDataFrame(chain + cycle + legs + [(0, 1)], "src long, dst long")).collect()
    assert len(rounds) < 100
    own = {k: (k, k) for k in range(401)} | {1000 + k: (1000, 401) for k in range(400)} | {5000 + k: (5000 + k, k + 1) for k in range(0, 400, 7)} | {3000: (3000, 402), 3001: (3000, 402)}
    assert {r["node"]: (r["component"], r["rank"]) for r in got} == own and len(got) == len(own)


def test_groups_are_worked_out_once(spark, monkeypatch):
    """what is counted and then collected is worked out once, so no Python runs twice on a function."""
    blocks = spark.createDataFrame([(f, b, "define" if b == 1 else "read", 0) for f in range(6) for b in (1, 2, 3)], "function_id long, block_id long, access string, binding long")
    edges = spark.createDataFrame([(f, b, b + 1, "next") for f in range(6) for b in (1, 2)], "function_id long, src long, dst long, kind string")
    hops = dataflow.value_hops(dataflow.reaching_definitions(blocks, edges), edges)
    ranks = components.forward_ranks(blocks, edges).withColumnsRenamed({"function_id": "scene", "block_id": "node"})
    order = components.rank_order(ranks, edges.withColumnRenamed("function_id", "scene"))
    assert plan(hops).count("MapInArrow") == plan(order).count("MapInArrow") == 1
    assert sorted(map(tuple, hops.collect())) == sorted((f, 0, b, b + 1) for f in range(6) for b in (1, 2))
    assert sorted(map(tuple, order.collect())) == [(f, b, b - 1, b - 1) for f in range(6) for b in (1, 2, 3)]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_lines_are_sorted_once_for_imported_calls(spark, monkeypatch):
    """what all relations of the query start from is worked out once, and its shuffle files go."""
    plans, cleared, keep = [], [], lineage.kept

    def seen(df, clear=False):
        plans.append(plan(df))
        cleared.append(clear)
        return keep(df, clear)

    monkeypatch.setattr(call_resolution, "kept", seen)
    monkeypatch.setattr(fixtures, "kept", seen)
    got = registry.QUERIES["J15_imported_calls"](spark, SF)
    assert sum(p.count("Window [") for p in (*plans, plan(got))) <= 3
    assert all(cleared) and "Window [" in plans[0]
    assert got.filter("confidence = 'resolved'").count() > 0


def test_kept_rows_without_their_shuffle_files(spark):
    """the rows stay, the session's setting too, also when the rows fail."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    rows = spark.range(1000).repartition(3, "id")
    assert sorted(r[0] for r in lineage.kept(rows, clear=True).collect()) == list(range(1000)) == sorted(r[0] for r in rows.collect())
    with pytest.raises(Exception, match="no row"):
        lineage.kept(rows.select(F.raise_error(F.lit("no row")).alias("x")), clear=True)
    assert spark.conf.get(name) == before


def test_imported_calls_of_few_files(spark):
    """each rule of J15 by hand, also for calls, nodes and imports that are there several times."""
    lines = [("a.ts", "typescript", 1, "import f from './b'"), ("a.ts", "typescript", 2, "f()"), ("a.ts", "typescript", 3, "const g = 1"), ("p.py", "python", 1, "from b import f"), ("p.py", "python", 2, "g = f()"), ("q.ts", "typescript", 9, None)]
    imports = [("a.ts", 1, "f", "b.ts", "f"), ("a.ts", 4, "g", "b.ts", "f"), ("a.ts", 5, "h", "b.ts", "f"), ("a.ts", 6, "h", "b.ts", "f"), ("p.py", 1, "f", "b.ts", "two"), ("p.py", None, "k", "b.ts", "f"), ("q.ts", 9, "f", "b.ts", "f")]
    own = [("b", "file", "b.ts", "b.ts", "b.ts", ""), ("b:f", "function", "f", "f", "b.ts", "b"), ("b:two", "function", "two", "two", "b.ts", "b"), ("b:2", "function", "two", "two", "b.ts", "b"), ("b:m", "function", "f", "C.f", "b.ts", "b")]
    callers = [(f"c:{p}", "function", "caller", "caller", p, "cls") for p in ("a.ts", "p.py", "q.ts", "q.ts")]
    external = [(f"x:{n}", "external", n, q, "", "") for n, q in (("f", "f"), ("g", "g"), ("h", "h"), ("k", "k"), ("m", "q.m"))]
    edges = [(f"e:{p}:{n}", "calls", f"c:{p}", f"x:{n}", "unresolved", p) for p in ("a.ts", "p.py", "q.ts") for n in "fghkm"] + [("e:else", "calls", "c:a.ts", "x:f", "unresolved", "q.ts"), ("e:exact", "calls", "c:a.ts", "x:f", "exact", "a.ts")]
    e = spark.createDataFrame(edges, "id string, kind string, source_id string, target_id string, confidence string, file_path string")
    n = spark.createDataFrame(own + callers + external, "id string, kind string, name string, qualified_name string, file_path string, parent_id string")
    found = call_resolution.resolve_imported_calls(e, n, spark.createDataFrame(imports, "path string, import_line int, local_name string, target_path string, imported_name string"), spark.createDataFrame(lines, "path string, language string, line int, code string"))
    assert sorted(map(tuple, found.collect())) == [("e:a.ts:f", "b:f"), ("e:p.py:k", "b:f"), ("e:q.ts:f", "b:f"), ("e:q.ts:f", "b:f")]
    after = call_resolution.with_resolved_calls(e, found.distinct())
    assert after.columns == e.columns and after.count() == len(edges)
    assert after.filter("confidence = 'resolved' AND target_id = 'b:f'").count() == 3
