"""Small graphs with known answers, a simulation of the ordered traversal, and shuffled inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.operators import binding, components, dataflow, extract, files, flows, index, layers, ownership, search, selection, traverse


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [
            ("entry", "function", "main", "main", "/ws/a.py", 1, 5),
            ("service", "method", "handle", "Service.handle", "/ws/a.py", 10, 20),
            ("utility", "function", "util", "util", "/ws/b.py", 1, 5),
            ("ctor", "constructor", "init", "Service.init", "/ws/b.py", 10, 12),
            ("external:pkg.call", "external", "call", "pkg.call", "", 0, 0),
            ("external:unused", "external", "unused", "unused", "", 0, 0),
        ],
        "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int",
    )
    edges = spark.createDataFrame(
        [
            ("e1", "calls", "entry", "service", "exact", 2),
            ("e2", "calls", "service", "external:pkg.call", "resolved", 11),
            ("e3", "calls", "service", "missing-call-target", "unresolved", 12),
            ("e4", "calls", "entry", "utility", "inferred", 3),
            ("e5", "calls", "service", "utility", "exact", 13),
        ],
        "id string, kind string, source_id string, target_id string, confidence string, start_line int",
    )
    return nodes, edges


def test_function_index(graph):
    nodes, edges = graph
    calls = index.resolved_calls(nodes, edges)
    s = index.summary(nodes, calls).first()
    assert (s["callables"], s["call_edges"], s["external_calls"], s["unresolved_calls"], s["inferred_edges"]) == (4, 5, 1, 1, 1)
    described = {r["id"]: r for r in index.described(index.fan(nodes, calls)).collect()}
    assert (described["entry"]["role"], described["entry"]["callers"], described["entry"]["callees"]) == ("entrypoint", 0, 2)
    assert described["service"]["tags"] == ["externalCall", "unresolvedCall"]
    assert (described["utility"]["role"], described["utility"]["tags"]) == ("utility", ["leaf", "sharedUtility"])
    assert set(described) == {"entry", "service", "utility", "ctor"}
    assert rows(index.hotspots(index.fan(nodes, calls)), "id", "score", "candidates") == [("entry", 2, 3), ("service", 3, 3), ("utility", 2, 3)]


def test_unresolved_confidence_overrides_a_known_target(graph, spark):
    nodes, _ = graph
    edge = spark.createDataFrame([("x", "calls", "entry", "utility", "unresolved", 1)], "id string, kind string, source_id string, target_id string, confidence string, start_line int")
    assert index.resolved_calls(nodes, edge).first()["is_unresolved"]


def test_results_do_not_depend_on_order(graph):
    nodes, edges = graph
    again = [index.hotspots(index.fan(n, index.resolved_calls(n, e))).collect() for n, e in ((nodes, edges), (nodes.repartition(3).orderBy(F.rand(1)), edges.repartition(5, "confidence")))]
    assert again[0] == again[1]


def fifo(start, out, depth_limit, step_limit):
    seen, order, queue = {start}, [], [(start, 0)]
    for node, depth in queue:
        if depth == depth_limit:
            continue
        for to in out.get(node, []):
            if to not in seen:
                if len(order) == step_limit:
                    return order
                seen.add(to)
                order.append((to, depth + 1, node))
                queue.append((to, depth + 1))
    return order


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_bfs_equals_a_queue(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{k}" for k in range(25)]
    edges = [(f"e{k:03}", "calls", rnd.choice(names), rnd.choice(names), rnd.choice(S.CONFIDENCE), rnd.randint(0, 9)) for k in range(60)]
    df = spark.createDataFrame(edges, "id string, kind string, source_id string, target_id string, confidence string, start_line int")
    best: dict[tuple, tuple] = {}
    for i, _, s, t, c, line in edges:
        key = (S.CONFIDENCE.index(c), line, i)
        best[s, t] = min(best.get((s, t), key), key)
    out: dict[str, list] = {}
    for (s, t), key in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        out.setdefault(s, []).append(t)
    starts = spark.createDataFrame([(n,) for n in names[:6]], "start string")
    depth, steps = rnd.randint(2, 3), rnd.randint(4, 9)
    got: dict[str, list] = {}
    for r in traverse.ordered_bfs(starts, df, "out", depth, steps).filter("depth > 0").orderBy("start", "position").collect():
        got.setdefault(r["start"], []).append((r["node"], r["depth"], r["parent"]))
    for n in names[:6]:
        assert got.get(n, []) == fifo(n, out, depth, steps)


def test_change_impact(spark):
    calls = [("a", "service", "target", "resolved"), ("b", "indirect", "service", "exact"), ("c", "direct", "target", "inferred"), ("d", "target", "service", "exact")]
    edges = spark.createDataFrame([(i, "calls", s, t, c, 1) for i, s, t, c in calls], "id string, kind string, source_id string, target_id string, confidence string, start_line int")
    got = {r["caller_id"]: r for r in traverse.change_impact(spark.createDataFrame([("target",)], "start string"), edges).collect()}
    assert {k: (r["depth"], r["confidence"]) for k, r in got.items()} == {"service": (1, "resolved"), "direct": (1, "inferred"), "indirect": (2, "resolved")}
    assert got["indirect"]["path"] == ["indirect", "service", "target"]


def test_strong_components_and_ranks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (7, 9)], "src long, dst long")
    assert rows(components.strong_components(edges), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert rows(components.longest_path_ranks(edges.filter("src >= 6")), "node", "rank") == [(6, 0), (7, 0), (8, 1), (9, 2)]
    members, between = components.condensation(edges)
    assert rows(members.filter("cyclic"), "node", "component", "size") == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2), (6, 6, 1)]
    assert rows(between, "src", "dst") == [(1, 4), (7, 8), (7, 9), (8, 9)]


def test_ranks_of_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e")], "src string, dst string")
    assert rows(components.longest_path_ranks(edges), "node", "component", "rank") == [("a", "a", 0), ("b", "a", 0), ("c", "c", 1), ("d", "c", 1), ("e", "e", 0)]
    assert components.longest_path_ranks(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_by_reach(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(20)]
    reach = {a: {a} for p in pairs for a in p}
    for _ in range(len(reach)):
        for a, b in pairs:
            reach[a] |= reach[b]
    want = sorted((a, min(b for b in reach[a] if a in reach[b])) for a in reach if any(b != a and a in reach[b] for b in reach[a]))
    assert rows(components.strong_components(spark.createDataFrame(pairs, "src long, dst long")), "node", "component") == want


def test_forward_ranks_and_order(spark):
    blocks = spark.createDataFrame([(f, b) for f in (1, 2) for b in range(1, 6)], "function_id long, block_id long")
    edges = spark.createDataFrame([(1, 1, 2, "next"), (1, 1, 3, "true"), (1, 2, 4, "next"), (1, 3, 4, "next"), (1, 4, 1, "repeat"), (1, 1, 4, "next"), (2, 1, 2, "next"), (2, 2, 3, "next"), (2, 3, 2, "next"), (2, 3, 4, "next")], "function_id long, src long, dst long, kind string")
    ranks = components.forward_ranks(blocks, edges)
    # Of function 2, blocks 2 and 3 are a cycle that 4 waits for; 5 stands alone.
    assert rows(ranks, "function_id", "block_id", "rank") == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 0), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3), (2, 5, 0)]
    scene = spark.createDataFrame([("s", "a", 0), ("s", "b", 0), ("s", "x", 1), ("s", "y", 1), ("s", "z", 1), ("t", "a", 0)], "scene string, node string, rank int")
    links = spark.createDataFrame([("s", "b", "x"), ("s", "a", "y"), ("s", "b", "y")], "scene string, src string, dst string")
    # y has its mean before x; z, which nothing precedes, comes last.
    assert rows(components.rank_order(scene, links), "scene", "position", "node") == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "y"), ("s", 3, "x"), ("s", 4, "z"), ("t", 0, "a")]


def test_reaching_definitions(spark):
    # entry 1, define 2, loop 3, body 4, read 5
    blocks = spark.createDataFrame([(0, 2, "define", 0), (0, 5, "read", 0)], "function_id long, block_id long, access string, binding long")
    edges = spark.createDataFrame([(0, 1, 2, "next"), (0, 2, 3, "next"), (0, 3, 4, "next"), (0, 4, 3, "repeat"), (0, 3, 5, "next"), (0, 3, 5, "next"), (0, 1, 5, "deferred")], "function_id long, src long, dst long, kind string")
    assert dataflow.reaching_definitions(blocks, edges, 1).count() == 0
    assert rows(dataflow.reaching_definitions(blocks, edges, 5), "definition", "read", "depth") == [(2, 5, 2)]


def test_ownership_is_by_segments(spark):
    files = spark.createDataFrame([(p,) for p in ("/w/apps/api/x.py", "/w/apps/api-client/y.py", "/w/apps/api/plugins/z.py", "/other/q.py")], "file_path string")
    roots = spark.createDataFrame([(r, "x") for r in ("/w", "/w/apps/api", "/w/apps/api/plugins")], "root_key string, basis string")
    assert dict(rows(ownership.owners(files, roots), "path", "module")) == {"/w/apps/api/x.py": "/w/apps/api", "/w/apps/api-client/y.py": "/w", "/w/apps/api/plugins/z.py": "/w/apps/api/plugins"}


def test_ancestor_closed_top(spark):
    modules = spark.createDataFrame([("/w", None, 1), ("/w/a", "/w", 2), ("/w/a/b", "/w/a", 9), ("/w/c", "/w", 5)], "module string, parent string, score long")
    assert rows(ownership.ancestor_closed_top(modules, 3), "module", "position") == [("/w", 1), ("/w/a", 2), ("/w/a/b", 3)]
    assert rows(ownership.ancestor_closed_top(modules, 2), "module", "position") == [("/w", 1), ("/w/c", 2)]


@pytest.mark.parametrize(
    ("path", "key"),
    [("/a/./b//c", "/a/b/c"), ("/a/../../b", "/b"), ("a/../../b", "../b"), (r"C:\Work\..\X", "c:/x"), ("/", "/"), ("a/b/", "a/b")],
)
def test_path_key(spark, path, key):
    assert spark.createDataFrame([(path,)], "p string").select(S.path_key(F.col("p"))).first()[0] == key


def test_scalars(spark):
    one = spark.createDataFrame([("  Ab-C ", "a.b::c/d", "x y!~*'()é", "😀a", "query.user", "packages/core/x.ts", "see /home/me/x", "\x00\x01")], "a string, b string, c string, d string, e string, f string, g string, h string")
    got = one.select(
        S.normalise_text(F.col("a")), S.normalise_identifier(F.col("a")), S.name_segments(F.col("b")), S.encode_uri_component(F.col("c")), S.utf16_length(F.col("d")), S.graphql_operation(F.col("e")), S.source_area(F.col("f")), S.leaks_host_path(F.col("g")), S.safe_label(F.col("h"), "none")
    ).first()
    assert list(got) == ["ab-c", "abc", ["a", "b", "c", "d"], "x%20y!~*'()%C3%A9", 3, "query", "packages/core", True, "none"]


def test_cursor():
    c = search.Cursor("q", "v1", 20)
    assert c.offset(c.at(40)) == 40
    assert c.offset(c.at(40)[:-2] + "xx") is None and c.offset("!") is None
    assert search.Cursor("other", "v1", 20).offset(c.at(40)) is None


def test_search_pages_are_exact(spark):
    df = spark.range(1000).select(F.format_string("n%04d", "id").alias("id"), F.concat(F.lit("Name_%"), F.col("id")).alias("name"), F.lit("q").alias("qualified_name"), F.lit("f").alias("file_path"), F.lit(1).alias("start_line"), F.lit("unknown").alias("role"), *[F.lit(0).alias(c) for c in ("callers", "callees", "unresolved_calls", "external_calls")])
    found = search.scored(df, "name_%")
    first, cursor = search.page(found, "name_%", "v", 100)
    second, _ = search.page(found, "name_%", "v", 100, cursor)
    assert first.count() == second.count() == 100 and first.first()["total"] == 1000
    assert first.select("id").intersect(second.select("id")).count() == 0
    assert search.page(found, "name_%", "v", 100, "bad")[0].count() == 0
    assert search.scored(df, "name__").count() == 0


def test_binding(spark):
    units = spark.createDataFrame([("u", "FastAPI", "route", "Do It", "/f", 1, 10)], "id string, framework string, kind string, name string, file_path string, start_line int, end_line int")
    functions = spark.createDataFrame([("f", "do_it", "mod.do_it", "/f", 2, 9), ("g", "x", "y", "/f", 9, 20), ("h", "x", "y", "/g", 2, 3)], "id string, name string, qualified_name string, file_path string, start_line int, end_line int")
    assert rows(binding.place_bindings(units, functions), "function_id", "evidence") == [("f", "contains"), ("g", "overlaps")]
    assert rows(binding.name_bindings(units, functions), "function_id", "evidence") == [("f", "name")]


@pytest.mark.parametrize(
    ("path", "layer"),
    [
        ("/x/tests/domain/a.py", "test"), ("src/a.test.ts", "test"), ("src/test_a.py", "test"), ("/x/domain/a.py", "domain"), ("/x/y.py", "unclassified"), ("svc/adapters/in/a.py", "interface"), ("svc/adapters/out/a.py", "infrastructure"),
        ("svc/adapters/a.py", "unclassified"), ("a/usecases/b.py", "application"), ("a/orm/b.py", "dataAccess"), ("a/controllers/b.py", "interface"), ("a/logging/b.py", "crossCutting"), ("a/clients/b.py", "infrastructure"),
        ("infra/repositories/b.py", "dataAccess"), ("services/b.py", "unclassified"), ("adapters/in/adapters/out/x.py", "infrastructure"), ("", "unclassified"),
    ],
)
def test_layers(spark, path, layer):
    assert spark.createDataFrame([(path,)], "p string").select(layers.path_layer(F.col("p"))).first()[0] == layer


def test_assessed_layers(spark):
    functions = spark.createDataFrame([("a", "domain/x.py"), ("b", "domain/ports/x.py"), ("c", "x.py"), ("d", "domain/x.py"), ("e", "tests/x.py"), ("f", "application/x.py")], "id string, file_path string")
    bindings = spark.createDataFrame([("c", "service"), ("c", "schema"), ("d", "route"), ("e", "route")], "function_id string, unit_kind string")
    got = layers.assess(functions, bindings)
    assert rows(got, "id", "layer", "conflicted", "business") == [
        ("a", "domain", False, "domainRuleCandidate"), ("b", "domain", False, "notBusinessLogic"), ("c", "application", False, "applicationWorkflowCandidate"),
        ("d", "unclassified", True, None), ("e", "test", False, None), ("f", "application", False, "applicationWorkflowCandidate"),
    ]
    assert tuple(layers.layer_summary(got).first()) == (6, 5, 3, 1)


UNIT = "id string, framework string, kind string, file_path string, start_line int"


def test_semantic_flows(spark):
    """A direct handler wins over a routed one, a routed one serves where there is none, ties are ambiguous."""
    units = spark.createDataFrame([(u, "F", k, f"/{u}", 1) for u, k in (("r1", "route"), ("r2", "route"), ("r3", "route"), ("r4", "route"), ("o1", "operation"), ("s1", "service"), ("s2", "service"))], UNIT)
    bindings = spark.createDataFrame([("r1", "f1", "contains"), ("s1", "f2", "contains"), ("s2", "f3", "overlaps"), ("s2", "f4", "overlaps"), ("o1", "f5", "overlaps"), ("o1", "f6", "contains")], "unit_id string, function_id string, evidence string")
    edges = spark.createDataFrame([("r1", "s1", "exact"), ("r2", "s1", "inferred"), ("r2", "s1", "resolved"), ("r3", "s2", "exact"), ("r4", "missing", "exact"), ("o1", "s1", "exact")], "source_id string, target_id string, confidence string").withColumn("kind", F.lit("routesTo"))
    flow = flows.semantic_flows(units, bindings, edges)
    assert rows(flow, "entry_id", "status", "handler_id", "candidates", "target_units", "rank") == [
        ("o1", "mapped", "f6", 1, 0, 0), ("r1", "mapped", "f1", 1, 1, 0), ("r2", "mapped", "f2", 1, 1, 1), ("r3", "ambiguous", None, 2, 1, 2), ("r4", "handlerNotMapped", None, 0, 0, None),
    ]
    assert tuple(flows.flow_summary(flow).first()) == (5, 4, 1, 3, 1, 1, 0, 1)


def test_risk_radar(spark):
    nodes = spark.createDataFrame([(n, "function") for n in ("f1", "f2", "f3", "f4", "f5")] + [("x", "external")], "id string, kind string")
    calls = [("e1", "f1", "f2", "exact"), ("e2", "f2", "f3", "exact"), ("e3", "f3", "f4", "exact"), ("e4", "f4", "f5", "exact"), ("e5", "f1", "gone", "unresolved"), ("e6", "f1", "x", "resolved"), ("e7", "f2", "lost", "unresolved")]
    edges = spark.createDataFrame([(i, "calls", s, t, c, 1) for i, s, t, c in calls], "id string, kind string, source_id string, target_id string, confidence string, start_line int")
    flow = spark.createDataFrame([("u1", "route", "A", "/a", 1, "mapped", "f1", 0), ("u2", "route", "A", "/b", 2, "mapped", "f1", 0), ("u3", "route", "B", "/c", 3, "ambiguous", None, 2), ("u4", "operation", "B", "/c", 2, "handlerNotMapped", None, None)], "entry_id string, entry_kind string, framework string, entry_path string, entry_line int, status string, handler_id string, rank int")
    steps, gaps = flows.flow_steps(flow, nodes, edges, 3, 25)
    assert rows(steps.filter("entry_id = 'u1'"), "position", "target_id", "depth", "resolution") == [(1, "f2", 1, "concrete"), (2, "x", 1, "external"), (3, "gone", 1, "unresolved"), (4, "f3", 2, "concrete"), (5, "lost", 2, "unresolved"), (6, "f4", 3, "concrete")]
    assert rows(gaps, "entry_id", "steps", "omitted", "step_gap", "depth_gap") == [("u1", 6, 0, False, True), ("u2", 6, 0, False, True)]
    cut, short = flows.flow_steps(flow, nodes, edges, 3, 4)
    assert cut.count() == 8 and rows(short, "entry_id", "steps", "omitted", "step_gap", "depth_gap") == [("u1", 4, 2, True, False), ("u2", 4, 2, True, False)]
    unresolved = flows.unresolved_risks(steps)
    assert rows(unresolved, "source_id", "evidence", "affected", "confidence") == [("f1", 1, 2, "unresolved"), ("f2", 1, 2, "unresolved")]
    roots = spark.createDataFrame([("/c", "/")], "path string, root string")
    by_entry = flows.entrypoint_risks(flow, roots)
    assert rows(by_entry, "framework", "root", "ambiguous", "not_mapped", "evidence", "affected", "confidence", "location", "line") == [("B", "/", 1, 1, 2, 2, "inferred", "/c", 2)]
    told = spark.createDataFrame([("error", "/z"), ("warning", ""), ("information", "/a")], "severity string, file_path string")
    analysis = flows.analysis_risk(told, gaps)
    assert rows(analysis, "evidence", "affected", "location") == [(4, 2, "/z")]
    radar = flows.risk_radar(analysis, by_entry, unresolved, 3).collect()
    assert [(r["kind"], r["id"], r["omitted"]) for r in radar] == [("analysisCoverage", "analysis-coverage", 1), ("entrypointCoverage", "B:/", 1), ("unresolvedExecution", "f1", 1)]


def test_import_roots_and_entries(spark):
    frame = lambda pairs: spark.createDataFrame(pairs, "source string, target string")
    own = spark.createDataFrame([(p,) for p in ("a.ts", "b.ts", "src/main.ts", "tests/t.ts")], "path string")
    assert rows(files.import_roots(own, frame([("a.ts", "b.ts"), ("src/main.ts", "ext")])), "path") == [("a.ts",), ("src/main.ts",)]
    assert rows(files.import_roots(own, frame([("a.ts", "b.ts"), ("b.ts", "a.ts")])), "path") == [("a.ts",), ("b.ts",)]
    assert len(rows(files.import_roots(own, frame([("a.ts", "b.ts")]).limit(0)), "path")) == 4
    assert rows(files.application_entries(own, frame([("a.ts", "b.ts")])), "path", "score") == [("src/main.ts", 122)]
    # The entry point is imported: the roots with most imports serve, tests left out.
    assert rows(files.application_entries(own, frame([("a.ts", "src/main.ts"), ("tests/t.ts", "a.ts"), ("b.ts", "src/main.ts")])), "path") == [("b.ts",)]


def test_import_resolution(spark):
    own = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.ts", "lib/c.js", "pkg/mod/x.py", "pkg/other/x.py", "pkg/__init__.py")], "path string")
    asked = [("src/a.ts", "./b"), ("src/a.ts", "../lib/c"), ("src/b/index.ts", "@/a"), ("src/a.ts", "react"), ("pkg/mod/x.py", "other.x"), ("pkg/mod/x.py", "x"), ("pkg/mod/x.py", "pkg")]
    got = files.resolve_imports(spark.createDataFrame(asked, "source string, specifier string"), own, {"@/*": "src/*"})
    assert {(r["source"], r["specifier"]): r["target"] for r in got.collect()} == {
        ("src/a.ts", "./b"): "src/b/index.ts", ("src/a.ts", "../lib/c"): "lib/c.js", ("src/b/index.ts", "@/a"): "src/a.ts", ("src/a.ts", "react"): None,
        ("pkg/mod/x.py", "other.x"): "pkg/other/x.py", ("pkg/mod/x.py", "x"): None, ("pkg/mod/x.py", "pkg"): "pkg/__init__.py",
    }


def test_bounded_values(spark):
    df = spark.createDataFrame([("a", x) for x in "dcbaabcd"] + [("b", "z"), ("b", None)], "g string, v string")
    assert rows(selection.smallest_values(df, ["g"], "v", 3, "first"), "g", "first", "n") == [("a", ["a", "b", "c"], 4), ("b", ["z"], 1)]


def test_selection(spark):
    df = spark.createDataFrame([("a", "x", 9), ("b", "x", 8), ("c", "y", 1), ("d", "z", 5)], "id string, category string, score int")
    assert [r["id"] for r in selection.one_per_category(df, 3).collect()] == ["a", "d", "c"]
    assert [selection.clamp_limit(v, 7, 10) for v in (None, 3.9, -1, 99, float("nan"))] == [7, 3, 0, 10, 7]


SOURCE = """
import os
from pkg.helpers import tool

class Box:
    def open(self):
        return self.close() + tool(1)

    def close(self):
        return unknown()

def main():
    def inner():
        return main
    inner()
    os.getcwd()
"""


def test_extract_and_resolve(spark):
    sources = spark.createDataFrame([("/ws/a.py", "python", SOURCE), ("/ws/pkg/helpers.py", "python", "def tool(x):\n    return x\n"), ("/ws/bad.py", "python", "def ("), ("/ws/x.ts", "typescript", "")], "path string, language string, content string")
    facts = extract.extract(sources).cache()
    assert rows(facts.filter("fact = 'diagnostic'"), "path", "kind") == [("/ws/bad.py", "analysis.fileFailed")]
    names = dict(rows(extract.symbols(facts), "id", "qualified_name"))
    got = {(names[r["source_id"]], names.get(r["target_id"], r["target_id"]), r["confidence"]) for r in extract.resolve_calls(facts).collect()}
    assert got == {
        ("Box.open", "Box.close", "resolved"),
        ("Box.open", "tool", "resolved"),
        ("Box.close", "external::/ws/a.py::unknown", "unresolved"),
        ("main", "main.inner", "resolved"),
        ("main", "external::/ws/a.py::os.getcwd", "unresolved"),
    }


def test_all_paths_keeps_every_page(spark, tmp_path):
    from codeloom.plans.registry import QUERIES

    urls = ["https://h.org/a/b", "https://h.org/a//b", "https://h.org/./a", "https://h.org/a/../b/", "https://h.org/", "http://h.org/../../x", "https://h.org/.hidden/..", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")

    def by_hand(url):
        done = []
        for part in url.split("://")[1].split("/"):
            if part == "..":
                done = done[:-1]
            elif part not in ("", "."):
                done.append(part)
        return "/" + "/".join(done), len(done)

    want = [(i, *(by_hand(u) if u else (None, None))) for i, u in enumerate(urls)]
    assert rows(QUERIES["F5_F6_paths"](spark, str(tmp_path)), "page_id", "path", "depth") == want


def test_ancestor_closed_top_goes_on_past_long_chains(spark):
    deep = ["/w" + "".join(f"/d{k}" for k in range(n)) for n in range(1, 31)]
    modules = [("/w", None, 1), ("/z", None, 2)] + [(m, m.rsplit("/", 1)[0], 100 + n) for n, m in enumerate(deep)]
    df = spark.createDataFrame(modules, "module string, parent string, score long")
    # The best 28 have chains of more than 3 modules.
    assert rows(ownership.ancestor_closed_top(df, 3), "module", "position") == [("/w", 1), ("/w/d0", 2), ("/w/d0/d1", 3)]
    assert rows(ownership.ancestor_closed_top(df, 1), "module", "position") == [("/z", 1)]


def test_retention_holds_for_any_number_of_scopes(spark, tmp_path):
    from codeloom.plans.registry import QUERIES

    spark.range(250).selectExpr("id * 97 AS event_id", "concat('t', id) AS event_type", "timestamp_seconds(id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["S12_cache_retention"](spark, str(tmp_path)).count() == 250
