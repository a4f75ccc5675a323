"""Walks and grouped passes against plain programs and against their other way, on random graphs."""

from __future__ import annotations

import random

import pytest

from codeloom.operators import call_resolution, components, dataflow, traverse


def everything(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_functions(seed, functions=8, blocks=9):
    rnd = random.Random(seed)
    rows, edges, accesses = [], [], []
    for f in range(functions):
        n = rnd.randint(1, blocks)
        rows += [(f, b) for b in range(n)]
        edges += [(f, rnd.randrange(n), rnd.randrange(n), rnd.choice(["next", "next", "true", "repeat", "deferred"])) for _ in range(rnd.randint(0, 2 * n))]
        accesses += [(f, rnd.randint(0, 1), b, rnd.choice(["define", "read", "read"])) for b in range(n)]
    return rows, edges, accesses


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_and_rounds_agree(spark, seed):
    """One pass by function, and rounds of joins for functions beyond the bound, give the same; also mixed."""
    rows, edges, accesses = random_functions(seed)
    blocks = spark.createDataFrame(rows, "function_id long, block_id long")
    ways = spark.createDataFrame(edges, "function_id long, src long, dst long, kind string")
    ranks = components.forward_ranks(blocks, ways)
    told = everything(ranks)
    assert len(told) == len(rows)
    for most in (0, 6):
        assert everything(components.forward_ranks(blocks, ways, most=most)) == told
    scenes, links = ranks.selectExpr("function_id as scene", "block_id as node", "rank"), ways.selectExpr("function_id as scene", "src", "dst")
    order = everything(components.rank_order(scenes, links))
    assert everything(components.rank_order(scenes, links, most=6)) == order == everything(components.rank_order(scenes, links, most=0))
    uses = spark.createDataFrame(accesses, "function_id long, binding long, block_id long, access string")
    met = everything(dataflow.reaching_definitions(uses, ways, 3))
    assert met and everything(dataflow.reaching_definitions(uses, ways, 3, most=6)) == met == everything(dataflow.reaching_definitions(uses, ways, 3, most=0))


def random_graph(seed, n=40, m=45):
    rnd = random.Random(seed)
    nodes = [(f"n{k:02d}", rnd.choice(["function", "method", "external"]), f"n{k}", f"n{k}", "/f", 0, 1) for k in range(n)]
    edges = [(f"e{k:03d}", "calls", f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n + 3):02d}", rnd.choice(["exact", "resolved", "inferred", "unresolved"]), rnd.randint(0, 9)) for k in range(m)]
    return nodes, edges


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int"), spark.createDataFrame(edges, "id string, kind string, source_id string, target_id string, confidence string, start_line int")


@pytest.mark.parametrize(("seed", "budget", "root"), [(1, 12, None), (2, 30, None), (3, 25, "n07"), (4, 60, None), (5, 1, "missing")])
def test_bounded_view(spark, seed, budget, root):
    """The same nodes as a queue that, run dry, goes on from the first candidate left."""
    nodes, edges = random_graph(seed)
    candidates = {n[0]: n[1] for n in nodes}
    inside = [(e[2], e[3]) for e in edges if e[2] in candidates and e[3] in candidates]
    out, into = {}, {}
    for a, b in [(e[2], e[3]) for e in edges]:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    seeds = [root] if root in candidates else [k for k, _ in sorted(((k, len(v)) for k, v in out.items() if k in candidates and k not in into), key=lambda x: (-x[1], x[0]))][:24]
    want, queue, rest = [], [], sorted(candidates, key=lambda k: (candidates[k], k))

    def put(k):
        if len(want) < budget and k not in want and k in candidates:
            want.append(k)
            queue.append(k)

    for k in seeds:
        put(k)
    while len(want) < budget:
        if not queue:
            k = next((c for c in rest if c not in want), None)
            if k is None:
                break
            put(k)
            continue
        k = queue.pop(0)
        for b in sorted(b for a, b in inside if a == k):
            put(b)
        for a in sorted(a for a, b in inside if b == k):
            put(a)
    n, e = frames(spark, nodes, edges)
    got = traverse.bounded_view(n.select("id", "kind"), e, traverse.view_seeds(n, e, root), budget).collect()
    assert sorted(r["id"] for r in got) == sorted(want)
    placed = [r["id"] for r in sorted((r for r in got if r["place"] is not None), key=lambda r: r["place"])]
    assert placed == want[: len(placed)]


@pytest.mark.parametrize(("seed", "depth", "steps"), [(1, 3, 30), (2, 3, 4), (3, 2, 6), (4, 4, 1)])
def test_symbol_flow_counts(spark, seed, depth, steps):
    """Counters of a queue that goes on counting past its limits."""
    nodes, edges = random_graph(seed, 14, 40)
    kinds, order = {n[0]: n[1] for n in nodes}, ["exact", "resolved", "inferred", "unresolved"]
    best = {}
    for e in edges:
        key = (order.index(e[4]), e[5], e[0])
        best[e[2], e[3]] = min(best.get((e[2], e[3]), key), key)
    want = []
    for start in sorted(k for k, v in kinds.items() if v != "external"):
        shown, queue, deepest, dup, deep, late = {start}, [(start, 0)], 0, 0, 0, 0
        while queue:
            at, d = queue.pop(0)
            onward = [t for (s, t), _ in sorted(((k, v) for k, v in best.items() if k[0] == at), key=lambda x: x[1])]
            if d >= depth:
                deep += len(onward)
                continue
            for t in onward:
                if len(shown) >= steps:
                    late += 1
                elif t in shown:
                    dup += 1
                else:
                    shown.add(t)
                    deepest = max(deepest, d + 1)
                    if kinds.get(t) in ("function", "method"):
                        queue.append((t, d + 1))
        want.append((start, len(shown), deepest, dup, deep, late))
    n, e = frames(spark, nodes, edges)
    starts = n.filter("kind <> 'external'").selectExpr("id as start")
    assert everything(traverse.symbol_flow(starts, n, e, depth, steps)) == sorted(want, key=str)


def test_lines_that_may_bind(spark):
    lines = [
        ("a.ts", "typescript", "const { x, y: z } = load() // let q"), ("a.ts", "typescript", "async function go(p, q = 1) {"), ("a.ts", "typescript", "items.map((row) => row.id)"),
        ("a.ts", "typescript", "import { a as b } from 'const c'"), ("a.ts", "typescript", "x == y"), ("a.ts", "typescript", "'//'; w = 3"), ("a.ts", "typescript", "} catch (err) {"), ("a.ts", "typescript", "catch (err) {"),
        ("b.py", "python", "async def f(a, b: int = 3) -> T:"), ("b.py", "python", "with open(p) as fh, lock as lk:"), ("b.py", "python", "if a != b and c <= d:"), ("b.py", "python", "total += n"), ("b.py", "python", "name : str"),
        ("c.go", "go", "x := 1"),
    ]
    df = spark.createDataFrame([(p, lang, n, c) for n, (p, lang, c) in enumerate(lines)], "path string, language string, line long, code string")
    got = {}
    for r in call_resolution.possible_bindings(df).collect():
        got.setdefault(r["line"], set()).add(r["name"])
    assert got == {0: {"x", "y", "z"}, 1: {"go", "p", "q"}, 2: {"row"}, 3: {"a", "as", "b"}, 7: {"err"}, 8: {"async", "def", "f", "a", "b", "int"}, 9: {"fh", "lk"}, 11: {"total"}, 12: {"name"}}


def test_body_ancestors(spark):
    """Chains, a cycle and a block around itself; by function and by rounds."""
    rows = [(1, b, b - 1 if b else None) for b in range(70)] + [(2, 0, 1), (2, 1, 2), (2, 2, 0), (2, 3, 2), (3, 5, 5)]
    blocks = spark.createDataFrame(rows, "function_id long, block_id long, parent_id long")
    want = [(1, b, a, b - a) for b in range(70) for a in range(b)]
    want += [(2, b, a, d) for b, chain in ((0, [1, 2]), (1, [2, 0]), (2, [0, 1]), (3, [2, 0, 1])) for d, a in enumerate(chain, 1)]
    assert everything(dataflow.body_ancestors(blocks)) == sorted(want, key=str)
    assert everything(dataflow.body_ancestors(blocks, most=0)) == sorted(want, key=str)


def test_hops_of_large_functions(spark, monkeypatch):
    """F2 of round 4: functions beyond the bound have the hops that they have below it, with few steps by themselves or many; also mixed."""
    rnd = random.Random(3)
    _, edges, accesses = random_functions(3, functions=10, blocks=16)
    flows = [(f, b, rnd.randrange(16), n) for f, b, n, access in accesses if access == "read" and n % 3 == 0 for _ in range(2)]
    # Chains whose ends alone are related, a cycle, what has no way back, and missing parts.
    chain = [(90, k, k + 1, "next") for k in range(40)] + [(91, k, (k + 1) % 30, "next") for k in range(30)] + [(91, 5, 20, "true"), (92, None, 1, "next"), (92, 2, None, "next"), (92, 7, 8, "next")]
    flows += [(90, 0, 0, 40), (90, 0, 3, 40), (90, 1, 20, 40), (90, 1, 40, 10), (91, 0, 3, 1), (91, 1, 1, 1), (91, 1, 4, 1), (91, None, 6, 4), (92, 0, 2, 1), (92, 1, 9, 8), (92, 1, 9, None), (93, 0, 1, 2)]
    own = spark.createDataFrame(flows, "function_id long, binding long, definition long, read long"), spark.createDataFrame(edges + chain, "function_id long, src long, dst long, kind string")
    told = everything(dataflow.value_hops(*own))
    assert {(90, 0, 3, 40), (90, 1, 20, 40), (90, 1, 40, 10), (91, 0, 3, 1), (91, 1, 1, 1), (91, None, 6, 4), (92, 0, 2, 1), (92, 1, 9, 8)} <= set(told)
    for steps, most in ((dataflow.STEPS, 12), (1, 0)):
        monkeypatch.setattr(dataflow, "STEPS", steps)
        got = dataflow.value_hops(*own, most=most)
        assert got.columns == ["function_id", "binding", "source", "target"] and everything(got) == told


def test_hops_over_long_ways(spark, monkeypatch):
    """F2 of round 4: a way of 300 blocks without a use takes few rounds, and its far end is the hop, not the definitions."""
    rounds, keep = [], dataflow.kept
    monkeypatch.setattr(dataflow, "kept", lambda df: rounds.append(1) or keep(df))
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(300)], "function_id long, src long, dst long")
    flows = spark.createDataFrame([(1, 0, 0, 300), (1, 0, 777, 300), (1, 0, 300, 1)], "function_id long, binding long, definition long, read long")
    assert everything(dataflow.value_hops(flows, edges, most=100)) == [(1, 0, 0, 1), (1, 0, 1, 300)]
    assert len(rounds) < 90
