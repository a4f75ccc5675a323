"""Strongly connected components, their condensation and its ranks, by rounds of joins.

Nodes with at most one edge in or one edge out are taken out first, many in a round, and their neighbours
joined instead, so trees and chains shrink by a constant share a round, however long they are.  What is left of a graph where every node
has several edges in and out goes by rounds of ``HOPS`` steps in one job, as many as its longest shortest way asks for.
Rounds always end: a round takes out a node or the steps take over, labels only fall, and a condensation has no cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .grouped import LARGEST, by_group, larger_groups
from .lineage import kept

#: Steps along edges in one job.
HOPS = 4
#: Share of the edges that a round of taking out nodes has to spare, or steps along the edges take over.
SPARED = 0.1


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id) of every node, ids from 1, and the distinct edges between ids."""
    edges = kept(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).filter("node IS NOT NULL").distinct()
    ids = kept(nodes.select("node", (F.monotonically_increasing_id() + 1).alias("id")))
    one, other = (ids.select(F.col("node").alias(f"n{k}"), F.col("id").alias(f"i{k}")) for k in "12")
    return ids, kept(edges.join(one, F.col("src") == F.col("n1")).join(other, F.col("dst") == F.col("n2")).select(F.col("i1").alias("src"), F.col("i2").alias("dst")))


def _split(edges: DataFrame, turn: int) -> DataFrame:
    """Edges (src, dst, w) with the nodes that this round takes out: ``side`` is 1 where src is one, 2 where dst is one, else 0.

    A node may go that has at most one edge in or one out; of two neighbours that may, one goes: the one with a
    single edge, else by a hash.  Rows with a src below 0 are no edges; they tell what a node starts from.
    """
    true = F.col("src") > 0
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), true.cast("int").alias("o")), F.struct(F.col("dst").alias("node"), true.cast("int").alias("i"), F.lit(0).alias("o")))).alias("e"))
    degrees = ends.select("e.*").filter("node > 0").groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    last = F.when(F.col("i") + F.col("o") > 1, F.lit(1 << 62)).otherwise(F.lit(0))
    may = degrees.filter("i <= 1 OR o <= 1").select("node", (F.shiftrightunsigned(F.xxhash64("node", F.lit(turn)), 2) + last).alias("turn"))
    one, other = (may.select(F.col("node").alias(f"n{k}"), F.col("turn").alias(f"t{k}")) for k in "12")
    both = edges.filter(true).join(one, F.col("src") == F.col("n1")).join(other, F.col("dst") == F.col("n2"))
    waits = both.select(F.when(F.struct("t1", "n1") < F.struct("t2", "n2"), F.col("n2")).otherwise(F.col("n1")).alias("w")).distinct()
    goes = may.join(waits, F.col("node") == F.col("w"), "left_anti")
    one, other = (goes.select(F.col("node").alias(f"n{k}")) for k in "12")
    side = F.when(F.col("n1").isNotNull(), 1).when(F.col("n2").isNotNull(), 2).otherwise(0)
    return kept(edges.join(one, F.col("src") == F.col("n1"), "left").join(other, F.col("dst") == F.col("n2"), "left").select("src", "dst", "w", side.alias("side")))


def _through(split: DataFrame) -> DataFrame:
    """(node, src, dst, w): the ways through the nodes that go; no more than their edges, as one side has one at most."""
    into = split.filter("side = 2").select(F.col("dst").alias("node"), "src", F.col("w").alias("w1"))
    out = split.filter("side = 1").select(F.col("src").alias("n"), "dst", F.col("w").alias("w2"))
    return into.join(out, F.col("node") == F.col("n")).select("node", "src", "dst", (F.col("w1") + F.col("w2")).alias("w"))


def _without(split: DataFrame) -> DataFrame:
    """The edges without the nodes that go: the longest of each pair."""
    source = F.when(F.col("src") < 0, -F.col("dst")).otherwise(F.col("src"))
    longer = _through(split).filter("src <> dst").select(source.alias("src"), "dst", "w")
    return kept(split.filter("side = 0").select("src", "dst", "w").unionByName(longer).groupBy("src", "dst").agg(F.max("w").alias("w")))


def _shrunk(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds that take out nodes, first to last, and the edges that are left."""
    rounds, size = [], edges.count()
    while size:
        split = _split(edges, len(rounds))
        edges, before = _without(split), size
        rounds.append(split)
        size = edges.count()
        if size > (1 - SPARED) * before:
            break
    return rounds, edges


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest label that reaches each node along the edges (src -> dst), to its fixpoint."""
    while True:
        now = labels.select("node", "label", F.col("label").alias("was"))
        for _ in range(HOPS):
            sent = edges.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("label").alias("got"))
            now = now.join(sent, F.col("node") == F.col("dst"), "left").select("node", F.least("label", "got").alias("label"), "was")
        now = kept(now)
        labels = now.select("node", "label")
        if now.filter("label < was").isEmpty():
            return labels


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) of some whole components, and the edges between the nodes of the others.

    Nodes are coloured with the smallest node that reaches them; inside a colour, the nodes that reach the colour's own node are
    its component.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    colours = _spread(nodes.select("node", F.col("node").alias("label")), edges)
    one, other = colours.select(F.col("node").alias("a"), F.col("label").alias("la")), colours.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    same = edges.join(one, F.col("src") == F.col("a")).join(other, F.col("dst") == F.col("b")).filter("la = lb")
    # Backwards inside a colour: 0 spreads from the colour's own node.
    back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    marks = _spread(colours.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label")), kept(back))
    found = kept(colours.join(marks.filter("label = 0").select(F.col("node").alias("m")), F.col("node") == F.col("m"), "left_semi"))
    gone = found.select(F.col("node").alias("g"))
    # Edges between colours are in no component.
    rest = same.select("src", "dst", "w").join(gone, F.col("src") == F.col("g"), "left_anti").join(gone, F.col("dst") == F.col("g"), "left_anti")
    return found, kept(rest)


def _strong(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in a component of two or more; edges between ids, of which the label is any member.

    A node that was taken out is of the component of the nodes before and behind it when these share one, else by itself.
    """
    edges = edges.filter("src <> dst").select("src", "dst", F.lit(1).alias("w"))
    rounds, labels = [], edges.select(F.col("src").alias("node"), F.col("dst").alias("label")).limit(0)
    while True:
        more, edges = _shrunk(edges)
        rounds += more
        if edges.isEmpty():
            break
        found, edges = _coloured(edges)
        labels = labels.unionByName(found)
    labels = kept(labels)
    for split in reversed(rounds):
        one, other = (labels.select(F.col("node").alias(f"n{k}"), F.col("label").alias(f"l{k}")) for k in "12")
        of = F.coalesce("l1", "src")
        ways = _through(split).join(one, F.col("src") == F.col("n1"), "left").join(other, F.col("dst") == F.col("n2"), "left")
        labels = kept(labels.unionByName(ways.filter(of == F.coalesce("l2", "dst")).groupBy("node").agg(F.min(of).alias("label"))))
    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()
    many = labels.groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return kept(labels.join(many, F.col("label") == F.col("l"), "left_semi"))


def _named(strong: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, id, component, first, size) of nodes in components of two or more: the smallest member by name, its id and the number of members."""
    members = strong.withColumnRenamed("node", "n").join(ids, F.col("n") == F.col("id")).select("node", "id", "label")
    least = members.groupBy(F.col("label").alias("l")).agg(F.min(F.struct("node", "id")).alias("least"), F.count(F.lit(1)).alias("size"))
    return kept(members.join(least, F.col("label") == F.col("l")).select("node", "id", F.col("least.node").alias("component"), F.col("least.id").alias("first"), "size"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in a strongly connected component of two or more; component is the smallest member.

    ``edges`` has src and dst; repeated edges and self-loops change nothing.
    """
    ids, ways = _numbered(edges.filter("src <> dst"))
    return _named(_strong(ways), ids).select("node", "component")


def _condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id, component, first, size, cyclic) of every node, and the distinct edges between the components' first ids."""
    ids, ways = _numbered(edges)
    strong = _named(_strong(ways), ids).select(F.col("id").alias("s"), "component", "first", "size")
    loops = ways.filter("src = dst").select(F.col("src").alias("l"))
    labelled = ids.join(strong, F.col("id") == F.col("s"), "left").join(loops, F.col("id") == F.col("l"), "left")
    members = kept(
        labelled.select("node", "id", F.coalesce("component", "node").alias("component"), F.coalesce("first", "id").alias("first"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), (F.col("size").isNotNull() | F.col("l").isNotNull()).alias("cyclic"))
    )
    one, other = (strong.select(F.col("s").alias(f"s{k}"), F.col("first").alias(f"f{k}")) for k in "12")
    ends: tuple[Column, Column] = F.coalesce("f1", "src"), F.coalesce("f2", "dst")
    between = ways.join(one, F.col("src") == F.col("s1"), "left").join(other, F.col("dst") == F.col("s2"), "left").filter(ends[0] != ends[1])
    return members, between.select(ends[0].alias("src"), ends[1].alias("dst")).distinct()


def condensation(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component, size, cyclic) of every node, and the distinct edges (src, dst) between components.

    A component is cyclic when it has several nodes or a self-loop.
    """
    members, between = _condensed(edges)
    one, other = (members.filter("id = first").select(F.col("id").alias(f"i{k}"), F.col("component").alias(f"c{k}")) for k in "12")
    named = between.join(one, F.col("src") == F.col("i1")).join(other, F.col("dst") == F.col("i2")).select(F.col("c1").alias("src"), F.col("c2").alias("dst"))
    return members.select("node", "component", "size", "cyclic"), named


def _longest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rank): longest-path ranks of acyclic edges (src, dst) between ids.

    A node that goes leaves the longest ways through it; its own rank follows from the nodes before it, once those have theirs.
    """
    start = nodes.select((-F.col("node")).alias("src"), F.col("node").alias("dst"), F.lit(0).alias("w"))
    rounds, rest = _shrunk(kept(start.unionByName(edges.select("src", "dst", F.lit(1).alias("w")))))
    ranks = kept(rest.filter("src < 0").select(F.col("dst").alias("node"), F.col("w").alias("rank")))
    rest = rest.filter("src > 0")
    while not ranks.isEmpty():
        now = ranks.select("node", "rank", F.col("rank").alias("was"))
        for _ in range(HOPS):
            pushed = rest.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.max(F.col("rank") + F.col("w")).alias("least"))
            now = now.join(pushed, F.col("node") == F.col("dst"), "left").select("node", F.greatest("rank", "least").alias("rank"), "was")
        now = kept(now)
        ranks = now.select("node", "rank")
        if now.filter("rank > was").isEmpty():
            break
    for split in reversed(rounds):
        known = ranks.select(F.col("node").alias("n"), "rank")
        own = split.filter("side = 2").join(known, F.col("src") == F.col("n"), "left").groupBy(F.col("dst").alias("node")).agg(F.max(F.coalesce("rank", F.lit(0)) + F.col("w")).alias("rank"))
        ranks = kept(ranks.unionByName(own))
    return ranks


def _ranks(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(keys, node, rank, open): longest-path ranks of acyclic edges (keys, src, dst).

    ``most`` bounds the rounds where edges may have cycles; nodes that still rise then are open.
    """
    ranks = kept(nodes.select(*keys, "node", F.lit(0).alias("rank")))
    rounds = 0
    while True:
        now = ranks.select(*keys, "node", "rank", F.col("rank").alias("was"))
        for _ in range(HOPS):
            pushed = edges.join(now.select(*keys, F.col("node").alias("src"), "rank"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg((F.max("rank") + 1).alias("least"))
            now = now.join(pushed, [*keys, "node"], "left").select(*keys, "node", F.greatest("rank", "least").alias("rank"), "was")
        now = kept(now)
        ranks, rounds = now.select(*keys, "node", "rank"), rounds + 1
        still = now.filter("rank > was").isEmpty()
        if still or (most is not None and rounds * HOPS > most):
            return now.select(*keys, "node", "rank", (F.col("rank") > F.col("was")).alias("open"))


def longest_path_ranks(edges: DataFrame) -> DataFrame:
    """(node, component, rank): 0 for components that none precedes, else one more than the highest before.

    Cycles count as one component each, so every graph has ranks and the rounds end.
    """
    members, between = _condensed(edges)
    ranks = _longest(members.filter("id = first").select(F.col("id").alias("node")), between).select(F.col("node").alias("r"), "rank")
    return members.join(ranks, F.col("first") == F.col("r")).select("node", "component", "rank")


def forward_ranks(blocks: DataFrame, edges: DataFrame, back_kinds: tuple[str, ...] = ("repeat",), most: int = LARGEST) -> DataFrame:
    """C4: (function_id, block_id, rank) of the blocks of all functions at once, edges backwards left out.

    A block that is still in a forward cycle, or behind one, comes after all others of its function, in source order.
    Functions are worked out one by one after a single shuffle; those of more than ``most`` blocks or edges by rounds of joins.
    """
    # Counted and collected: two uses of what may be long to work out.
    forward = kept(edges.filter(~F.col("kind").isin(*back_kinds) & (F.col("src") != F.col("dst"))).select("function_id", "src", "dst").distinct())
    nodes = kept(blocks.select("function_id", F.col("block_id").alias("node")).distinct())
    large = kept(larger_groups([nodes, forward], "function_id", most))
    own = lambda df: df.join(large.withColumnRenamed("function_id", "big"), F.col("function_id") == F.col("big"), "left_anti")

    def ranked(function: object, ids: list, sources: list, targets: list) -> Iterator[tuple]:
        rank, open_ = _layered(ids, list(zip(sources, targets, strict=True)))
        top = max(rank.values(), default=0)
        yield from ((function, n, r) for n, r in rank.items())
        yield from ((function, n, top + k) for k, n in enumerate(sorted(open_), 1))

    schema = StructType([nodes.schema["function_id"], StructField("block_id", nodes.schema["node"].dataType), StructField("rank", IntegerType())])
    small = by_group("function_id", {"nodes": own(nodes), "edges": own(forward)}, ranked, schema)
    if large.isEmpty():
        return small
    of = lambda df: df.join(large, "function_id", "left_semi")
    return small.unionByName(_forward_ranks_by_rounds(of(nodes), of(forward)))


def _layered(ids: list, pairs: list[tuple]) -> tuple[dict, set]:
    """(longest-path rank of each node, nodes in a cycle or behind one)."""
    known, after, waits = set(ids), {}, dict.fromkeys(ids, 0)
    for a, b in pairs:
        if a in known and b in known:
            after.setdefault(a, []).append(b)
            waits[b] += 1
    rank, ready = {}, [n for n in ids if not waits[n]]
    least = dict.fromkeys(ids, 0)
    while ready:
        n = ready.pop()
        rank[n] = least[n]
        for m in after.get(n, ()):
            least[m] = max(least[m], rank[n] + 1)
            waits[m] -= 1
            if not waits[m]:
                ready.append(m)
    return rank, known - rank.keys()


def _forward_ranks_by_rounds(nodes: DataFrame, forward: DataFrame) -> DataFrame:
    """As :func:`forward_ranks`, without a bound on a function's blocks."""
    forward = kept(forward)
    largest = nodes.groupBy("function_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # Blocks that cannot be settled: of a cycle or behind one; what is left of the edges after peeling.
    rest, size = forward, -1
    for _ in range(0, largest + 1, HOPS):
        for _ in range(HOPS):
            entered = rest.select("function_id", F.col("dst").alias("src")).distinct()
            rest = rest.join(entered, ["function_id", "src"], "left_semi")
        rest = kept(rest)
        if (now := rest.count()) in (0, size):
            break
        size = now
    open_ = rest.select("function_id", F.col("dst").alias("node")).distinct()
    settled = forward.join(open_.select("function_id", F.col("node").alias("dst"), F.lit(True).alias("cut")), ["function_id", "dst"], "left").filter("cut IS NULL").select("function_id", "src", "dst")
    ranks = _ranks(nodes, settled, ("function_id",)).join(open_.withColumn("late", F.lit(True)), ["function_id", "node"], "left")
    own = Window.partitionBy("function_id")
    top = F.coalesce(F.max(F.when(F.col("late").isNull(), F.col("rank"))).over(own), F.lit(0))
    late = F.sum(F.when(F.col("late"), 1).otherwise(0)).over(own.orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    return ranks.select("function_id", F.col("node").alias("block_id"), F.when(F.col("late"), top + late).otherwise(F.col("rank")).cast("int").alias("rank"))


def rank_order(ranks: DataFrame, edges: DataFrame, scene: str = "scene", most: int = LARGEST) -> DataFrame:
    """(scene, node, rank, position): the order of drawing in each scene.

    Ranks are placed one after the other, inside a rank by the mean position of the predecessors, those
    without any last, then by name.  Scenes are worked out one by one after a single shuffle; those of more than ``most`` nodes or edges by a round for each rank.
    """
    own, ways = kept(ranks.select(scene, "node", "rank")), kept(edges.select(scene, "src", "dst"))
    large = kept(larger_groups([own, ways], scene, most))
    less = lambda df: df.join(large.withColumnRenamed(scene, "big"), F.col(scene) == F.col("big"), "left_anti")

    def ordered(key: object, nodes: list, levels: list, sources: list, targets: list) -> Iterator[tuple]:
        before: dict = {}
        for a, b in zip(sources, targets, strict=True):
            before.setdefault(b, []).append(a)
        by_level: dict[int, list] = {}
        for n, r in zip(nodes, levels, strict=True):
            by_level.setdefault(r, []).append(n)
        place: dict = {}
        for r in sorted(by_level):
            at = {n: [place[a] for a in before.get(n, ()) if a in place] for n in by_level[r]}
            for n in sorted(by_level[r], key=lambda n: (not at[n], sum(at[n]) / len(at[n]) if at[n] else 0.0, n)):
                yield key, n, r, len(place)
                place[n] = len(place)

    schema = StructType([own.schema[scene], own.schema["node"], own.schema["rank"], StructField("position", LongType())])
    small = by_group(scene, {"nodes": less(own), "edges": less(ways)}, ordered, schema)
    if large.isEmpty():
        return small
    of = lambda df: df.join(large, scene, "left_semi")
    return small.unionByName(_rank_order_by_rounds(of(own), of(ways), scene))


def _rank_order_by_rounds(ranks: DataFrame, edges: DataFrame, scene: str) -> DataFrame:
    """As :func:`rank_order`, without a bound on a scene's nodes."""
    ranks = kept(ranks.select(scene, "node", "rank"))
    last = ranks.agg(F.max("rank")).first()[0]
    own = Window.partitionBy(scene)
    placed = None
    for r in range((-1 if last is None else last) + 1):
        here = ranks.filter(F.col("rank") == r)
        if placed is None:
            centred, before = here.withColumn("centre", F.lit(None).cast("double")), None
        else:
            at = placed.select(scene, F.col("node").alias("src"), "position")
            centre = edges.join(at, [scene, "src"]).groupBy(scene, F.col("dst").alias("node")).agg(F.avg("position").alias("centre"))
            centred, before = here.join(centre, [scene, "node"], "left"), placed.groupBy(scene).agg(F.count(F.lit(1)).alias("before"))
        numbered = centred.withColumn("n", F.row_number().over(own.orderBy(F.asc_nulls_last("centre"), "node")))
        shifted = numbered.withColumn("before", F.lit(0)) if before is None else numbered.join(before, scene, "left")
        level = shifted.select(scene, "node", "rank", (F.col("n") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("position"))
        placed = kept(level if placed is None else placed.unionByName(level))
    return ranks.withColumn("position", F.lit(None).cast("long")) if placed is None else placed
