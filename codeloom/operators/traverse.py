"""Bounded breadth-first traversal, level by level, for many start nodes at once.

The order inside a level is total: by the position of the parent, then the order of the edge in
its adjacency list, so a step limit cuts the same nodes whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import confidence_name, confidence_rank
from .components import _spread
from .lineage import kept


def _adjacency(edges: DataFrame, direction: str) -> DataFrame:
    """(from_node, to_node, edge_id, rank, ord): the strongest edge of each pair, in the direction of travel."""
    here, there = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    order = F.struct(confidence_rank(F.col("confidence")).alias("rank"), F.col("start_line"), F.col("id"))
    best = edges.groupBy(F.col(here).alias("from_node"), F.col(there).alias("to_node")).agg(F.min(order).alias("ord"))
    return best.select("from_node", "to_node", F.col("ord.id").alias("edge_id"), F.col("ord.rank").alias("edge_rank"), "ord")


def ordered_bfs(starts: DataFrame, edges: DataFrame, direction: str = "out", max_depth: int = 3, max_steps: int | None = None, expand: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, position, path, confidence, parent) of all nodes reached from each start.

    ``starts`` has one column ``start``.  ``expand`` (node) limits which nodes are travelled on from;
    others are reached but end there.  ``max_steps`` counts reached nodes of a start, the start itself
    not.  The confidence is the weakest on the path.
    """
    adjacency = kept(_adjacency(edges, direction))
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("position"), F.array("start").alias("path"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("parent"))
    levels = [frontier]
    visited = frontier.select("start", "node")
    taken = starts.select("start", F.lit(0).cast("long").alias("so_far"))
    for depth in range(1, max_depth + 1):
        base = frontier if expand is None or depth == 1 else frontier.join(expand.select(F.col("node").alias("x")), F.col("node") == F.col("x"), "left_semi")
        steps = base.join(adjacency, F.col("node") == F.col("from_node")).select("start", F.col("node").alias("parent"), F.col("position").alias("parent_position"), "path", "rank", F.col("to_node").alias("node"), "edge_rank", "ord")
        new = steps.join(visited, ["start", "node"], "left_anti")
        first = F.struct("parent_position", "ord", "parent", "path", "rank", "edge_rank")
        one = new.groupBy("start", "node").agg(F.min(first).alias("via"))
        own = Window.partitionBy("start").orderBy("via.parent_position", "via.ord", "node")
        placed = one.withColumn("n", F.row_number().over(own)).join(taken, "start")
        level = placed.select(
            "start",
            "node",
            F.lit(depth).alias("depth"),
            (F.col("so_far") + F.col("n")).alias("position"),
            F.concat("via.path", F.array("node")).alias("path"),
            F.greatest("via.rank", "via.edge_rank").alias("rank"),
            F.col("via.parent").alias("parent"),
        )
        if max_steps is not None:
            level = level.filter(F.col("position") <= max_steps)
        frontier = kept(level)
        levels.append(frontier)
        visited = kept(visited.unionByName(frontier.select("start", "node")))
        counts = frontier.groupBy("start").agg(F.max("position").alias("top"))
        taken = taken.join(counts, "start", "left").select("start", F.coalesce("top", "so_far").alias("so_far"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("start", "node", "depth", "position", "path", confidence_name(F.col("rank")).alias("confidence"), "parent")


def change_impact(targets: DataFrame, edges: DataFrame, max_depth: int = 4, max_steps: int = 100) -> DataFrame:
    """I4: all callers of each target, nearest first, with the path to it and its weakest confidence."""
    calls = edges.filter(F.col("kind") == "calls")
    reached = ordered_bfs(targets, calls, "in", max_depth, max_steps)
    return reached.filter("depth > 0").select(F.col("start").alias("target_id"), F.col("node").alias("caller_id"), "depth", F.reverse("path").alias("path"), "confidence", "position")


def impact_summary(impact: DataFrame) -> DataFrame:
    return impact.groupBy("target_id").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.max("depth").alias("depth"))


def downstream(handlers: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, max_steps: int = 25) -> DataFrame:
    """Calls below each handler; external and unresolved targets are reached but not travelled on from."""
    concrete = nodes.filter(F.col("kind").isin("function", "method", "constructor")).select(F.col("id").alias("node"))
    calls = edges.filter(F.col("kind") == "calls")
    return ordered_bfs(handlers, calls, "out", max_depth, max_steps, expand=concrete)


def allowed_edges(reached: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """G1: every edge that leaves a reached node above the depth limit, to visited and missing nodes too."""
    inner = reached.filter(F.col("depth") < max_depth).select("start", F.col("node").alias("n"))
    return edges.join(inner, F.col("source_id") == F.col("n")).drop("n")


def symbol_flow(starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, max_steps: int = 30) -> DataFrame:
    """(start, steps, depth, duplicates, depth_limited, step_limited) of each start's calls, the start being the first step.

    The walk goes on past its limit to count: calls met after the last step are ``step_limited``, whatever they reach;
    calls met before it that reach a node already shown are ``duplicates``; calls of shown functions at the greatest depth are ``depth_limited``.
    """
    concrete = nodes.filter(F.col("kind").isin("function", "method", "constructor")).select(F.col("id").alias("node"))
    calls = edges.filter(F.col("kind") == "calls")
    reached = kept(ordered_bfs(starts, calls, "out", max_depth, max_steps - 1, expand=concrete))
    adjacency = kept(_adjacency(calls, "out"))
    going = reached.join(concrete.select(F.col("node").alias("c")), F.col("node") == F.col("c"), "left").filter("depth = 0 OR c IS NOT NULL")
    met = going.select("start", F.col("node").alias("n"), "depth", "position").join(adjacency, F.col("n") == F.col("from_node")).select("start", "depth", F.struct("position", "ord").alias("at"), F.col("from_node"), "to_node")
    # The last step, where the limit lets no more through, and the call that made it.
    last = reached.filter(F.col("position") == max_steps - 1).select(F.col("start").alias("ls"), F.col("parent").alias("lp"), F.col("node").alias("ln"))
    end = met.join(last, (F.col("start") == F.col("ls")) & (F.col("from_node") == F.col("lp")) & (F.col("to_node") == F.col("ln"))).select(F.col("start").alias("es"), F.col("at").alias("end")) if max_steps > 1 else None
    within = met.filter(F.col("depth") < max_depth)
    within = within.join(end, F.col("start") == F.col("es"), "left").select("start", "at", "end", F.coalesce(F.col("at") > F.col("end"), F.lit(False)).alias("late")) if end is not None else within.select("start", F.lit(True).alias("late"))
    counted = within.groupBy("start").agg(F.count_if("late").alias("step_limited"), F.count_if(~F.col("late")).alias("seen"))
    deep = met.filter(F.col("depth") == max_depth).groupBy("start").agg(F.count(F.lit(1)).alias("depth_limited"))
    shown = reached.groupBy("start").agg(F.count(F.lit(1)).alias("steps"), F.max("depth").alias("depth"))
    zero = F.lit(0).cast("long")
    joined = shown.join(counted, "start", "left").join(deep, "start", "left")
    return joined.select("start", "steps", "depth", (F.coalesce("seen", zero) - (F.col("steps") - 1)).alias("duplicates"), F.coalesce("depth_limited", zero).alias("depth_limited"), F.coalesce("step_limited", zero).alias("step_limited"))


# --- a bounded view of a whole graph -------------------------------------------------------------------------

#: Roots that a view starts from at most.
VIEW_SEEDS = 24


def view_seeds(candidates: DataFrame, edges: DataFrame, root: str | None = None) -> DataFrame:
    """(id, place): the root asked for, else nodes that nothing enters, by number of edges out, then id."""
    if root is not None:
        own = candidates.filter(F.col("id") == root).select("id", F.lit(1).cast("long").alias("place"))
        if not own.isEmpty():
            return own
    entered = edges.select(F.col("target_id").alias("t")).distinct()
    out = edges.groupBy(F.col("source_id").alias("s")).agg(F.count(F.lit(1)).alias("degree"))
    top = candidates.join(out, F.col("id") == F.col("s")).join(entered, F.col("id") == F.col("t"), "left_anti").orderBy(F.desc("degree"), "id").limit(VIEW_SEEDS)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("long").alias("place"))  # VIEW_SEEDS rows


def _placed(rows: DataFrame, order: str, room: int, so_far: int) -> DataFrame:
    """The first ``room`` rows in order, with their places; a bounded number of rows."""
    return kept(rows.orderBy(order).limit(room).select("id", (F.row_number().over(Window.orderBy(order)) + so_far).cast("long").alias("place")))


def _walk(start: DataFrame, near: DataFrame, budget: int) -> DataFrame:
    """(id, place) of the first ``budget`` nodes of a breadth-first walk over ``near`` (here, there, step) from ``start`` (id, place)."""
    selected = frontier = start
    count = start.count()
    while count < budget:
        met = frontier.join(near, F.col("id") == F.col("here")).select(F.col("there").alias("id"), F.struct("place", "step").alias("via")).join(selected.select(F.col("id").alias("had")), F.col("id") == F.col("had"), "left_anti")
        frontier = _placed(met.groupBy("id").agg(F.min("via").alias("via")), "via", budget - count, count)
        new = frontier.count()
        if not new:
            break
        count, selected = count + new, selected.unionByName(frontier)
    return selected


def bounded_view(candidates: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int) -> DataFrame:
    """(id, place) of at most ``budget`` candidates: a walk from the seeds along edges either way, then, as long as there is room, from the first candidate left.

    ``candidates`` has id and kind, whose order is by kind, then id; ``seeds`` id and place.  A node's neighbours follow in
    the order edges out by target, then edges in by source.  A walk that has run dry has taken whole components, so what is left are whole
    components too: those that fit are taken by the order of their first candidates without a walk, and only the one that does not
    fit is walked through.  Places of nodes taken without a walk are null.
    """
    own = kept(candidates.select("id", F.struct("kind", "id").alias("order")))
    ids = own.select(F.col("id").alias("c"))
    inside = edges.join(ids, F.col("source_id") == F.col("c"), "left_semi").join(ids, F.col("target_id") == F.col("c"), "left_semi").select("source_id", "target_id")
    way = lambda here, there, side: inside.select(F.col(here).alias("here"), F.col(there).alias("there"), F.struct(F.lit(side).alias("side"), F.col(there).alias("to")).alias("step"))
    near = kept(way("source_id", "target_id", 0).unionByName(way("target_id", "source_id", 1)).groupBy("here", "there").agg(F.min("step").alias("step")))
    first = seeds.join(ids, F.col("id") == F.col("c"), "left_semi")
    selected = kept(_walk(_placed(first.select("id", "place"), "place", budget, 0), near, budget))
    taken = selected.count()
    if taken >= budget:
        return selected
    left = kept(own.join(selected.select(F.col("id").alias("had")), F.col("id") == F.col("had"), "left_anti"))
    labels = _spread(left.select(F.col("id").alias("node"), F.col("order").alias("label")), near.select(F.col("here").alias("src"), F.col("there").alias("dst")))
    # Each has a node at least, so that only as many components as there is room can matter.
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(budget - taken)
    running = kept(sizes.withColumn("sum", F.sum("n").over(Window.orderBy("label"))))
    whole = running.filter(F.col("sum") <= budget - taken)
    filled = labels.join(whole.select(F.col("label").alias("l")), F.col("label") == F.col("l"), "left_semi").select(F.col("node").alias("id"), F.lit(None).cast("long").alias("place"))
    result = selected.unionByName(filled)
    room = budget - taken - (whole.agg(F.max("sum")).first()[0] or 0)
    part = running.filter(F.col("sum") > budget - taken).orderBy("label").limit(1)
    if room and not part.isEmpty():
        result = result.unionByName(_walk(kept(part.select("label.id", F.lit(1).cast("long").alias("place"))), near, room).select("id", F.lit(None).cast("long").alias("place")))
    return result
