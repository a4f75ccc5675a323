"""Reading paths: of every mapped flow the few steps that show where it goes, and the best paths of each scope."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .grouped import by_group

#: Steps of a path, and paths of a scope, at most.
STEP_LIMIT, PATH_LIMIT = 5, 3
# Boundaries in the order in which a path prefers them, and those that are explicit effects.
BOUNDARY_KINDS = ("repository", "model", "externalCall", "sideEffect", "unresolvedCall", "observedTerminal")
EFFECTS = ("repository", "model", "sideEffect")
#: Businesses, confidences of assessments and of edges, the best first.
BUSINESS = ("domainRuleCandidate", "applicationWorkflowCandidate")
SURENESS = ("high", "medium", "low")
EDGE_SURENESS = ("exact", "resolved", "inferred")
NO_DEPTH = 1 << 30
_STEP = ("place", "step_id", "kind", "depth", "role", "resolution", "function_id", "parent_function_id", "confidence", "layer", "sureness", "business", "conflicted")
Step = namedtuple("Step", _STEP)
_PATH = "flow_id string, steps string, boundary_kind string, target string, context string, business_reach string, omitted_steps long, unresolved_calls long, target_sureness string, target_depth long, stored boolean"


def step_architecture(steps: DataFrame, assessments: DataFrame) -> DataFrame:
    """The steps with layer, sureness and business: of the kind of step where that says it, else as assessed for the function, else unknown.

    ``assessments`` has function_id, layer, sureness, business and conflicted.
    """
    own = assessments.select(F.col("function_id").alias("f"), F.col("layer").alias("a_layer"), F.col("sureness").alias("a_sureness"), F.col("business").alias("a_business"), F.col("conflicted").alias("a_conflicted"))
    joined = steps.join(own, F.col("function_id") == F.col("f"), "left")
    entry, open_ = F.col("kind").isin("route", "operation"), F.col("resolution") == "unresolved"
    effect, outside = F.col("role") == "sideEffect", (F.col("resolution") == "external") | (F.col("role") == "external")

    def told(at_entry: str, at_effect: str, unknown: str, assessed: Column) -> Column:
        return F.when(entry, at_entry).when(open_, unknown).when(effect, at_effect).when(outside, unknown).otherwise(F.coalesce(assessed, F.lit(unknown)))

    none = F.coalesce(entry | open_ | effect | outside, F.lit(False))
    return joined.select(
        *steps.columns,
        told("entrypoint", "infrastructure", "unclassified", F.col("a_layer")).alias("layer"),
        told("medium", "medium", "unknown", F.col("a_sureness")).alias("sureness"),
        told("notBusinessLogic", "notBusinessLogic", "unknown", F.col("a_business")).alias("business"),
        F.when(none, F.lit(False)).otherwise(F.coalesce("a_conflicted", F.lit(False))).alias("conflicted"),
    )


class Flow:
    """The steps of one flow, in their order, and the chains of calls from its handler."""

    def __init__(self, steps: list[Step]) -> None:
        self.steps = steps
        self.calls = [s for s in self.steps if s.kind == "call"]
        self.parents = {s.parent_function_id for s in self.calls}
        self.chains: dict[int, list[tuple] | None] = {}
        self.call_of: dict[str, tuple] = {}
        for s in self.calls:
            if s.function_id is not None:
                self.call_of.setdefault(s.function_id, s)
        self.entry = next((s for s in self.steps if s.kind in ("route", "operation")), None)
        self.handler = next((s for s in self.steps if s.kind == "handler" and s.resolution == "concrete" and s.function_id is not None), None)

    def boundary(self, s: tuple) -> str | None:
        if s.kind != "call":
            return None
        if s.role in ("repository", "model"):
            return s.role
        if s.resolution == "external" or s.role == "external":
            return "externalCall"
        if s.role == "sideEffect":
            return "sideEffect"
        if s.resolution == "unresolved":
            return "unresolvedCall"
        return "observedTerminal" if s.function_id is not None and s.function_id not in self.parents else None

    def chain(self, s: tuple) -> list[tuple] | None:
        """The calls from the handler to a step; none if they break off or go round."""
        if s.place not in self.chains:
            self.chains[s.place] = self._chain(s)
        return self.chains[s.place]

    def _chain(self, s: tuple) -> list[tuple] | None:
        back, seen = [], set()
        while s is not None:
            back.append(s)
            up = s.parent_function_id
            if up == self.handler.function_id:
                return back[::-1]
            if up is None or up in seen:
                return None
            seen.add(up)
            s = self.call_of.get(up)
        return None

    def business(self) -> tuple | None:
        found = [s for s in self.calls if s.resolution == "concrete" and s.function_id is not None and s.business in BUSINESS and self.chain(s)]
        place = lambda names, x: names.index(x) if x in names else len(names)
        return min(found, key=lambda s: (BUSINESS.index(s.business), place(SURENESS, s.sureness), s.depth, place(EDGE_SURENESS, s.confidence), s.place), default=None)

    def boundaries(self, kinds: tuple[str, ...] = BOUNDARY_KINDS) -> list[tuple[int, tuple, list[tuple]]]:
        """(order, boundary, chain) of every boundary that the handler reaches, the preferred first."""
        found = [(BOUNDARY_KINDS.index(b), s, c) for s in self.calls if (b := self.boundary(s)) in kinds and (c := self.chain(s))]
        return sorted(found, key=lambda x: (x[0], x[1].place))

    def bridge(self, chain: list[tuple]) -> tuple | None:
        """The call nearest to the handler, before the boundary, of which nothing else is known."""
        plain = lambda s: s.resolution == "concrete" and s.function_id is not None and s.role not in ("repository", "model", "external", "sideEffect")
        return next((s for s in chain[:-1] if plain(s) and s.layer == "unclassified" and s.business == "unknown" and not s.conflicted), None)

    def path(self) -> tuple[list[tuple], tuple | None, tuple | None]:
        """(steps, boundary, bridge)."""
        chosen = [s for s in (self.entry, self.handler) if s is not None]
        if self.handler is None:
            return chosen, None, None
        target, bridge, best = self.business(), None, None
        reached = self.boundaries()
        if target is not None:
            best = next((x for x in reached if any(s.function_id == target.function_id for s in x[2])), None)
        else:
            linked = [(b, x) for x in reached if BOUNDARY_KINDS[x[0]] in EFFECTS and (b := self.bridge(x[2])) is not None]
            if linked:
                bridge, best = min(linked, key=lambda y: (y[1][0], y[0].depth, y[0].place, y[1][1].place))
            else:
                best = reached[0] if reached else None
        chain = best[2] if best else self.chain(target) if target is not None else None
        if chain is None:
            return chosen, None, None
        return chosen + self.short(chain, STEP_LIMIT - len(chosen), target or bridge, best[1] if best else None), best[1] if best else None, bridge

    @staticmethod
    def short(chain: list[tuple], room: int, target: tuple | None, boundary: tuple | None) -> list[tuple]:
        """The chain, shortened to its first call, its target, its boundary and as many of the first as there is room for."""
        if len(chain) <= room:
            return chain
        if room == 1:
            return [target or boundary or chain[0]]
        places = [s.place for s in chain]
        kept = {0, *(places.index(s.place) for s in (target, boundary) if s is not None and s.place in places)}
        for k in range(len(chain)):
            if len(kept) >= room:
                break
            kept.add(k)
        return [chain[k] for k in sorted(kept)[:room]]


def reading_paths(steps: DataFrame, flows: DataFrame) -> DataFrame:
    """I8: one row per mapped flow: its steps in reading order, where to start, what boundary it reaches and what it leaves out.

    ``steps`` (of :func:`step_architecture`) has flow_id, step_id, kind, depth, role, resolution, function_id, parent_function_id,
    confidence and where the source stands; ``flows`` flow_id, scope_id, mapped, confidence, depth_limit and step_limit.
    A flow has a bounded number of steps and is worked out by itself, after one shuffle by flow.
    """
    kind = F.when(F.col("kind").isin("route", "operation"), 0).when(F.col("kind") == "handler", 1).otherwise(2)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    order = [F.col("depth"), kind, text("file_path"), F.col("start_line").asc_nulls_last(), F.col("start_character").asc_nulls_last(), text("function_id"), text("unit_id"), text("edge_id"), F.col("step_id")]
    own = flows.filter("mapped").select("flow_id")
    placed = steps.join(own, "flow_id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("flow_id").orderBy(*order)))

    def pick(flow_id: object, *columns: list) -> Iterator[tuple]:
        flow = Flow(sorted(map(Step._make, zip(*columns, strict=True)), key=lambda s: s.place))
        chosen, boundary, bridge = flow.path()
        first = lambda test: next((s for s in chosen if test(s)), None)
        by = [(first(lambda s, b=b: s.business == b), r) for b, r in zip(BUSINESS, ("domainCandidateReached", "applicationCandidateReached"), strict=True)]
        by += [(bridge if bridge is not None and bridge in chosen else None, "workflowBridgeCandidateReached"), (first(lambda s: s.kind == "handler"), "")]
        target, reach = next(((s, r) for s, r in by if s is not None), (None, ""))
        boundary = boundary if boundary is not None and boundary in chosen else None
        yield (
            flow_id,
            ",".join(s.step_id for s in chosen),
            flow.boundary(boundary) if boundary is not None else None,
            target.step_id if target is not None else None,
            bridge.step_id if bridge is not None and bridge in chosen else None,
            reach,
            max(0, len(flow.steps) - len(chosen)),
            sum(s.resolution == "unresolved" for s in flow.calls),
            target.sureness if target is not None else None,
            target.depth if target is not None else NO_DEPTH,
            any(s.layer in ("dataAccess", "infrastructure") for s in chosen),
        )

    made = by_group("flow_id", {"steps": placed.select("flow_id", *_STEP)}, pick, StructType.fromDDL(_PATH))
    limited = F.col("depth_limit") | F.col("step_limit")
    status = F.when(limited, "limited").when(F.col("unresolved_calls") > 0, "unresolved").otherwise("mapped")
    reach = F.when(F.col("business_reach") != "", F.col("business_reach")).when(limited, "analysisLimited").otherwise("noCandidateObserved")
    joined = made.join(flows.select("flow_id", "scope_id", F.col("confidence").alias("mapping"), "depth_limit", "step_limit"), "flow_id")
    return joined.withColumns({"trace_status": status, "business_reach": reach}).drop("depth_limit", "step_limit")


def reading_rank() -> Column:
    """The eight parts by which paths compare, greatest first: completion, mapping, reach, sureness, trace, boundary, unresolved calls, depth."""
    points = lambda c, names, least=0: sum((F.when(F.col(c) == n, len(names) - k + least).otherwise(0) for k, n in enumerate(names[1:], 1)), F.when(F.col(c) == names[0], len(names) + least).otherwise(0))
    trace, bound = points("trace_status", ("mapped", "unresolved")), F.col("stored").cast("int")
    completion = F.when((trace == 2) & F.col("stored"), 3).when(trace == 2, 2).otherwise(bound)
    reach = points("business_reach", ("domainCandidateReached", "applicationCandidateReached", "workflowBridgeCandidateReached", "noCandidateObserved"))
    return F.struct(completion.alias("completion"), points("mapping", ("exact", "resolved", "inferred", "unresolved")).alias("mapping"), reach.alias("reach"), points("target_sureness", SURENESS).alias("sureness"), trace.alias("trace"), bound.alias("boundary"), (-F.col("unresolved_calls")).alias("resolved"), (-F.col("target_depth")).alias("nearness"))


def scope_paths(paths: DataFrame, flows: DataFrame, limit: int = PATH_LIMIT) -> DataFrame:
    """The best paths of each scope by :func:`reading_rank`, then flow id, with its counts of mapped, omitted and unmapped flows."""
    own = Window.partitionBy("scope_id").orderBy(F.desc("rank"), "flow_id")
    best = paths.withColumn("rank", reading_rank()).withColumn("position", F.row_number().over(own)).filter(F.col("position") <= limit)
    counts = flows.groupBy(F.col("scope_id").alias("scope")).agg(F.count_if("mapped").alias("mapped_flows"), F.count_if(~F.col("mapped")).alias("unmapped_entrypoints"))
    omitted = F.greatest(F.lit(0), F.col("mapped_flows") - limit)
    return best.join(counts, F.col("scope_id") == F.col("scope")).select("scope_id", "position", "flow_id", "steps", "target", "business_reach", "trace_status", "mapped_flows", omitted.cast("long").alias("omitted_flows"), "unmapped_entrypoints")
