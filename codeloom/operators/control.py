"""Control edges of structured functions: where each block goes next."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .grouped import by_group

#: Names of the first and last block of every function in the edges.
ENTRY, EXIT = -1, -2
_EDGES = "function_id long, source long, target long, kind string, label string, confidence string"
_ROW = "function_id long, what string, block long, container long, ord long, kind string, owner long, role string, confidence string, final long, has_default boolean, label string"
_FIELDS = [c.split()[0] for c in _ROW.split(", ")]
Row = namedtuple("Row", _FIELDS[1:])


class Scopes:
    """One function: its containers hold blocks in order, and each but the root belongs to a block."""

    def __init__(self, rows: list[Row]) -> None:
        of: dict[str, list[Row]] = {"block": [], "container": [], "control": [], "branch": []}
        for r in rows:
            of[r.what].append(r)
        last = lambda *at: [(x is None, x) for x in at]
        blocks = sorted(of["block"], key=lambda r: last(r.ord, r.block))
        self.blocks = {r.block: r for r in blocks}
        self.held: dict[int, list[int]] = {}
        for r in blocks:
            self.held.setdefault(r.container, []).append(r.block)
        self.after = {a: b for held in self.held.values() for a, b in zip(held, held[1:], strict=False)}
        self.containers = {r.container: r for r in of["container"]}
        self.controls = {r.block: r for r in of["control"]}
        self.branches: dict[int, list] = {}
        for r in sorted(of["branch"], key=lambda r: last(r.block, r.ord)):
            self.branches.setdefault(r.block, []).append(r)
        self.nexts: dict[int, tuple[int, str, str]] = {}

    def first(self, container: int | None) -> int | None:
        held = None if container is None else self.held.get(container)
        return held[0] if held else None

    def owner(self, block: int) -> tuple[int | None, str]:
        """The block around, and the role of the container between."""
        c = self.containers.get(self.blocks[block].container)
        if c is None or c.owner is None or c.owner not in self.blocks:
            return None, ""
        return c.owner, c.role

    def onward(self, block: int) -> tuple[int, str, str]:
        """(target, kind, confidence) behind a block: its next sibling, else what its surroundings say, outward."""
        passed, at = [], block
        while at not in self.nexts:
            passed.append(at)
            if at in self.after:
                self.nexts[at] = self.after[at], "next", "exact"
                break
            around, role = self.owner(at)
            control = None if around is None else self.controls.get(around)
            final = self.first(control.final) if control is not None and control.kind == "try" and role != "finally" else None
            if around is None:
                self.nexts[at] = EXIT, "next", "exact"
            elif role == "loopBody":
                self.nexts[at] = around, "repeat", "exact" if control is None or control.confidence is None else control.confidence
            elif final is not None:
                self.nexts[at] = final, "next", "exact"
            else:
                at = around
                continue
            break
        for b in passed:
            self.nexts[b] = self.nexts[at]
        return self.nexts[block]

    def jump(self, block: int, kind: str) -> int | None:
        """Where a break or continue lands: at the nearest loop, for a break also behind the nearest switch."""
        around, _ = self.owner(block)
        while around is not None:
            control = self.controls.get(around)
            if control is not None and (control.kind == "loop" or (kind == "break" and control.kind == "switch")):
                return around if kind == "continue" else self.onward(around)[0]
            around, _ = self.owner(around)
        return None

    def edges(self, root: int) -> Iterator[tuple[int, int, str, str | None, str]]:
        first = self.first(root)
        yield ENTRY, EXIT if first is None else first, "next", None, "exact"
        for block, row in self.blocks.items():
            if block in self.controls:
                yield from self._choices(block)
            elif row.kind in ("return", "throw"):
                yield block, EXIT, row.kind, row.kind, "exact"
            elif row.kind in ("break", "continue"):
                to = self.jump(block, row.kind)
                yield block, EXIT if to is None else to, row.kind, row.kind, "inferred" if to is None else "exact"
            else:
                to, kind, sure = self.onward(block)
                yield block, to, kind, "repeat" if kind == "repeat" else None, sure

    def _choices(self, block: int) -> Iterator[tuple[int, int, str, str | None, str]]:
        control, onward = self.controls[block], self.onward(block)[0]
        sure = control.confidence or "exact"
        final, kinds = self.first(control.final), set()
        for b in self.branches.get(block, []):
            kinds.add(b.kind)
            if b.container is not None and b.container == control.final:  # follows the other branches, and is no choice
                continue
            first = self.first(b.container)
            if first is not None:
                yield block, first, b.kind, b.label, "inferred" if b.kind == "exception" else sure
            elif b.kind != "exception":
                yield block, final if control.kind == "try" and final is not None else onward, b.kind, b.label, sure
        if control.kind == "condition" and "false" not in kinds:
            yield block, onward, "false", "false", sure
        if control.kind == "loop" and "exit" not in kinds:
            yield block, onward, "exit", "exit loop", sure
        if control.kind == "switch" and not control.has_default:
            yield block, onward, "exit", "no case matched", sure


def structured_control_edges(blocks: DataFrame, containers: DataFrame, controls: DataFrame, branches: DataFrame) -> DataFrame:
    """(function_id, source, target, kind, label, confidence), every edge once.

    ``blocks`` has function_id, block, container, ord and kind; ``containers`` container, owner (a block, null for the root) and role;
    ``controls`` block, kind, confidence, final (a container) and has_default; ``branches`` block, ord, container, kind and label.  One
    shuffle by function; functions are worked out one by one, so a task holds the blocks of one.
    """

    def tall(df: DataFrame, what: str) -> DataFrame:
        return df.select(*[F.lit(what).alias(n) if n == "what" else (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in _ROW.split(", "))])

    rows = tall(blocks, "block")
    for df, what in ((containers, "container"), (controls, "control"), (branches, "branch")):
        rows = rows.unionByName(tall(df, what))

    def one(function: object, *columns: list) -> Iterator[tuple]:
        held = list(map(Row._make, zip(*columns, strict=True)))
        roots = [r.container for r in held if r.what == "container" and r.owner is None]
        made = {(e[0], e[1], e[2], e[3] or ""): e for e in reversed(list(Scopes(held).edges(min(roots, default=0))))}
        yield from ((function, *e) for e in made.values())

    return by_group("function_id", {"rows": rows.select(*_FIELDS)}, one, StructType.fromDDL(_EDGES))
