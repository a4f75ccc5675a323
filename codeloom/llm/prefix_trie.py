"""Prefix trie of conversations by an external mergesort that carries common prefixes (operator 12).

A conversation is the sequence of its turns; a turn is known by 128 bits of the SHA-256 of its role
and text, so texts don't leave the tasks that read them.  Any order of turns makes equal prefixes
neighbours, and the order of digests is one.

1. Conversations are dealt to ranges of (turns, identifier): copies split between ranges like any others.
2. In a range each batch of rows becomes a sorted run, in which every conversation carries the
   length of the prefix it shares with the one before (LCP) and only its turns from there on.  A
   loser tree merges the runs: a head that shares more with the last one out comes first, so
   two heads are compared only where both share equally much, and only from there.
3. The merged stream, again with LCPs, feeds a stack of the open nodes of the current path.  A
   node is finished when the next conversation leaves it, and goes out with the sums of its subtree.
4. Nodes on a range's first and last path may go on in other ranges.  They go out unfinished, with
   sums of what is finished below them, are added up by node, and their own sums then climb the
   tree in rounds that double the distance climbed.
5. A node learns its parent's identifier by a join on the parent's digest, safe for a parent with most nodes as children.

Memory: a task holds its range's runs front-coded (the turns not shared with the neighbour, 20 bytes
each, compressed), the head block of each run and one path; the number of ranges follows the number of turns.
The members that end at a node whose ends span ranges are hashed as a stream of pieces.  One conversation,
at 20 bytes a turn, passes through a task as one row.

Defined results: rows without a conversation identifier belong to none and are left out; a null role or text
is empty; a null turn comes first; rows of one turn go by role, then by digest; repeated rows are turns like any other;
an empty table gives an empty result, without a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, left_join_groups, stored

#: Every conversation takes the first turns, fewer than this many, of the last conversation whose identifier this divides.
FAMILY, HEAD = 20, 4
#: Turns of a range, and conversations of a run, at most about.
RANGE_TURNS, RUN_ROWS = 1_000_000, 20_000
#: Members of a piece of the ends of a node.
PIECE = 50_000
#: Conversations of a block of a run: what is unpacked of it at once.
BLOCK = 512
_DIGEST = 16


# --- sequences -----------------------------------------------------------------------------------------


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, own array of (digest, words)): each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _DIGEST))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words")).filter("conv_id IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", "words")))
    return rows.groupBy("conv_id").agg(ordered.alias("own")).select("conv_id", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own"))


def rebuilt(own: DataFrame) -> DataFrame:
    """``own`` with each conversation's first h turns taken from the head of its family; h = crc32(identifier) % HEAD."""
    head = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("own", 1, HEAD - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    both = own.withColumn("h", h).withColumn("of", F.col("conv_id") - F.col("conv_id") % FAMILY).join(head, F.col("of") == F.col("family"), "left")
    # A slice may not start behind 2**31 - 1 or have a negative length; an absent head has no turns.
    lead = F.slice(F.coalesce("lead", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.lit(0), F.size("own") - F.col("h")))
    return both.select("conv_id", F.concat(lead, rest).alias("turns"))


# --- runs and their merge --------------------------------------------------------------------------------


@dataclass
class Run:
    """A sorted run: blocks of conversations, each the LCPs and the turns from there on."""

    blocks: list[tuple[bytes, bytes, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def entries(self) -> Iterator[tuple[int, list[bytes], np.ndarray, int]]:
        """(lcp with the entry before, turns, words, identifier)."""
        turns: list[bytes] = []
        words = np.zeros(0, dtype=np.int32)
        while self.blocks:
            data, told, lcps, counts, ids = self.blocks.pop(0)  # a block read is a block freed
            raw = pa.decompress(data, decompressed_size=int(counts.sum()) * _DIGEST, codec="zstd", asbytes=True) if counts.sum() else b""
            own = np.frombuffer(told, dtype=np.int32)
            at = 0
            for lcp, n, i in zip(lcps.tolist(), counts.tolist(), ids.tolist(), strict=True):
                turns = turns[:lcp] + [raw[k * _DIGEST : (k + 1) * _DIGEST] for k in range(at, at + n)]
                words = np.concatenate([words[:lcp], own[at : at + n]])
                at += n
                yield lcp, turns, words, i


def common(a: list[bytes], b: list[bytes], known: int = 0) -> int:
    """Turns that two conversations share, ``known`` of which need no look."""
    n = min(len(a), len(b))
    while known < n and a[known] == b[known]:
        known += 1
    return known


def sorted_run(rows: list[tuple[list[bytes], np.ndarray, int]]) -> Run:
    rows.sort(key=lambda r: (r[0], r[2]))
    run, before = Run(), []
    for lo in range(0, len(rows), BLOCK):
        part = rows[lo : lo + BLOCK]
        lcps = []
        for turns, _, _ in part:
            lcps.append(common(before, turns))
            before = turns
        tails = b"".join(b"".join(t[n:]) for (t, _, _), n in zip(part, lcps, strict=True))
        told = np.concatenate([w[n:] for (_, w, _), n in zip(part, lcps, strict=True)]).astype(np.int32).tobytes()
        counts = np.array([len(t) - n for (t, _, _), n in zip(part, lcps, strict=True)], dtype=np.int64)
        run.blocks.append((pa.compress(tails, codec="zstd", asbytes=True) if tails else b"", told, np.array(lcps, dtype=np.int64), counts, np.array([i for _, _, i in part], dtype=np.int64)))
    return run


class Merge:
    """Loser tree over runs.  Every entry in it carries its LCP with the entry that beat it, or left last."""

    def __init__(self, runs: list[Run]) -> None:
        self.sources = [r.entries() for r in runs]
        self.heads: list[tuple[list[bytes], np.ndarray, int] | None] = [None] * len(runs)
        self.lcp = [0] * len(runs)
        self.compared = 0
        for r in range(len(runs)):
            self._next(r)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.loser = [-1] * self.size
        self.top = self._build(1) if runs else -1

    def _next(self, r: int) -> None:
        got = next(self.sources[r], None)
        self.heads[r] = None if got is None else (got[1], got[2], got[3])
        self.lcp[r] = 0 if got is None else got[0]

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        self.loser[node], winner = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(loser, winner); -1 or a run at its end loses.  The loser's LCP becomes that with the winner."""
        x, y = (self.heads[r] if 0 <= r < len(self.heads) else None for r in (a, b))
        if x is None or y is None:
            return (a, b) if x is None else (b, a)
        if self.lcp[a] != self.lcp[b]:
            return (b, a) if self.lcp[a] > self.lcp[b] else (a, b)
        n = common(x[0], y[0], self.lcp[a])
        self.compared += n - self.lcp[a] + 1
        first = (x[0][n : n + 1], x[2]) <= (y[0][n : n + 1], y[2])
        lose, win = (b, a) if first else (a, b)
        self.lcp[lose] = n
        return lose, win

    def __iter__(self) -> Iterator[tuple[int, list[bytes], np.ndarray, int]]:
        """All entries in order, each with its LCP with the one before."""
        while 0 <= self.top < len(self.heads) and self.heads[self.top] is not None:
            r = self.top
            yield self.lcp[r], *self.heads[r]
            self._next(r)
            winner, node = r, (r + self.size) // 2
            while node:
                self.loser[node], winner = self._play(self.loser[node], winner)
                node //= 2
            self.top = winner


# --- the stack of open nodes -----------------------------------------------------------------------------


class Open:
    """A node of the current path, and what is finished below it."""

    __slots__ = ("children", "edge", "ends", "key", "leaves", "least", "n", "saved", "words")

    def __init__(self, key: bytes, words: int, edge: bool) -> None:
        self.key, self.words, self.edge = key, words, edge
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []


ROOT = hashlib.blake2b(b"", digest_size=_DIGEST).digest()
_NOTHING = hashlib.sha256().hexdigest()
_NODES = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())])
_NODES_SQL = "kind int, key binary, parent binary, depth long, words long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
#: Kinds of rows: a finished node with the digest of its ends; a node on the edge of a range; a piece of the ends of the latter, whose place in the node is (n_convs: range, n_children: piece).
DONE, EDGE, ENDS = 0, 1, 2


def nodes_of(stream: Iterator[tuple[int, list[bytes], np.ndarray, int]], part: int) -> Iterator[tuple]:
    """The rows of all nodes of a range's conversations, which come in order."""
    path: list[Open] = []
    first, pieces = True, 0

    def close(last: bool) -> Iterator[tuple]:
        nonlocal pieces
        node, depth = path.pop(), len(path)
        up = path[-1] if path else None
        if up is not None:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
        about = (node.key, up.key if up is not None else None, depth, node.words, node.least, node.n)
        if node.edge or last:
            yield (EDGE, *about, node.children, node.leaves, node.saved, None)
            yield from piece(node)
            return
        leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.words
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        yield (DONE, *about, node.children, leaves, saved, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest())

    def piece(node: Open) -> Iterator[tuple]:
        nonlocal pieces
        if node.ends:
            yield (ENDS, node.key, None, 0, 0, 0, part, pieces, 0, 0, ",".join(map(str, node.ends)))
            pieces, node.ends = pieces + 1, []

    for lcp, turns, words, i in stream:
        if not path:
            path.append(Open(ROOT, 0, True))
        while len(path) > lcp + 1:
            yield from close(False)
        for k in range(len(path) - 1, len(turns)):
            path.append(Open(hashlib.blake2b(path[-1].key + turns[k], digest_size=_DIGEST).digest(), int(words[k]), first))
        first = False
        top = path[-1]
        top.n, top.least = top.n + 1, i if top.least is None else min(top.least, i)
        top.ends.append(i)
        if len(top.ends) >= PIECE:
            # Its members go out in pieces, so that it is put together like a node on an edge, and so are those above it.
            for node in path:
                node.edge = True
            yield from piece(top)
    while path:
        yield from close(True)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES)


def _merged(keyed: DataFrame) -> DataFrame:
    """The node rows of every range of (key, conv_id)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: list[Run] = []
        rows: list[tuple[list[bytes], np.ndarray, int]] = []
        for batch in batches:
            for key, words, i in zip(batch["key"], batch["words"], batch["conv_id"].to_pylist(), strict=True):
                data = key.as_py()
                rows.append(([data[k : k + _DIGEST] for k in range(0, len(data), _DIGEST)], np.frombuffer(words.as_buffer(), dtype=">i4") if len(data) else np.zeros(0, dtype=np.int32), i))
                if len(rows) >= RUN_ROWS:
                    runs.append(sorted_run(rows))
                    rows = []
        if rows:
            runs.append(sorted_run(rows))
        out: list[tuple] = []
        for row in nodes_of(iter(Merge(runs)), TaskContext.get().partitionId()):
            out.append(row)
            if len(out) >= 10_000:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    return keyed.mapInArrow(merge, _NODES_SQL)


# --- nodes that span ranges --------------------------------------------------------------------------------


def _ends(pieces: DataFrame) -> DataFrame:
    """(key, ends): the digest of each node's pieces, hashed one after the other."""
    schema = pa.schema([("key", pa.binary()), ("ends", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hasher = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, text in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if key == at:
                    hasher.update(b"," + text.encode())
                else:
                    if at is not None:
                        done.append((at, hasher.hexdigest()))
                    at, hasher = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([hasher.hexdigest()])], schema=schema)

    ordered = pieces.select("key", F.col("n_convs").alias("part"), F.col("n_children").alias("piece"), "ends").repartition("key").sortWithinPartitions("key", "part", "piece")
    return ordered.select("key", "ends").mapInArrow(digest, "key binary, ends string")


def _joined_edges(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Finished rows of the nodes on the edges of ranges, two paths a range."""
    sums = [F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]]
    whole = edges.groupBy("key").agg(*sums)
    below = whole.groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("more"))
    childless = (F.col("n_children") + F.coalesce("more", F.lit(0))) == 0
    own = checkpointed(
        whole.join(below, F.col("key") == F.col("p"), "left").select(
            "key", "parent", "depth", "words", "conv_id", "n_convs", (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"), (F.col("n_leaves") + F.when(childless, 1).otherwise(0)).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
        )
    )
    # Each round a node adds to its ancestor at a distance of 1, 2, 4 ... all that it has so far of its own subtree.
    climb = own.select("key", F.col("parent").alias("anc"), "n_leaves", "saved_tokens")
    while True:
        gained = climb.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("to")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        further = climb.select(F.col("key").alias("via"), F.col("anc").alias("next"))
        climb = checkpointed(
            climb.join(gained, F.col("key") == F.col("to"), "left").join(further, F.col("anc") == F.col("via"), "left").select("key", F.col("next").alias("anc"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        )
        if climb.filter("anc IS NOT NULL").isEmpty():
            break
    total, ends = climb.select(F.col("key").alias("k"), "n_leaves", "saved_tokens"), _ends(pieces).select(F.col("key").alias("e"), "ends")
    return own.drop("n_leaves", "saved_tokens").join(total, F.col("key") == F.col("k")).join(ends, F.col("key") == F.col("e"), "left").select("key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends"))


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    keyed = rebuilt(sequences(turns, id_col, turn_col, role_col, text_col)).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"),
        F.unhex(F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["words"]), 8, "0")), "")).alias("words"),
    )
    kept = stored(keyed, "sequences")
    count = kept.agg(F.sum(F.length("key") / _DIGEST).alias("n")).first()["n"] or 0
    ranges = max(kept.sparkSession.sparkContext.defaultParallelism, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(count // range_turns) + 1)
    made = stored(_merged(kept.repartitionByRange(ranges, "key", "conv_id")), "nodes")
    edges = _joined_edges(made.filter(F.col("kind") == EDGE), made.filter(F.col("kind") == ENDS))
    columns = ["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    nodes = stored(made.filter(F.col("kind") == DONE).select(*columns).unionByName(edges.select(*columns)), "trie")
    above = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    found = left_join_groups(nodes, above, "parent", "siblings", nodes.count())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
