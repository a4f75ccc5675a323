"""Exact Jaccard join of shingle sets with several global token orders (operator 11).

Two sets of Jaccard similarity t or more share, under ANY order of all tokens, a token among the first
n - ceil(t * n) + 1 of each.  So a pair is a candidate only if its prefixes meet under each of several orders.
No pair of linked sets is lost, whatever the orders; they only differ in what they keep out.

1. Tokens that a task meets in several documents are counted, and the
   most frequent of all are told to every task; the first two orders put these last, by level of
   frequency, and all three order the rest by different hashes.
2. Prefix tokens under the first order are sorted; equal tokens are buckets.  Two members are a pair
   if their sizes, and what is left of both sets from the shared token on, allow the overlap.
   A bucket of up to 8 gives all its pairs; a larger one gives each member's neighbours by size and place and the
   smallest member, so pairs stay linear in the rows.  A bucket may span range partitions.
3. A pair goes on only if the difference of the sets may cover that of their parities (as many bits as tokens, each whether
   an odd number of tokens falls on it), and its prefixes under the other orders meet too.  Only now are full sets fetched.
4. Each document's first pair is verified on full sets, then the pairs that still join components.
5. Large buckets whose members are still in different components are compared in blocks: first narrow rows
   (sizes, places and parities) tell the members that may have a partner in another component; then only these, with their sets.
   So no pair of linked sets goes unexamined unless its ends are already connected.

Copies: a task sends each set once; the documents of equal sets are one class, and its smallest identifier stands for it.

Defined results: a null or blank text has an empty set and is linked with nothing; a text of fewer than
5 words is one shingle; a row without an identifier is linked with nothing and has no component; rows
with one identifier are one node; repeated rows are equal sets; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, few_parts, id_bitmap, left_join_groups, maybe_in, shared_dir, stored
from .components import contract
from .near_dedup import _apart, _linked, _verified, shingle_sets
from .words import SPACED, mix, split_words

PERCENT = 80
#: Tokens met in so many documents of a task are counted; so many of the most frequent are known to all tasks.
COUNTED_FROM, KNOWN = 4, 1 << 18
#: Elements counted at once.
COUNT_ELEMENTS = 2_000_000
#: Up to this size a bucket gives all its pairs.
SMALL_BUCKET = 8
#: Members of a block when a large bucket is compared: narrow rows, and rows with sets.
NARROW_BLOCK, BLOCK = 4096, 256
#: Orders after the first, by the salt of their hash, and whether frequent tokens come last.
_SALTS = ((np.uint64(0xA24BAED4963EE407), True), (np.uint64(0x9FB21C651E98DF25), False))
_LEVEL_BITS = np.uint64(6)
_WORDS = 32  # of 64 parity bits at least


# --- sets and orders -------------------------------------------------------------------------------------


def _keyed_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes | None]]]:
    """(first row, rows, tokens, cuts, key of each set) of some rows at a time; the key is a digest of the set, null for an empty one."""
    for w in split_words(column, SPACED, lower=True):
        h, cuts = shingle_sets(w)
        keys = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield w.first_row, w.rows, h, cuts, keys


def _drawn(docs: DataFrame) -> DataFrame:
    """(id, n, key, tokens) of every row, tokens null.  n = -1: tokens and, as key, how many documents of a task had them."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("tokens", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            token, n = token[n >= COUNTED_FROM], n[n >= COUNTED_FROM].astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([n.tobytes()], pa.binary()), pa.array([token.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for first, rows, h, cuts, keys in _keyed_sets(batch["text"]):
                held.append(h)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(first, rows), pa.array(np.diff(cuts).astype(np.int64)), pa.array(keys, pa.binary()), pa.nulls(rows, pa.binary())], schema=schema)
            if sum(map(len, held)) >= COUNT_ELEMENTS:
                yield counted()
        if held:
            yield counted()

    return docs.mapInArrow(read, "id long, n long, key binary, tokens binary")


class Frequent:
    """The most frequent tokens, at most KNOWN, and their levels; any choice makes right orders, as long as it is one for all."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.levels = np.minimum(63, np.ceil(np.log2(counts[order] + 1.0))).astype(np.uint64)

    def level(self, h: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(h), dtype=np.uint64)
        at = np.searchsorted(self.tokens, h)
        at[at == len(self.tokens)] = 0
        return np.where(self.tokens[at] == h, self.levels[at], np.uint64(0))


def _frequent(drawn: DataFrame) -> Frequent:
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, counts in zip(batch["tokens"], batch["key"], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens.as_buffer(), dtype=np.int64)), pa.array(np.frombuffer(counts.as_buffer(), dtype=np.uint32).astype(np.int64))], names=["token", "c"])

    each = drawn.filter("n = -1").select("tokens", "key").mapInArrow(unpacked, "token long, c long")
    top = each.groupBy("token").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "token").limit(KNOWN).toArrow()
    return Frequent(top["token"].to_numpy().view(np.uint64), top["c"].to_numpy())


def first_order(h: np.ndarray, known: Frequent) -> np.ndarray:
    """Tokens as numbers that ascend in the first order."""
    return known.level(h) << (np.uint64(64) - _LEVEL_BITS) | h >> _LEVEL_BITS


def other_prefixes(h: np.ndarray, n: int, known: Frequent) -> list[np.ndarray]:
    """The prefix of one set under each further order, as sorted 32-bit hashes; equal hashes of different tokens only let a pair pass."""
    level = known.level(h)
    out = []
    for salt, last in _SALTS:
        x = mix(h ^ salt)
        at = level << (np.uint64(64) - _LEVEL_BITS) | x >> _LEVEL_BITS if last else x
        out.append(np.sort(x[np.argpartition(at, n - 1)[:n]].astype(np.uint32)))
    return out


def prefix(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - -(-percent * n // 100) + 1


def overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Common tokens that linked sets of these sizes have at least."""
    return -(-percent * (a + b) // (100 + percent))


def possible(na: np.ndarray, i: np.ndarray, nb: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, whose first common tokens are at these places, may be linked."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - i, nb - j) >= overlap(na, nb, percent))


def parity(h: np.ndarray) -> bytes:
    """Which bits an odd number of tokens falls on; at least 2048 bits, and as many as there are tokens or more."""
    bits = max(64 * _WORDS, 1 << (max(1, len(h)) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (last axis) of fewer bits: tokens fall on the lower bits of where they fell."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two parities differ; no more than the tokens that only one of the sets has."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def meets(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return bool((a[at] == b).any())


def _unpack_others(data: bytes) -> list[np.ndarray]:
    x = np.frombuffer(data, dtype=np.uint32)
    return np.split(x, len(_SALTS))


# --- buckets of the first order ----------------------------------------------------------------------------


def _prefixes(docs: DataFrame, reps: DataFrame, known: Frequent, percent: int, fewest: int) -> DataFrame:
    """(token, place, id) of the first order's prefixes; place has size and position.

    Most documents that don't stand for their class (``reps``: id) are sorted out by a bitmap, and a task sends equal sets once.
    """
    spot, maybe = id_bitmap(reps, "id")
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.filter(maybe_in(maybe.value, batch["p"]))
            for first, rows, h, cuts, keys in _keyed_sets(batch["text"]):
                x = first_order(h, shared.value)
                out: list[tuple[np.ndarray, int, int]] = []
                for i, key, lo, hi in zip(batch["id"].slice(first, rows).to_pylist(), keys, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if hi - lo >= fewest and key not in seen:
                        seen.add(key)
                        out.append((np.sort(x[lo:hi])[: prefix(hi - lo, percent)], i, hi - lo))
                if out:
                    many = np.array([len(t) for t, _, _ in out])
                    place = np.concatenate([np.arange(k) for k in many]) + (np.repeat(np.array([n for _, _, n in out], dtype=np.int64), many) << 32)
                    ids = np.repeat(np.array([i for _, i, _ in out], dtype=np.int64), many)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t for t, _, _ in out]).view(np.int64)), pa.array(place), pa.array(ids)], names=["token", "place", "id"])

    return docs.filter("id IS NOT NULL").select("id", "text", spot.alias("p")).mapInArrow(read, "token long, place long, id long")


def _places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 32, place & 0xFFFFFFFF


def _bucket_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the members that a large bucket pairs: neighbours, and all with the smallest identifier."""
    k = np.arange(len(ids))
    return np.concatenate([k[:-1], k[:-2], np.full(len(k), ids.argmin())]), np.concatenate([k[1:], k[2:], k])


def _pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(kind, a, b, place): kind 0 possible pair; 1 member b of large bucket a; 2 first member b of bucket a in a partition that may not hold all of it."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "id", "place")
        rest = [np.zeros(0, dtype=np.int64) for _ in names]
        first = True

        def emit(token: np.ndarray, ids: np.ndarray, place: np.ndarray, head: bool, tail: bool) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            size = np.diff(cuts)
            n, at = _places(place)
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

            def add(x: np.ndarray, y: np.ndarray) -> None:
                ok = possible(n[x], at[x], n[y], at[y], percent) & (ids[x] != ids[y])
                x, y = ids[x[ok]], ids[y[ok]]
                if len(x):
                    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                    out.append((0, both[0], both[1], np.zeros(both.shape[1], dtype=np.int64)))

            for k in range(2, SMALL_BUCKET + 1):
                i, j = np.triu_indices(k, 1)
                starts = cuts[:-1][size == k]
                add((starts[:, None] + i).reshape(-1), (starts[:, None] + j).reshape(-1))
            edges = ({0} if head else set()) | ({len(size) - 1} if tail else set())
            for r in sorted(set(np.flatnonzero(size > SMALL_BUCKET)) | edges):
                lo, hi = cuts[r], cuts[r + 1]
                if hi - lo > SMALL_BUCKET:
                    x, y = _bucket_pairs(ids[lo:hi])
                    add(x + lo, y + lo)
                out.append((1, token[lo:hi], ids[lo:hi], place[lo:hi]))
                if r in edges:
                    out.append((2, token[lo : lo + 1], ids[lo:hi].min(keepdims=True), place[lo : lo + 1]))
            if out:
                kinds = np.repeat(np.array([o[0] for o in out], dtype=np.int32), [len(o[1]) for o in out])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *[pa.array(np.concatenate([o[k] for o in out])) for k in (1, 2, 3)]], names=["kind", "a", "b", "place"])

        for batch in batches:
            now = [np.concatenate([r, batch[c].to_numpy(zero_copy_only=False)]) for r, c in zip(rest, names, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1], side="left"))  # the last bucket may go on
            if last:
                yield from emit(*[x[:last] for x in now], first, False)
                first = False
            rest = [x[last:] for x in now]
            if len(rest[0]) > 1_000_000:  # a very large bucket goes in parts, as over partitions
                yield from emit(*rest, True, True)
                rest, first = [x[:0] for x in rest], True
        if len(rest[0]):
            yield from emit(*rest, first, True)

    ordered = prefixes.repartitionByRange("token", "place", "id").sortWithinPartitions("token", "place", "id")
    return ordered.select("token", "id", "place").mapInArrow(pairs, "kind int, a long, b long, place long")


# --- the other orders, and full sets -------------------------------------------------------------------------


def _wanted(docs: DataFrame, wanted: DataFrame, columns: dict[str, Callable[[np.ndarray], bytes]], kind: str) -> DataFrame:
    """(id, key, n, columns) of the documents in ``wanted`` (ids), each column made from a set; only their texts are hashed.

    A bitmap of hashed ids, of 32 MB at most, sorts out most others before a join on the id.
    """
    spot, maybe = id_bitmap(wanted, "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(maybe_in(maybe.value, batch["p"]))
            for first, rows, h, cuts, keys in _keyed_sets(batch["text"]):
                sets = [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                own = [pa.array([make(x) if len(x) else b"" for x in sets], pa.binary()) for make in columns.values()]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(first, rows), pa.array(keys, pa.binary()), pa.array(np.diff(cuts).astype(np.int64)), *own], names=["id", "key", "n", *columns])

    rows = docs.filter("id IS NOT NULL").select("id", "text", spot.alias("p")).mapInArrow(read, "id long, key binary, n long" + "".join(f", {c} binary" for c in columns)).filter("key IS NOT NULL")
    return stored(rows.join(wanted.withColumnRenamed("id", "w"), F.col("id") == F.col("w"), "left_semi").dropDuplicates(["id", "key"]), kind)


def _features(docs: DataFrame, wanted: DataFrame, known: Frequent, percent: int) -> DataFrame:
    """(id, key, n, others, parity): what the filters look at."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    return _wanted(docs, wanted, {"others": lambda h: np.concatenate(other_prefixes(h, prefix(len(h), percent), shared.value)).tobytes(), "parity": parity}, "features")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, key, n, shingles)."""
    return _wanted(docs, wanted, {"shingles": lambda h: h.tobytes()}, "sets")


def _both(pairs: DataFrame, features: DataFrame, column: str) -> DataFrame:
    """(a, b, n1, n2, x1, x2): each pair with a feature of its ends; only the features of ends that occur are dealt."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = _those_of(features, ends).select("id", "n", column)
    one, other = (own.select(F.col("id").alias(f"i{k}"), F.col("n").alias(f"n{k}"), F.col(column).alias(f"x{k}")) for k in "12")
    return pairs.join(one, F.col("a") == F.col("i1")).join(other, F.col("b") == F.col("i2")).select("a", "b", "n1", "n2", "x1", "x2")


def _those_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``, and few others: a bitmap of at most 32 MB keeps most others out of a shuffle."""
    spot, maybe = id_bitmap(ids, "id")
    columns = rows.columns

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(maybe_in(maybe.value, batch["_spot"])).select(columns)

    return rows.withColumn("_spot", spot).mapInArrow(some, rows.schema)


def _meeting(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities differ no more than linked sets may, and whose prefixes meet under every further order; the wider prefixes travel only for what the parities let pass."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n1, n2 = (batch[c].to_numpy() for c in ("n1", "n2"))
            most = n1 + n2 - 2 * overlap(n1, n2, percent)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                p, q = (np.frombuffer(batch[c][k].as_buffer(), dtype=np.uint64) for c in ("x1", "x2"))
                keep[k] = differing(p, q) <= most[k]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [all(meets(x, y) for x, y in zip(*(_unpack_others(batch[c][k].as_buffer()) for c in ("x1", "x2")), strict=True)) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = checkpointed(_both(pairs, features, "parity").mapInArrow(alike, "a long, b long").distinct())
    return _both(near, features, "others").mapInArrow(meet, "a long, b long").distinct()


# --- large buckets -------------------------------------------------------------------------------------------


def _open(rows: DataFrame, block: int) -> DataFrame:
    """Members (bucket, id, c, ...) of buckets with several components, with the main one and numbers of blocks; the sizes of buckets go through one row a bucket and component."""
    per = rows.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("m"))
    split = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "c")).alias("most"), F.sum("m").alias("all")).filter("parts > 1")
    split = checkpointed(split.select(F.col("bucket").alias("k"), F.col("most.c").alias("main"), F.ceil((F.col("all") - F.col("most.m")) / block).cast("int").alias("rest_blocks"), F.ceil(F.col("all") / block).cast("int").alias("all_blocks")))
    return stored(few_parts(rows.join(split, F.col("bucket") == F.col("k")).drop("k")), "open")


def _dealt(open_: DataFrame, columns: list[str]) -> DataFrame:
    """Open members so dealt that every block of those outside the main component meets every block of all.

    A bucket of one block goes once: its side 0 also stands on side 1.
    """
    deal = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    single = F.col("all_blocks") == 1
    whole = open_.filter(single).select("bucket", *columns, F.lit(0).alias("x"), F.lit(-1).alias("y"), F.when(F.col("c") != F.col("main"), 0).otherwise(1).alias("side"))
    rest = open_.filter(~single & (F.col("c") != F.col("main"))).select("bucket", *columns, deal(1, "rest_blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("y"), F.lit(0).alias("side"))
    every = open_.filter(~single).select("bucket", *columns, F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("x"), deal(2, "all_blocks").alias("y"), F.lit(1).alias("side"))
    return whole.unionByName(rest).unionByName(every).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "side")


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[list], list[list]]]:
    """(bucket, rows of side 0, rows of side 1) of every block with both sides."""
    at, held = None, ([], [])

    def sides() -> tuple[list[list], list[list]]:
        return held[0], held[0] + held[1] if at[2] == -1 else held[1]

    for batch in batches:
        for bucket, x, y, side, *row in zip(*(batch[c].to_pylist() for c in ("bucket", "x", "y", "side", *columns)), strict=True):
            if at != (bucket, x, y):
                if at is not None and all(sides()):
                    yield at[0], *sides()
                at, held = (bucket, x, y), ([], [])
            held[side].append(row)
    if at is not None and all(sides()):
        yield at[0], *sides()


def _near(rest: list[list], every: list[list], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row (id, c, place, parity, ...) of ``rest``, the numbers of those of ``every`` in other components that may be linked to it."""
    (ci, pi), (cj, pj) = ((np.array([r[1] for r in h], dtype=np.int64), np.array([r[2] for r in h], dtype=np.int64)) for h in (rest, every))
    (ni, i), (nj, j) = _places(pi), _places(pj)
    wide = np.array([len(r[3]) // 8 for r in every])
    bits = {int(w): np.frombuffer(b"".join(r[3] for r in every if len(r[3]) == 8 * w), dtype=np.uint64).reshape(-1, w) for w in np.unique(wide)}
    place = np.zeros(len(every), dtype=np.int64)  # of each row among those of its width
    for w in bits:
        place[wide == w] = np.arange(len(bits[w]))
    narrower: dict[tuple[int, int], np.ndarray] = {}
    for r in range(len(rest)):
        far = np.flatnonzero((cj != ci[r]) & possible(ni[r], i[r], nj, j, percent))
        if not len(far):
            continue
        own, near = np.frombuffer(rest[r][3], dtype=np.uint64), []
        for w in np.unique(wide[far]).tolist():
            m = min(w, len(own))
            if (w, m) not in narrower:
                narrower[w, m] = folded(bits[w], m)
            some = far[wide[far] == w]
            differ = np.bitwise_count(narrower[w, m][place[some]] ^ folded(own, m)).sum(axis=1, dtype=np.int64)
            near.append(some[differ <= ni[r] + nj[some] - 2 * overlap(ni[r], nj[some], percent)])
        if sum(map(len, near)):
            yield r, np.sort(np.concatenate(near))


def _whole_buckets(docs: DataFrame, members: DataFrame, labels: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components in large buckets."""
    own = labels.select(F.col("node").alias("node"), F.col("component").alias("c"))
    tagged = members.join(own, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("c", "id").alias("c"), "place")
    apart = _open(tagged, NARROW_BLOCK)
    with_bits = apart.join(features.select(F.col("id").alias("i"), "parity"), F.col("id") == F.col("i"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rest, every in _blocks(batches, ["id", "c", "place", "parity"]):
            one, other = np.zeros(len(rest), dtype=bool), np.zeros(len(every), dtype=bool)
            for r, far in _near(rest, every, percent):
                one[r], other[far] = True, True
            ids = np.unique([h[k][0] for h, some in ((rest, one), (every, other)) for k in np.flatnonzero(some)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bucket, dtype=np.int64)), pa.array(ids)], names=["b", "m"])

    left = checkpointed(_dealt(with_bits, ["id", "c", "place", "parity"]).mapInArrow(narrow, "b long, m long").distinct())
    survivors = _open(apart.drop("main", "rest_blocks", "all_blocks").join(left, (F.col("bucket") == F.col("b")) & (F.col("id") == F.col("m")), "left_semi"), BLOCK)
    some = left.select(F.col("m").alias("id")).distinct()
    sets = _full_sets(docs, some).select("id", "key", "shingles").join(_those_of(features.select("id", "key", "others", "parity"), some), ["id", "key"])
    fat = survivors.join(sets.withColumnRenamed("id", "of"), F.col("id") == F.col("of"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rest, every in _blocks(batches, ["id", "c", "place", "parity", "others", "shingles"]):
            up: dict[int, int] = {}

            def root(c: int, up: dict[int, int] = up) -> int:
                while (d := up.get(c, c)) != c:
                    up[c] = c = up.get(d, d)
                return c

            prefixes = [[_unpack_others(r[4]) for r in h] for h in (rest, every)]
            shingles = [[np.frombuffer(r[5], dtype=np.uint64) for r in h] for h in (rest, every)]
            links: list[tuple[int, int]] = []
            for r, far in _near(rest, every, percent):
                for k in far.tolist():
                    one, other = root(rest[r][1]), root(every[k][1])
                    if one != other and all(meets(x, y) for x, y in zip(prefixes[0][r], prefixes[1][k], strict=True)) and _linked(shingles[0][r], shingles[1][k], percent):
                        up[max(one, other)] = min(one, other)
                        links.append((rest[r][0], every[k][0]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return _dealt(fat, ["id", "c", "place", "parity", "others", "shingles"]).mapInArrow(compare, "a long, b long").distinct()


# --- the join --------------------------------------------------------------------------------------------------


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: n_shingles, and component_id, the smallest identifier reachable by links of ``percent`` (1 to 99) of common shingles or more."""
    if not 1 <= percent <= 99:
        raise ValueError(f"percent must be from 1 to 99, not {percent}")
    shared_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    read = stored(_drawn(texts), "drawn")
    known = _frequent(read)
    drawn = read.filter("n >= 0").select("id", "n", "key")
    valid = drawn.filter("key IS NOT NULL AND id IS NOT NULL")
    classes = checkpointed(valid.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    total = drawn.count()
    named = checkpointed(left_join_groups(valid, classes, "key", "rows", total).select("id", "rep").filter("id <> rep"))
    # Rows with one identifier and different texts make one node of their classes.
    several = checkpointed(valid.select("id", "key").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("id").alias("twice")))
    same = checkpointed(named.join(several, F.col("id") == F.col("twice"), "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())

    # A smaller set links with equal sets only.
    fewest = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1))
    made = stored(few_parts(_pairs(_prefixes(texts, classes.select(F.col("rep").alias("id")), known, percent, fewest), percent)), "pairs")
    to_rep = named.join(several, F.col("id") == F.col("twice"), "left_anti").select(F.col("id").alias("i"), F.col("rep").alias("r")).distinct()
    heads = made.filter("kind = 2").groupBy(F.col("a").alias("bucket")).agg(F.min("b").alias("least"))
    joints = made.filter("kind = 2").join(heads, F.col("a") == F.col("bucket")).select(F.col("least").alias("a"), "b")
    raw = made.filter("kind = 0").select("a", "b").unionByName(joints).filter("a <> b").distinct()

    def by_class(rows: DataFrame, column: str) -> DataFrame:
        """Identifiers after those of their classes."""
        return rows.join(to_rep, F.col(column) == F.col("i"), "left").withColumn(column, F.coalesce("r", column)).drop("i", "r")

    pairs = by_class(by_class(raw, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = checkpointed(pairs)
    members = checkpointed(by_class(made.filter("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("id"), "place"), "id").distinct())
    wanted = checkpointed(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct())
    features = _features(texts, wanted, known, percent)

    likely = checkpointed(_meeting(pairs, features, percent))
    shingles = _full_sets(texts, likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()).select("id", "shingles")
    best = likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    labels = checkpointed(contract(_verified(best, shingles, percent).unionByName(same)))
    rest = checkpointed(_apart(likely, labels).join(best, ["a", "b"], "left_anti"))
    labels = contract(_verified(rest, shingles, percent), labels)
    labels = contract(_whole_buckets(texts, members, labels, features, percent), labels)

    final = classes.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rows", F.coalesce("component", "rep").alias("component"))
    by_key = left_join_groups(drawn.select("key", "id", "n"), final, "key", "rows", total)
    return by_key.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
