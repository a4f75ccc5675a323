"""Near-duplicate detection with SetSketch registers (operator 10).

A document's set is its distinct 5-word shingles, hashed to 64 bits.  Register i of a set is
``floor(1 - log_b h_i)`` cut to 0..255, where h_i is the smallest of the elements' exponential
variates; registers of a union are the larger of each, so sketches merge.  The variates of an
element are the arrivals of a Poisson process dealt to random registers, so an element costs
only the arrivals before the time by which all registers of its set are hit.

1. Documents with equal sets form a class; only a class's smallest document goes on.
2. Bands of registers, 8 at 85 percent, are sorted by value; equal bands are buckets.  A bucket of up to 8 gives
   all pairs; a larger one gives each member's neighbours in the order of the next band and its
   link to the smallest member, so pairs stay linear in the rows.  A bucket may span range partitions.
3. The counts of registers that are larger, smaller and equal give the likelihood of the Jaccard
   similarity for the known set sizes; pairs far below the threshold go.
4. The others are verified on full sets, each document's likeliest pair first; then the pairs
   that still join different components.
5. Large buckets whose members are still in different components are compared whole, in blocks:
   sketches propose pairs between components, full sets verify them on the spot, and only links
   that join two components leave the block.  So no pair that shares a band goes unexamined
   unless its ends are already connected.

The least similarity of a link is a parameter; the cut of estimates, the size filters and the width
of bands follow from it.  A pair at similarity 0.85 shares no band of the 48 with probability 3e-7;
at 0.8 bands are 6 wide, and a pair shares none of the 64 with probability 4e-9.

Defined results: a null or blank text has an empty set and is linked with nothing; a text of fewer
than 5 words is one shingle; a null identifier cannot be named, so such a row is linked with nothing and kept;
rows with one identifier are one node; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, few_parts, id_bitmap, left_join_groups, maybe_in, shared_dir, stored
from .components import contract
from .words import SPACED, Words, mix, split_words

SHINGLE = 5
#: A link: 100 * |A and B| >= percent * |A or B|; this is the percentage unless a caller gives another.
PERCENT = 85
REGISTERS = 384
#: Bands are as wide as this probability of sharing none lets them be, for a pair at the percentage.
MISS = 1e-6
BASE, RATE = 1.08, 20.0
#: Up to this size a bucket gives all its pairs.
SMALL_BUCKET = 8
#: Members of a block when a large bucket is compared whole.
BLOCK = 256
#: Sets are drawn so many at once at most, and about so many elements of them.
SETS_ROWS, SETS_ELEMENTS = 8192, 400_000
#: Members of buckets that a task counts at once.
COUNT_ROWS = 1_000_000
#: Standard errors of the estimate below the threshold at which a pair is let go.
SLACK = 4.5
_GAP = np.uint64(0x9E3779B97F4A7C15)


# --- sets and registers ----------------------------------------------------------------------------


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All rows' sets: sorted distinct shingle hashes, row by row, and rows + 1 cuts."""
    h, whole = w.windows(k), w.whole(k)
    row = w.row_of_word()[whole]
    h = h[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        # A text of n < k words: its n-word window, set apart from windows of other lengths.
        one = np.empty(len(short), dtype=np.uint64)
        for n in range(1, k):
            of = w.counts[short] == n
            if of.any():
                one[of] = mix(w.windows(n)[w.first[short[of]]] + np.uint64(n))
        h, row = np.concatenate([h, one]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(w.rows + 1))


def registers(h: np.ndarray, cuts: np.ndarray, m: int = REGISTERS, fewest: int = 1) -> np.ndarray:
    """The sketches (rows x m, uint8) of the sets h[cuts[r]:cuts[r+1]]; those of fewer than ``fewest`` elements have registers 0."""
    sizes = np.diff(cuts)
    least = np.full((len(sizes), m), np.inf)
    pending, reach = np.flatnonzero(sizes >= fewest), np.log(m) + 5.0
    while len(pending):
        _arrivals(h, cuts, sizes, pending, reach, least, m)
        pending, reach = pending[np.isinf(least[pending]).any(axis=1)], reach * 2
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.nan_to_num(k, neginf=0), 0, 255).astype(np.uint8)


def _arrivals(h: np.ndarray, cuts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, reach: float, least: np.ndarray, m: int) -> None:
    """All arrivals of the rows' elements up to the time reach / size."""
    n = sizes[rows]
    at = np.repeat(cuts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    state, row, until = h[at], np.repeat(rows, n), np.repeat(reach / n, n)
    time = np.zeros(len(state))
    flat = least.reshape(-1)
    while len(state):
        state = state + _GAP
        x = mix(state)
        time = time - np.log1p(-(x >> np.uint64(11)).astype(np.float64) * 2.0**-53) / m
        on = time <= until
        state, row, until, time, x = state[on], row[on], until[on], time[on], x[on]
        np.minimum.at(flat, row * m + (mix(x ^ _GAP) % np.uint64(m)).astype(np.int64), time)


_likely_grid = np.linspace(0.0, 1.0, 201)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity from two sketches and the set sizes, pair by pair."""
    more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    return likelihood(more, less, a.shape[-1], na, nb)


def likelihood(more: np.ndarray, less: np.ndarray, m: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    u = na / (na + nb)
    v = 1 - u
    grid = _likely_grid * np.minimum(u / v, v / u)[..., None]
    share = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = share(u[..., None] - v[..., None] * grid), share(v[..., None] - u[..., None] * grid)
    same = np.clip(1 - up - down, 1e-12, 1)
    score = more[..., None] * np.log(up) + less[..., None] * np.log(down) + (m - more - less)[..., None] * np.log(same)
    return np.take_along_axis(grid, score.argmax(axis=-1)[..., None], axis=-1)[..., 0]


def _band(percent: int) -> int:
    """Registers in a band: a divisor of REGISTERS, 8 at most."""
    missed = lambda width: (1 - (percent / 100) ** width) ** (REGISTERS // width)
    return next((width for width in (8, 6, 4, 3, 2) if missed(width) <= MISS), 1)


def _cut(percent: int) -> float:
    j = percent / 100
    return j - SLACK * float(np.sqrt(j * (1 - j) / REGISTERS))


# --- stages ------------------------------------------------------------------------------------------

_SKETCH = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary())])


def sketches(docs: DataFrame, fewest: int = 1) -> DataFrame:
    """(id, n, key, sketch) of every row; key is a digest of the set, null for an empty one.

    Sets of fewer than ``fewest`` elements, which can only be equal to others, have registers 0.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        elements = rows = 0

        def drawn() -> pa.RecordBatch:
            ids, h, sizes = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            held.clear()
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            keys = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            data = pa.py_buffer(np.ascontiguousarray(registers(h, cuts, fewest=fewest)).reshape(-1))
            own = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.arange(0, (len(sizes) + 1) * REGISTERS, REGISTERS, dtype=np.int32)), data])
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary()), own], schema=_SKETCH)

        for batch in batches:
            for w in split_words(batch["text"], SPACED, lower=True):
                h, cuts = shingle_sets(w)
                held.append((batch["id"].slice(w.first_row, w.rows), h, np.diff(cuts)))
                elements, rows = elements + len(h), rows + w.rows
                # Drawing goes by steps that all sets take together, so some thousand sets go at once.
                if elements >= SETS_ELEMENTS or rows >= SETS_ROWS:
                    yield drawn()
                    elements = rows = 0
        if held:
            yield drawn()

    return docs.mapInArrow(sketch, "id long, n long, key binary, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)


def _bands(reps: DataFrame, width: int) -> DataFrame:
    """(band, follow, id): a row for each band; follow orders a bucket by the next band."""
    n = REGISTERS // width

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            padded = np.zeros((batch.num_rows, n, 8), dtype=np.uint8)
            padded[..., :width] = _matrix(batch["sketch"]).reshape(-1, n, width)
            values = padded.view("<u8")[..., 0]
            band = mix(values + (np.arange(n, dtype=np.uint64) + np.uint64(1)) * _GAP)
            follow = np.roll(values.byteswap(), -1, axis=1)
            ids = np.repeat(batch["id"].to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(band.reshape(-1).view(np.int64)), pa.array(np.ascontiguousarray(follow).reshape(-1).view(np.int64)), pa.array(ids)], names=["band", "follow", "id"])

    return reps.select("id", "sketch").mapInArrow(bands, "band long, follow long, id long")


def _bucket_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(ids)
    if k <= SMALL_BUCKET:
        i, j = np.triu_indices(k, 1)
        return ids[i], ids[j]
    least = np.full(k, ids.min())
    return np.concatenate([ids[:-1], ids[:-2], least]), np.concatenate([ids[1:], ids[2:], ids])


def _pairs(bands: DataFrame) -> DataFrame:
    """(kind, a, b): kind 0 candidate pair; 1 member b of large bucket a; 2 first member b of bucket a in a partition that may not hold all of it."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_band, rest_id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first = True

        def emit(band: np.ndarray, ids: np.ndarray, head: bool, tail: bool) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
            size = np.diff(cuts)
            kinds, a, b = [], [], []

            def add(kind: int, x: np.ndarray, y: np.ndarray) -> None:
                kinds.append(np.full(len(x), kind, dtype=np.int32))
                a.append(x)
                b.append(y)

            two = cuts[:-1][size == 2]
            add(0, ids[two], ids[two + 1])
            edges = ({0} if head else set()) | ({len(size) - 1} if tail else set())
            for r in sorted(set(np.flatnonzero(size > 2)) | edges):
                lo, hi = cuts[r], cuts[r + 1]
                if hi - lo > 2:
                    add(0, *_bucket_pairs(ids[lo:hi]))
                if hi - lo > SMALL_BUCKET or r in edges:
                    add(1, band[lo:hi], ids[lo:hi])
                if r in edges:
                    add(2, band[lo : lo + 1], ids[lo:hi].min(keepdims=True))
            kinds, a, b = np.concatenate(kinds), np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        for batch in batches:
            band = np.concatenate([rest_band, batch["band"].to_numpy(zero_copy_only=False)])
            ids = np.concatenate([rest_id, batch["id"].to_numpy(zero_copy_only=False)])
            if not len(band):
                continue
            last = int(np.searchsorted(band, band[-1], side="left"))  # the last bucket may go on
            if last:
                yield from emit(band[:last], ids[:last], first, False)
                first = False
            rest_band, rest_id = band[last:], ids[last:]
            if len(rest_band) > 1_000_000:  # a very large bucket goes in parts, as over partitions
                yield from emit(rest_band, rest_id, True, True)
                rest_band, rest_id, first = rest_band[:0], rest_id[:0], True
        if len(rest_band):
            yield from emit(rest_band, rest_id, first, True)

    ordered = bands.repartitionByRange("band", "follow", "id").sortWithinPartitions("band", "follow", "id")
    return ordered.select("band", "id").mapInArrow(pairs, "kind int, a long, b long")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, j) of the pairs whose likeliest similarity is not far below the threshold."""
    one, other = (reps.select(F.col("id").alias(f"i{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "12")
    both = pairs.join(one, F.col("a") == F.col("i1")).join(other, F.col("b") == F.col("i2")).select("a", "b", "n1", "n2", "s1", "s2")
    cut = _cut(percent)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                n1, n2 = (part[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n1", "n2"))
                j = estimate(_matrix(part["s1"]), _matrix(part["s2"]), n1, n2)
                yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(j)], names=["a", "b", "j"]).filter(pa.array(j >= cut))

    return both.mapInArrow(judge, "a long, b long, j double")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``wanted`` (ids); only their texts are hashed.

    A bitmap of hashed ids, of 32 MB at most, sorts out most others before a join on the id.
    """
    place, maybe = id_bitmap(wanted, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(maybe_in(maybe.value, batch["p"]))
            for w in split_words(batch["text"], SPACED, lower=True):
                h, cuts = shingle_sets(w)
                data = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(w.first_row, w.rows), pa.array(data, pa.binary())], names=["id", "shingles"])

    own = docs.filter("id IS NOT NULL").select("id", "text", place.alias("p")).mapInArrow(sets, "id long, shingles binary")
    return stored(own.join(wanted.withColumnRenamed("id", "w"), F.col("id") == F.col("w"), "left_semi"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets.

    A set travels once for each pair as b and once for each 512 pairs as a.
    """
    many = pairs.groupBy(F.col("a").alias("hub")).agg(F.count(F.lit(1)).alias("n")).select("hub", F.ceil(F.col("n") / 512).cast("int").alias("parts"))
    hubs = many.join(sets, F.col("hub") == F.col("id")).select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("role"), "shingles")
    salted = pairs.join(many, F.col("a") == F.col("hub")).select("hub", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = salted.join(sets, F.col("b") == F.col("id")).select("hub", "part", "b", F.lit(1).alias("role"), "shingles")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for hub, part, b, role, data in zip(*(batch[c].to_pylist() for c in ("hub", "part", "b", "role")), batch["shingles"], strict=True):
                s = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if role == 0:
                    if at != (hub, part):
                        at, own = (hub, part), []
                    own.append(s.copy())
                elif at == (hub, part) and any(_linked(s, o, percent) for o in own):
                    out[0].append(hub)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], schema=schema)

    rows = hubs.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return checkpointed(rows.mapInArrow(verify, "a long, b long").distinct())


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    least, most = min(len(x), len(y)), max(len(x), len(y))
    if 100 * least < percent * most or not least:
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    common = int((x[at] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components; a node without a label is one by itself."""
    one, other = (labels.select(F.col("node").alias(f"n{i}"), F.col("component").alias(f"c{i}")) for i in "12")
    both = pairs.join(one, F.col("a") == F.col("n1"), "left").join(other, F.col("b") == F.col("n2"), "left")
    return both.filter(F.coalesce("c1", "a") != F.coalesce("c2", "b")).select(*pairs.columns)


def _component_counts(members: DataFrame, own: DataFrame) -> DataFrame:
    """(bucket, c, n): members of each bucket and component (``own``: n, c) that a task met, to be summed.

    A member's component is looked up once, however many buckets it is in.
    """
    by_id = members.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            all_ = np.concatenate(held, axis=1)
            held.clear()
            (bucket, c), n = np.unique(all_[:2], axis=1, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(c), pa.array(np.bincount(n.reshape(-1), weights=all_[2]).astype(np.int64))], names=["bucket", "c", "n"])

        for batch in batches:
            buckets = batch["buckets"]
            bucket = buckets.flatten().to_numpy(zero_copy_only=False)
            c = np.repeat(batch["c"].to_numpy(zero_copy_only=False), buckets.value_lengths().to_numpy(zero_copy_only=False))
            held.append(np.stack([bucket, c, np.ones(len(bucket), dtype=np.int64)]))
            if sum(h.shape[1] for h in held) >= COUNT_ROWS:
                yield summed()
        if held:
            yield summed()

    return by_id.join(own, F.col("id") == F.col("n"), "left").select(F.coalesce("c", "id").alias("c"), "buckets").mapInArrow(counted, "bucket long, c long, n long")


def _whole_buckets(members: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components in large buckets, all members compared in blocks."""
    own = labels.select(F.col("node").alias("n"), F.col("component").alias("c"))
    per = _component_counts(members, own).groupBy("bucket", "c").agg(F.sum("n").alias("n"))
    split = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("size")).filter("parts > 1").select(F.col("bucket").alias("k"), F.col("most.c").alias("main"), F.ceil((F.col("size") - F.col("most.n")) / BLOCK).cast("int").alias("rest_blocks"), F.ceil(F.col("size") / BLOCK).cast("int").alias("all_blocks"))
    # Only members of buckets with several components get their component, row by row.
    apart = members.join(checkpointed(split), F.col("bucket") == F.col("k"))
    tagged = apart.join(own, F.col("id") == F.col("n"), "left").withColumn("c", F.coalesce("c", "id")).drop("n")
    open_ = tagged.join(reps.select(F.col("id").alias("i"), F.col("n").alias("size"), "sketch"), F.col("id") == F.col("i")).join(sets.withColumnRenamed("id", "of"), F.col("id") == F.col("of"))
    deal = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    keep = ["bucket", "id", "c", "size", "sketch", "shingles"]
    # Every block of members outside the main component meets every block of all members.
    rest = open_.filter("c <> main").select(*keep, deal(1, "rest_blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("y"), F.lit(0).alias("side"))
    all_ = open_.select(*keep, F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("x"), deal(2, "all_blocks").alias("y"), F.lit(1).alias("side"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    cut = _cut(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def done() -> pa.RecordBatch:
            (i, ci, ni, si), (j, cj, nj, sj) = (
                (np.array([r[0] for r in h], dtype=np.int64), np.array([r[1] for r in h], dtype=np.int64), np.array([r[2] for r in h], dtype=float), np.frombuffer(b"".join(r[3] for r in h), dtype=np.uint8).reshape(-1, REGISTERS)) for h in held
            )
            sets_i, sets_j = ([np.frombuffer(r[4], dtype=np.uint64) for r in h] for h in held)
            up: dict[int, int] = {}

            def root(c: int) -> int:
                while (d := up.get(c, c)) != c:
                    up[c] = c = up.get(d, d)
                return c

            out: tuple[list, list] = ([], [])
            for r in range(len(i)):
                far = np.flatnonzero((cj != ci[r]) & (np.minimum(nj, ni[r]) * 100 >= percent * np.maximum(nj, ni[r])))
                # Equal registers alone bound the estimate closely enough to skip most.
                far = far[(sj[far] == si[r]).sum(axis=1) >= (cut - 0.05) * REGISTERS]
                if not len(far):
                    continue
                est = estimate(np.broadcast_to(si[r], (len(far), REGISTERS)), sj[far], np.full(len(far), ni[r]), nj[far])
                for k in far[np.argsort(-est, kind="stable")][: int((est >= cut).sum())]:
                    one, other = root(int(ci[r])), root(int(cj[k]))
                    if one != other and _linked(sets_i[r], sets_j[k], percent):
                        up[max(one, other)] = min(one, other)
                        out[0].append(i[r])
                        out[1].append(j[k])
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], schema=schema)

        for batch in batches:
            for bucket, x, y, side, *row in zip(*(batch[c].to_pylist() for c in ("bucket", "x", "y", "side", "id", "c", "size", "sketch", "shingles")), strict=True):
                if at != (bucket, x, y):
                    if at is not None and held[0] and held[1]:
                        yield done()
                    at, held = (bucket, x, y), ([], [])
                held[side].append(row)
        if at is not None and held[0] and held[1]:
            yield done()

    rows = rest.unionByName(all_).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: n_shingles, component_id, and whether it is its component's smallest.

    Documents of ``percent`` (1 to 99) of common shingles or more are linked.
    """
    if not 1 <= percent <= 99:
        raise ValueError(f"percent must be from 1 to 99, not {percent}")
    shared_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # A smaller set (fewer than 6 at 85 percent) links with equal sets only.
    fewest = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1))
    drawn = stored(sketches(texts, fewest), "sketches")
    known = drawn.filter("key IS NOT NULL AND id IS NOT NULL")
    classes = checkpointed(known.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    mine = classes.select(F.col("key").alias("k"), "rep")
    reps = stored(few_parts(known.filter(F.col("n") >= fewest).join(mine, (F.col("key") == F.col("k")) & (F.col("id") == F.col("rep")), "left_semi").dropDuplicates(["id", "key"]).select("id", "n", "sketch")), "reps")
    made = stored(few_parts(_pairs(_bands(reps, _band(percent)))), "pairs")

    heads = made.filter("kind = 2").groupBy(F.col("a").alias("bucket")).agg(F.min("b").alias("least"))
    joints = made.filter("kind = 2").join(heads, F.col("a") == F.col("bucket")).select(F.col("least").alias("x"), F.col("b").alias("y"))
    raw = made.filter("kind = 0").select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(joints)
    pairs = raw.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    likely = checkpointed(_estimated(pairs, reps, percent))
    members = checkpointed(made.filter("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("id")).distinct())

    wanted = checkpointed(likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct())
    sets = _sets_of(texts, wanted)
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("j", (-F.col("a")).alias("o"))).alias("a")).select("a", "b")
    labels = checkpointed(contract(_verified(best, sets, percent)))
    rest = checkpointed(_apart(likely.select("a", "b"), labels).join(best, ["a", "b"], "left_anti"))
    labels = contract(_verified(rest, sets, percent), labels)
    labels = contract(_whole_buckets(members, labels, reps, sets, percent), labels)

    final = classes.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rows", F.coalesce("component", "rep").alias("component"))
    # Classes that share a document belong together.
    by_key = left_join_groups(drawn.select("key", "id", "n"), final, "key", "rows", drawn.count())
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return by_key.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` drops; columns stay as they are, whatever their names."""
    dropped = near_duplicates(docs, id_col, text_col, percent).filter("NOT kept").select(F.col("doc_id").alias("drop_id")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"))
    return packed.join(dropped, F.col("own") == F.col("drop_id"), "left_anti").select("row.*")
