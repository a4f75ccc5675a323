"""Centroid clustering of embeddings with Elkan's bounds (operator 13).

Vectors become integers, ``floor(scale * x)`` for each component, and all distances that decide are
exact integers.  Each vector carries an upper bound of the distance to its centroid and a lower
bound of the distance to each of the k; by the triangle inequality these, moved along by what the
centroids move, and the distances between centroids show most distances not to be needed.

* Upper bounds are rounded up, lower bounds and distances between centroids down, so that rounding
  never hides a nearer centroid.
* Only a strictly smaller upper bound skips a distance, so that ties are seen and go to the smaller number.

Spark holds the vectors and their bounds as a table that every round rewrites in one map over its
partitions, without a shuffle; k centroids are broadcast, and partial sums of clusters, at most k a
partition, are added up by a grouping.  The driver holds k centroids.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are
left out; components beyond 2**27 after scaling count as 2**27, as their distances leave a long; sums beyond a
long are its largest value; rows that share an identifier are vectors of their own; a vector without an
identifier is clustered but is a first centroid only after all others; with fewer vectors than centroids
there are as many centroids as vectors; equal centroids leave the larger number empty, and it stays; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
#: Beyond this a squared distance in 64 dimensions may leave a long.
LARGEST = 1 << 27
_WIDTHS = (np.int8, np.int16, np.int32)
_LONG = 2**63 - 1


# --- vectors as bytes ----------------------------------------------------------------------------------


def _pack(v: np.ndarray) -> list[bytes]:
    """Rows of integers, each in the narrowest type that holds it; its length tells the type."""
    most = np.abs(v).max(axis=1, initial=0)
    return [v[i].astype(next(t for t in _WIDTHS if most[i] <= np.iinfo(t).max)).tobytes() for i in range(len(v))]


def _unpack(column: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(column), dims), dtype=np.int64)
    for i, x in enumerate(column):
        data = x.as_buffer()
        out[i] = np.frombuffer(data, dtype=_WIDTHS[(data.size // dims).bit_length() - 1])
    return out


# --- bounds --------------------------------------------------------------------------------------------


def _up(squared: np.ndarray) -> np.ndarray:
    """No less than the root of an exact square."""
    return np.nextafter(np.nextafter(np.sqrt(np.asarray(squared, dtype=float)), np.inf), np.inf)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.nextafter(np.nextafter(np.sqrt(np.asarray(squared, dtype=float)), -np.inf), -np.inf))


def _lower32(x: np.ndarray) -> np.ndarray:
    """Kept in 32 bits, rounded down."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


class Round:
    """What a round knows of its centroids: themselves, how far each has moved, and half the distances between them."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.centroids = centroids
        self.moved = None if before is None else _up(((centroids - before) ** 2).sum(axis=1))
        between = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
        self.half = _down(between) / 2
        others = self.half + np.where(np.eye(len(centroids), dtype=bool), np.inf, 0)
        self.nearest_half = others.min(axis=1, initial=np.inf)


def assign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The vectors' nearest centroids, new bounds, and how many distances were taken.

    ``own`` is the centroid of the round before and ``upper`` and ``lower`` are the bounds then; in the first round these are 0, infinite and 0.
    """
    own, lower = own.copy(), lower.astype(float)
    exact = np.full(len(v), -1, dtype=np.int64)
    taken = 0
    if now.moved is None:
        upper = np.full(len(v), np.inf)
    else:
        upper = np.nextafter(upper + now.moved[own], np.inf)
        lower = np.maximum(0, np.nextafter(lower - now.moved, -np.inf))
    open_ = upper >= now.nearest_half[own]

    def distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        nonlocal taken
        taken += len(rows)
        return ((v[rows] - now.centroids[to]) ** 2).sum(axis=1)

    for j in range(len(now.centroids)):
        may = lambda rows, j=j: rows[(own[rows] != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= now.half[own[rows], j])]
        rows = may(np.flatnonzero(open_))
        loose = rows[exact[rows] < 0]
        if len(loose):
            exact[loose] = distance(loose, own[loose])
            upper[loose], lower[loose, own[loose]] = _up(exact[loose]), _down(exact[loose])
            rows = may(rows)
        if not len(rows):
            continue
        d = distance(rows, np.full(len(rows), j))
        lower[rows, j] = _down(d)
        better = (d < exact[rows]) | ((d == exact[rows]) & (j < own[rows]))
        to = rows[better]
        own[to], exact[to], upper[to] = j, d[better], _up(d[better])
    return own, upper, lower, taken


# --- rounds --------------------------------------------------------------------------------------------

_STATE = "vec_id long, v binary, cluster int, upper double, lower binary"


def _state(batch: pa.RecordBatch, v: list | pa.Array, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    low = [x.tobytes() for x in _lower32(lower)]
    return pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(v, pa.binary()), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(low, pa.binary())], names=["vec_id", "v", "cluster", "upper", "lower"])


def _reassigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(Round(centroids, before))
    k, dims = centroids.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            n = batch.num_rows
            v = _unpack(batch["v"], dims)
            if before is None:
                own, upper, lower = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros((n, k))
            else:
                own, upper = batch["cluster"].to_numpy().astype(np.int64), batch["upper"].to_numpy()
                lower = np.frombuffer(b"".join(batch["lower"].to_pylist()), dtype=np.float32).reshape(n, k)
            own, upper, lower, _ = assign(v, own, upper, lower, now)
            yield _state(batch, batch["v"], own, upper, lower)

    return stored(state.mapInArrow(step, _STATE), "clusters")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without vectors stay."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            own = batch["cluster"].to_numpy()
            n += np.bincount(own, minlength=k)
            np.add.at(total, own, _unpack(batch["v"], dims))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(sums, "cluster int, n long, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in each.collect():  # k * dimensions numbers
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector: cluster, squared distance, cluster_inertia, inertia, and the SHA-256 of its centroid's components."""
    spark = vectors.sparkSession
    x = F.col("x").cast("array<double>")
    # The cast to double and the test come first, so that later expressions meet whole vectors only.
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).select("vec_id", x.alias("x")).filter(
        (F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    cut = lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * F.lit(float(scale))))).cast("int")
    ints = whole.select("vec_id", F.transform("x", cut).alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(_pack(v), pa.binary())], names=["vec_id", "v"])

    kept = stored(ints.mapInArrow(packed, "vec_id long, v binary"), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids, before = _unpack(pa.array([bytes(r["v"]) for r in first], pa.binary()), dims), None
    state = kept
    for _ in range(rounds):
        state = _reassigned(state, centroids, before)
        centroids, before = _moved(state, centroids), centroids
    state = _reassigned(state, centroids, before)
    shared = spark.sparkContext.broadcast(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = ((_unpack(batch["v"], dims) - shared.value[batch["cluster"].to_numpy()]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array(d)], names=["vec_id", "cluster", "distance"])

    final = state.select("vec_id", "cluster", "v").mapInArrow(measure, "vec_id long, cluster int, distance long")
    own = {r["cluster"]: int(r["d"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # one row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return final.select(
        "vec_id",
        "cluster",
        "distance",
        of([min(_LONG, own.get(c, 0)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(min(_LONG, sum(own.values()))).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )
