"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 8).

Grades are ordered: 0 toxic, 1 junk, 2 good.  One weight vector over hashed text features is
shared by all grades, and ordered thresholds t_0 < t_1 cut the score:
P(grade <= k) = logistic(t_k - w.x).  Scoring gives the expected grade and the tail probability
P(grade >= 2); documents are selected by the tail probability.

Features are presences: a document's distinct lower-cased words, the 5-byte beginnings of its words,
and marks of its style (shares of capitals, exclamation marks, separators, other symbols, repeated and distinct words), each
hashed to one of 2**20 buckets.  Words say what a text is about, beginnings carry over to
inflections, and marks catch repetition and shouting.

Training takes at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their
identifier; this bound is the parameter ``train_rows``.  Its features are computed and kept by Spark, features are chosen
by one count per bucket and grade, and every step of the fit is a Spark job that sums gradients
over partitions; the driver only holds the weights (``MAX_FEATURES`` at most).  Scoring reads every whole text.

Defined results: a null text is an empty text; labels without a document, or with a null grade, are left out;
several labels of a document count as their mean grade, rounded down; without labels, with one
grade only or without a telling feature, every document has the prior's scores and is selected; repeated rows give equal rows; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .words import ALNUM, SPACED, mix, split_words, string_buffers

GRADES = 3
TRAIN_ROWS = 20_000
BUCKET_BITS = 20
#: Features kept: the most telling by their chi-square against the grades, at most so many, and
#: only those of so many rows and such a chi-square that chance among 2**20 buckets doesn't explain them.
MAX_FEATURES = 5_000
MIN_ROWS = 6
MIN_CHI = 40.0
STEPS = 100
PARTS = 8
RIDGE = 1e-3
#: 0: each labelled document weighs alike; 1: each grade does.
BALANCE = 0.5
#: Documents are selected from this tail probability on.
SELECT_AT = 0.5
_PREFIX = 5
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*@^~=<>{}[]\\"))


def grade(quality: Column, toxic: Column) -> Column:
    """Ordered rating of a labelled document."""
    return F.when(toxic == 1, F.lit(0)).when(quality == 0, F.lit(1)).when(quality == 1, F.lit(2))


def _bins(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, bucket of each feature), each pair once."""
    shift = np.uint64(64 - BUCKET_BITS)
    for w in split_words(column, ALNUM, lower=True):
        row = w.row_of_word()
        # The beginning of a word: its first bytes as one number.
        begin = np.zeros(len(w.hash), dtype=np.uint64)
        for i in range(_PREFIX):
            at = w.start + i
            inside = at < w.end
            begin[inside] |= w.data[at[inside]].astype(np.uint64) << np.uint64(8 * i)
        long_ = w.end - w.start >= _PREFIX
        words = mix(w.hash + np.uint64(1)) >> shift
        begins = mix(begin[long_] + np.uint64(0x5151515151515151)) >> shift
        rows, buckets = np.concatenate([row, row[long_]]), np.concatenate([words, begins])
        key = np.unique(rows.astype(np.uint64) << np.uint64(BUCKET_BITS) | buckets)
        rows, buckets = (key >> np.uint64(BUCKET_BITS)).astype(np.int64), (key & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)
        marks_row, marks = _marks(column, w.first_row, w.rows)
        yield w.first_row, w.rows, np.concatenate([rows, marks_row]), np.concatenate([buckets, marks])


def _marks(column: pa.Array, first: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Style marks of some rows."""
    out_row, out = [], []
    seen = 0
    for w in split_words(column.slice(first, rows), SPACED):
        off, _ = string_buffers(column.slice(first + w.first_row, w.rows))
        off = off - off[0]
        # Differences of a running sum, as a row may be empty.
        count = lambda mask, off=off: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
        d = w.data
        n_words = w.counts
        upper = count((d >= 65) & (d <= 90))
        lower = count((d >= 97) & (d <= 122))
        bang = count(d == 33)
        bar = count(d == 124)
        symbol = count(_SYMBOL[d])
        twice = np.zeros(len(w.hash), dtype=np.int64)
        twice[1:] = w.hash[1:] == w.hash[:-1]
        again = np.concatenate([[0], np.cumsum(twice)])
        again = again[w.first[1:]] - again[w.first[:-1]]
        new = np.unique(w.row_of_word().astype(np.uint64) << np.uint64(40) | w.hash >> np.uint64(24))
        distinct = np.bincount((new >> np.uint64(40)).astype(np.int64), minlength=w.rows)[: w.rows]
        safe = np.maximum(n_words, 1)
        kinds = [
            _bins(upper / np.maximum(1, upper + lower), [0.02, 0.1, 0.3, 0.6]),
            _bins(bang / safe, [0.01, 0.1, 0.5]),
            _bins(bar / safe, [0.01, 0.05, 0.2, 0.4]),
            _bins(symbol / safe, [0.02, 0.1, 0.3, 1]),
            _bins(again / safe, [0.03, 0.1, 0.3]),
            _bins(distinct / safe, [0.05, 0.1, 0.2, 0.4, 0.7]),
            _bins(n_words, [1, 10, 50, 200, 1000]),
        ]
        for k, values in enumerate(kinds):
            out_row.append(np.arange(w.rows) + seen)
            out.append((mix((values + 64 * (k + 1)).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        seen += w.rows
    return np.concatenate(out_row), np.concatenate(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _ordered(t: np.ndarray) -> np.ndarray:
    """The nearest ascending thresholds: neighbours out of order take their mean."""
    pools: list[list[float]] = []
    for x in t:
        pools.append([x, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, n = pools.pop()
            a, m = pools.pop()
            pools.append([(a * m + b * n) / (m + n), m + n])
    return np.array([x for x, n in pools for _ in range(int(n))])


class Model:
    """Weights of the chosen buckets and ordered thresholds; small enough to broadcast."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.buckets, self.weights, self.thresholds = buckets, weights, thresholds

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS)
        out[self.buckets] = self.weights
        return out

    def selects(self, tail: np.ndarray, select_at: float) -> np.ndarray:
        """What a tail probability selects; a model that has learnt nothing rejects nothing."""
        return tail >= select_at if len(self.buckets) else np.ones(len(tail), dtype=bool)

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of the highest grade."""
        above = 1 - _sigmoid(self.thresholds[None, :] - score[:, None])
        return above.sum(axis=1), above[:, -1]


def gradient(g: np.ndarray, cuts: np.ndarray, x: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the sum of -log P(grade), each grade weighing its ``size``, by the weights and then the thresholds; row r has features x[cuts[r]:cuts[r+1]]."""
    d, total = len(weights), np.zeros(len(weights) + len(thresholds))
    row = np.repeat(np.arange(len(g)), np.diff(cuts))
    score = np.bincount(row, weights=weights[x], minlength=len(g))
    below = np.hstack([np.zeros((len(g), 1)), _sigmoid(thresholds[None, :] - score[:, None]), np.ones((len(g), 1))])
    hi, lo = below[np.arange(len(g)), g + 1], below[np.arange(len(g)), g]
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi), lo * (1 - lo)
    # d(-log p)/d(score) and d(-log p)/d(threshold)
    total[:d] = np.bincount(x, weights=((dhi - dlo) / p * size[g])[row], minlength=d)[:d]
    for k in range(len(thresholds)):
        total[d + k] = (size[g] * (np.where(g == k, -dhi, 0) + np.where(g == k + 1, dlo, 0)) / p).sum()
    return total


def _training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(grade, part, buckets): the features of the labelled sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("l"), grade(F.col("quality"), F.col("toxic")).alias("g")).filter("l IS NOT NULL AND g IS NOT NULL").groupBy("l").agg(F.floor(F.avg("g")).cast("int").alias("g"))
    sample = known.orderBy(F.xxhash64("l"), "l").limit(train_rows)
    rows = docs.join(F.broadcast(sample), F.col("id") == F.col("l")).select("g", "text").dropDuplicates()  # train_rows rows at most; copies would pass for evidence

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int32()), ("buckets", pa.list_(pa.int32()))])
        for batch in batches:
            for first, n, row, bucket in features(batch["text"]):
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["g"].slice(first, n), pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket[order].astype(np.int32)))], schema=schema)

    return stored(rows.mapInArrow(read, "g int, buckets array<int>"), "train")


def _choose(train: DataFrame, totals: np.ndarray) -> np.ndarray:
    """The buckets that tell most about the grade."""
    counts = train.select("g", F.explode("buckets").alias("b")).groupBy("b").agg(*[F.count(F.when(F.col("g") == k, 1)).alias(f"n{k}") for k in range(GRADES)])
    seen = sum((F.col(f"n{k}") for k in range(1, GRADES)), F.col("n0"))
    n = float(totals.sum())
    chi = F.lit(0.0)
    for k in range(GRADES):
        expected = seen * F.lit(float(totals[k]) / n)
        if totals[k]:
            chi = chi + (F.col(f"n{k}") - expected) ** 2 / expected
    top = counts.filter(seen >= MIN_ROWS).withColumn("chi", chi).filter(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "b").limit(MAX_FEATURES).select("b")
    return np.sort(np.array([r["b"] for r in top.collect()], dtype=np.int64))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model of a labelled sample.  ``docs`` has id and text."""
    spark = docs.sparkSession
    train = _training_rows(docs, labels, train_rows)
    totals = np.zeros(GRADES)
    for r in train.groupBy("g").count().collect():
        totals[r["g"]] = r["count"]
    n = totals.sum()
    prior = np.cumsum((totals + 1) / (n + GRADES))[:-1]
    thresholds = np.log(prior / (1 - prior))
    if (totals > 0).sum() < 2:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), thresholds)
    chosen = _choose(train, totals)
    if not len(chosen):
        return Model(chosen, np.zeros(0), thresholds)
    place = spark.sparkContext.broadcast(chosen)
    d = len(chosen)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch["buckets"].offsets.to_numpy()
            b = batch["buckets"].flatten().to_numpy()
            at = np.searchsorted(place.value, b)
            at[at == d] = 0
            hit = place.value[at] == b
            own = np.concatenate([[0], np.cumsum(hit)])[cuts - cuts[0]]
            yield pa.RecordBatch.from_arrays([batch["g"], pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(at[hit].astype(np.int32)))], names=["g", "x"])

    # A few parts: the sample is bounded, and each step collects one gradient of d + 2 numbers from each.
    kept = stored(train.mapInArrow(narrow, "g int, x array<int>").coalesce(PARTS), "design")
    weights = np.zeros(d)
    # Adagrad on the full-sample gradient; rare grades weigh more than their number, so that they count.
    balance = np.where(totals > 0, (n / (GRADES * np.maximum(totals, 1))) ** BALANCE, 0)
    state = np.zeros(d + GRADES - 1)
    for _ in range(STEPS):
        now = spark.sparkContext.broadcast((weights, thresholds, balance))

        def summed(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            w, t, of_grade = now.value
            total = np.zeros(d + GRADES - 1)
            for batch in batches:
                g = batch["g"].to_numpy()
                cuts = batch["x"].offsets.to_numpy()
                x = batch["x"].flatten().to_numpy()
                total += gradient(g, cuts, x, w, t, of_grade)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        step = sum((np.frombuffer(r["sums"]) for r in kept.mapInArrow(summed, "sums binary").collect()), np.zeros(d + GRADES - 1)) / n
        step[:d] += RIDGE * weights
        state += step**2
        move = 0.5 * step / np.sqrt(state + 1e-12)
        weights = weights - move[:d]
        thresholds = _ordered(thresholds - move[d:])
        now.unpersist()
    return Model(chosen, weights, thresholds)


def score(docs: DataFrame, model: Model, select_at: float = SELECT_AT) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) of every whole text.  ``docs`` has id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("selected", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights = own.dense()
        for batch in batches:
            for first, n, row, bucket in features(batch["text"]):
                expected, tail = own.grades(np.bincount(row, weights=weights[bucket], minlength=n))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(first, n), pa.array(expected), pa.array(tail), pa.array(own.selects(tail, select_at))], schema=schema)

    return docs.mapInArrow(read, "doc_id long, expected_grade double, tail_probability double, selected boolean")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, select_at: float = SELECT_AT) -> DataFrame:
    """Fit on the labelled sample, score every document."""
    texts = _texts(docs, id_col, text_col)
    return score(texts, fit(texts, labels, train_rows), select_at)


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, select_at: float = SELECT_AT) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; rows are scored where they stand, without a shuffle."""
    model = fit(_texts(docs, id_col, text_col), labels, train_rows)
    if not len(model.buckets):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights = own.dense()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for first, n, row, bucket in features(text):
                keep[first : first + n] = own.grades(np.bincount(row, weights=weights[bucket], minlength=n))[1] >= select_at
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(choose, docs.schema)
