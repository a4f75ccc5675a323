"""Benchmark decontamination (operator 3) over a distributed positional inverted index.

The index does not depend on any benchmark.  Documents form segments of some hundred thousand words;
a segment keeps, sorted by term, the list of places of each of its terms, and where its documents begin.
A term that most documents use has one bounded list in every segment instead of one unbounded list.

A benchmark asks the stored index.  Its terms' frequencies are sums of list lengths.  Each window of 13
item words names its rarest term; that term's list, moved by the term's offset in the item, gives the
places where the item might stand.  These are intersected with the lists of the window's other terms, each moved by its
own offset, from the next rarest on, until none or the whole window is left: an exact phrase match.
Places around which at least ``near_share`` of the item's words within 12 words of the rarest term
occur in any order, found in the same lists, are proximity matches.

Benchmarks go in blocks of ``BLOCK_TOKENS`` words: equal items once, items over ``SPAN`` words in overlapping
spans.  A block is broadcast, its matches are stored, and nothing of it stays on the driver.  Every block reads
the index, never the texts again.

Defined results: null texts have no words; an item without words has no window and one of fewer
than 13 is one window; items with equal texts each count; null item ids are left out of
``items_sha256`` and ``n_items``; repeated rows give equal rows; an empty benchmark contaminates
nothing; other columns are ignored, whatever their names.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import few_parts, stored, union_all
from .packed import differences, pack, unpack
from .words import ALNUM, split_words

WINDOW = 13
REACH = WINDOW - 1
#: Words and documents of a segment, about; a document is never cut.
SEGMENT_TOKENS, SEGMENT_ROWS = 250_000, 20_000
#: Item words of a block, about.
BLOCK_TOKENS = 500_000
#: Windows of an item that are asked together; each span carries the words around it that they need.
SPAN = 20_000
#: Places that are examined at once; bounds a task's memory at about 200 bytes each.
PLACES = 100_000
NEAR_SHARE = 0.8
_NONE = 127

_INDEX = pa.schema([("segment", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_terms", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary()), ("n_places", pa.int32()), ("places", pa.binary()), ("starts", pa.binary())])
_INDEX_SQL = "segment long, ordinal int, doc_id long, n_words long, n_terms int, terms binary, counts binary, n_places int, places binary, starts binary"


# --- the index ---------------------------------------------------------------------------------------


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (id, text).

    Rows with ``terms`` are segments: sorted term hashes, the length of each term's list, the lists one after the
    other, and the first word of each document.  The others are documents, by segment and ordinal.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[pa.Array] = []
        tokens = rows = 0

        def segment() -> Iterator[pa.RecordBatch]:
            h, n, own = np.concatenate(hashes), np.concatenate(sizes), pa.concat_arrays(ids)
            for held in (hashes, sizes, ids):
                held.clear()
            name = part << 32 | made
            yield _table(segment=pa.array(np.full(len(n), name)), ordinal=pa.array(np.arange(len(n), dtype=np.int32)), doc_id=own, n_words=pa.array(n.astype(np.int64)))
            order = np.argsort(h, kind="stable")
            h = h[order]
            cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.append(cuts, len(h)))
            yield _table(
                segment=pa.array([name], pa.int64()),
                ordinal=pa.array([len(n)], pa.int32()),
                n_terms=pa.array([len(cuts)], pa.int32()),
                terms=pa.array([pack(differences(h[cuts]))], pa.binary()),
                counts=pa.array([pack(counts.astype("<u4"))], pa.binary()),
                n_places=pa.array([len(h)], pa.int32()),
                places=pa.array([pack(differences(order.astype("<u4")))], pa.binary()),
                starts=pa.array([pack(n.astype("<u4"))], pa.binary()),
            )

        for batch in batches:
            for w in split_words(batch["text"], ALNUM, lower=True):
                hashes.append(w.hash)
                sizes.append(w.counts)
                ids.append(batch["id"].slice(w.first_row, w.rows).cast(pa.int64()))
                tokens, rows = tokens + len(w.hash), rows + w.rows
                if tokens >= SEGMENT_TOKENS or rows >= SEGMENT_ROWS:
                    yield from segment()
                    tokens, rows, made = 0, 0, made + 1
        if rows:
            yield from segment()

    return stored(docs.select("id", "text").mapInArrow(build, _INDEX_SQL), "postings")


def _table(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _INDEX], schema=_INDEX)


def _segments(index: DataFrame, *columns: str) -> DataFrame:
    return index.filter("terms IS NOT NULL").select("segment", *columns)


def _terms(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch["n_terms"][i].as_py()
    return np.cumsum(unpack(batch["terms"][i].as_py(), n, "<u8"), dtype=np.uint64), unpack(batch["counts"][i].as_py(), n, "<u4").astype(np.int64)


def _rank(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted term among the sorted known ones, or -1."""
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return np.where(known[at] == wanted, at, -1) if len(known) else np.full(len(wanted), -1)


def term_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted term hashes stands in the texts: the lengths of its lists."""
    known = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                have, counts = _terms(batch, i)
                at = _rank(have, known.value)
                total[at >= 0] += counts[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = _segments(index, "n_terms", "terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms), dtype=np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    known.unpersist()
    return out


# --- the benchmark -------------------------------------------------------------------------------------


def _item_words(items: DataFrame) -> DataFrame:
    """(item, key, words) of every item that has words: its word hashes and their digest."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch["item"].to_pylist(), []
            for w in split_words(batch["text"], ALNUM, lower=True):
                for r in range(w.rows):
                    h = w.hash[w.first[r] : w.first[r + 1]]
                    if len(h):
                        out.append({"item": ids[w.first_row + r], "key": hashlib.blake2b(h.tobytes(), digest_size=16).digest(), "words": h.view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.string()), ("key", pa.binary()), ("words", pa.list_(pa.int64()))]))

    return items.mapInArrow(hashed, "item string, key binary, words array<bigint>")


def _spans(items: DataFrame) -> DataFrame:
    """(key, skip, windows, words): distinct items in spans of ``windows`` window starts after the first ``skip`` words."""
    n = F.size("words")
    starts = F.greatest(n - (WINDOW - 1), F.lit(1))
    each = items.dropDuplicates(["key"]).select("key", "words", starts.alias("starts"), F.explode(F.sequence(F.lit(0), starts - 1, F.lit(SPAN))).alias("lo"))
    base = F.greatest(F.col("lo") - REACH, F.lit(0))
    windows = F.least(F.col("starts") - F.col("lo"), F.lit(SPAN))
    return each.select("key", (F.col("lo") - base).alias("skip"), windows.alias("windows"), F.slice("words", base + 1, F.col("lo") - base + windows + 2 * REACH).alias("words"))


class _Plan:
    """A block of spans, their words one after the other, ready to be broadcast.

    A place is a number of a word in the block.  ``order`` has, for each window, its offsets from the rarest term on.
    Windows that share their rarest place are neighbours; ``second`` is the rarest other place that all of them
    hold, -1 for none.  ``around`` has the offsets near a rarest place, from the rarest term on.
    """

    def __init__(self, spans: list, terms: np.ndarray, frequency: np.ndarray, near_share: float) -> None:
        self.terms, self.keys = terms, [bytes(s["key"]) for s in spans]
        words, window, need, order, of = [], [], [], [], []
        pivot, first, last, second, around, allowed = [], [], [], [], [], []
        at = count = 0
        for n, s in enumerate(spans):
            term = np.searchsorted(terms, np.array(s["words"], dtype=np.int64).view(np.uint64))
            rare, k = frequency[term], min(WINDOW, len(term))
            starts = s["skip"] + np.arange(s["windows"])
            views = np.lib.stride_tricks.sliding_window_view(rare, k)[starts]
            sorted_ = np.full((len(starts), WINDOW), _NONE, dtype=np.int8)
            sorted_[:, :k] = np.argsort(views, axis=1, kind="stable")
            rarest = starts + sorted_[:, 0]
            cuts = np.flatnonzero(np.concatenate([[True], rarest[1:] != rarest[:-1]]))
            ends = np.append(cuts[1:], len(starts)) - 1
            for lo, hi in zip(cuts, ends, strict=True):
                place = rarest[lo]
                common = np.arange(starts[hi], starts[lo] + k)
                common = common[common != place]
                second.append(at + common[rare[common].argmin()] if len(common) else -1)
                near = np.arange(max(0, place - REACH), min(len(term), place + REACH + 1))
                total = len(near)
                near = near[near != place]
                near = near[np.argsort(rare[near], kind="stable")] - place
                around.append(np.append(near, np.full(2 * REACH - len(near), _NONE)).astype(np.int8))
                allowed.append(total - int(np.ceil(near_share * total)) if k == WINDOW else -1)
            words.append(term.astype(np.int32))
            window.append(at + starts)
            need.append(np.full(len(starts), k, dtype=np.int32))
            order.append(sorted_)
            of.append(np.full(len(starts), n, dtype=np.int32))
            pivot.append(at + rarest[cuts])
            first.append(count + cuts)
            last.append(count + ends)
            at, count = at + len(term), count + len(starts)
        self.words, self.window, self.need, self.order, self.span = (np.concatenate(x) for x in (words, window, need, order, of))
        self.pivot, self.first, self.last = (np.concatenate(x) for x in (pivot, first, last))
        self.second, self.around, self.allowed = np.array(second), np.array(around), np.array(allowed)


# --- asking ----------------------------------------------------------------------------------------------


class _Segment:
    """The decoded lists of one segment."""

    def __init__(self, plan: _Plan, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> None:
        self.plan, self.counts = plan, counts
        self.begin = np.cumsum(counts) - counts
        self.places = places
        # All lists as one sorted one: the term's number above, the place below.
        self.listed = np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32 | places
        self.rank = _rank(terms, plan.terms)
        self.rows = np.concatenate([[0], np.cumsum(sizes)])

    def row(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, place, side="right") - 1

    def has(self, word: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        """Whether the lists of the plan's words hold a place from ``low`` to ``high``, or ``low`` itself."""
        rank = self.rank[self.plan.words[word]]
        key = (rank << 32) + np.maximum(low, 0)
        at = np.searchsorted(self.listed, key)
        at[at == len(self.listed)] = len(self.listed) - 1
        up = key if high is None else (rank << 32) + high
        return (rank >= 0) & ((low >= 0) | (high is not None)) & (self.listed[at] >= key) & (self.listed[at] <= up)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rarest place of the plan, place in the segment) pairs, ``PLACES`` or so at a time."""
        rank = self.rank[self.plan.words[self.plan.pivot]]
        some = np.flatnonzero(rank >= 0)
        sizes = self.counts[rank[some]]
        lo = 0
        sums = np.cumsum(sizes)
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + PLACES, side="right")))
            n = sizes[lo:hi]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(some[lo:hi], n)
            place = self.places[self.begin[rank[which]] + inner].astype(np.int64)
            for part in range(0, len(which), PLACES):
                yield which[part : part + PLACES], place[part : part + PLACES]
            lo = hi

    def exact(self, which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, shift) of all windows found at these places; a word of the plan stands at its number plus shift."""
        p = self.plan
        shift = place - p.pivot[which]
        other = p.second[which]
        on = (other < 0) | self.has(np.maximum(other, 0), shift + other)
        which, shift = which[on], shift[on]
        many = p.last[which] - p.first[which] + 1
        window = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(p.first[which], many)
        shift = np.repeat(shift, many)
        for step in range(1, WINDOW):
            offset = p.order[window, step].astype(np.int64)
            word = p.window[window] + np.where(offset == _NONE, 0, offset)
            on = (offset == _NONE) | self.has(word, word + shift)
            window, shift = window[on], shift[on]
        start = p.window[window] + shift
        inside = start >= 0
        row = self.row(np.maximum(start, 0))
        inside &= start + p.need[window] <= self.rows[np.minimum(row + 1, len(self.rows) - 1)]
        return window[inside], shift[inside]

    def near(self, which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (rarest place, place) pairs around which enough of the item's words stand, in any order."""
        p = self.plan
        on = p.allowed[which] >= 0
        which, place = which[on], place[on]
        row = self.row(place)
        low, high = np.maximum(place - REACH, self.rows[row]), np.minimum(place + REACH, self.rows[row + 1] - 1)
        missing = np.zeros(len(which), dtype=np.int64)
        for step in range(2 * REACH):
            offset = p.around[which, step].astype(np.int64)
            word = p.pivot[which] + np.where(offset == _NONE, 0, offset)
            missing += (offset != _NONE) & ~self.has(word, low, high)
            on = missing <= p.allowed[which]
            which, place, low, high, missing = which[on], place[on], low[on], high[on], missing[on]
        return which, place


_MATCH = pa.schema([("segment", pa.int64()), ("ordinal", pa.int32()), ("key", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])


def _matches(index: DataFrame, plan: _Plan) -> DataFrame:
    """(segment, ordinal, key, first, last): ranges of exact matches; first and last are null for proximity matches."""
    shared = index.sparkSession.sparkContext.broadcast(plan)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places = np.cumsum(unpack(batch["places"][i].as_py(), batch["n_places"][i].as_py(), "<u4"), dtype=np.uint32)
                if not len(places):
                    continue
                sizes = unpack(batch["starts"][i].as_py(), batch["ordinal"][i].as_py(), "<u4").astype(np.int64)
                s = _Segment(shared.value, *_terms(batch, i), places, sizes)
                for which, place in s.candidates():
                    yield _found(s, batch["segment"][i].as_py(), which, place)

    found = stored(few_parts(_segments(index, "ordinal", "n_terms", "terms", "counts", "n_places", "places", "starts").mapInArrow(ask, "segment long, ordinal int, key binary, first int, last int")), "matches")
    shared.unpersist()
    return found


def _found(s: _Segment, name: int, which: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    p = s.plan
    window, shift = s.exact(which, place)
    # Windows of one span at one shift that overlap or touch are one range.
    order = np.lexsort((window, shift, p.span[window]))
    window, shift = window[order], shift[order]
    span, start = p.span[window], p.window[window] + shift
    apart = np.ones(len(window), dtype=bool)
    apart[1:] = (span[1:] != span[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > start[:-1] + p.need[window[:-1]]) | (s.row(start[1:]) != s.row(start[:-1]))
    cuts = np.flatnonzero(apart)
    ends = np.append(cuts[1:], len(window)) - 1 if len(cuts) else cuts
    near, at = s.near(which, place)
    near_span = p.span[p.first[near]]
    # Once for each span and document.
    once = np.unique(np.stack([near_span.astype(np.int64), s.row(at)]), axis=1) if len(near) else np.zeros((2, 0), dtype=np.int64)
    row = s.row(start[cuts])
    begin = start[cuts] - s.rows[row]
    end = start[ends] + p.need[window[ends]] - 1 - s.rows[row] if len(cuts) else begin
    n, m = len(cuts), once.shape[1]
    null = np.arange(n + m) >= n
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + m, name)),
            pa.array(np.concatenate([row, once[1]]).astype(np.int32)),
            pa.array([p.keys[k] for k in (*span[cuts], *once[0])], pa.binary()),
            pa.array(np.concatenate([begin, np.zeros(m, dtype=np.int64)]).astype(np.int32), mask=null),
            pa.array(np.concatenate([end, np.zeros(m, dtype=np.int64)]).astype(np.int32), mask=null),
        ],
        schema=_MATCH,
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", near_share: float = NEAR_SHARE) -> DataFrame:
    """One row per document: its words, those hit by item windows, the items, and the verdict."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ask_index(build_index(texts), benchmark, item_col, item_text_col, near_share)


def ask_index(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", near_share: float = NEAR_SHARE) -> DataFrame:
    """As :func:`decontaminate`, of a stored index, which may be asked any number of benchmarks."""
    items = stored(_item_words(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))), "items")
    spans = _spans(items)
    total = spans.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // BLOCK_TOKENS)
    matched = []
    for b in range(blocks):
        block = spans.filter(F.pmod(F.xxhash64("key", "skip", "windows", "words"), F.lit(blocks)) == b).collect()
        if block:
            terms = np.unique(np.concatenate([np.array(s["words"], dtype=np.int64) for s in block]).view(np.uint64))
            matched.append(_matches(index, _Plan(block, terms, term_frequencies(index, terms), near_share)))
    none = items.select(F.lit(0).cast("long").alias("segment"), F.lit(0).alias("ordinal"), "key", F.lit(0).alias("first"), F.lit(0).alias("last")).limit(0)
    named = union_all(matched or [none]).join(items.select(F.col("key").alias("k"), "item"), F.col("key") == F.col("k"))
    return _verdict(index.filter("terms IS NULL").select("segment", "ordinal", "doc_id", "n_words"), named)


def _verdict(base: DataFrame, matched: DataFrame) -> DataFrame:
    ranges = F.array_sort(F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "last"))))
    exact = F.array_sort(F.collect_set(F.when(F.col("first").isNotNull(), F.col("item"))))
    near = F.collect_set(F.when(F.col("first").isNull(), F.col("item")))
    found = matched.groupBy(F.col("segment").alias("of"), F.col("ordinal").alias("nth")).agg(ranges.alias("ranges"), exact.alias("items"), near.alias("near"))
    start = F.struct(F.lit(-1).alias("to"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "ranges",
        start,
        lambda a, r: F.struct(F.greatest(a["to"], r["last"]).alias("to"), (a["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(a["to"] + 1, r["first"]) + 1)).cast("long").alias("n")),
        lambda a: a["n"],
    )
    found = found.select("of", "nth", covered.alias("hit"), "items", F.size(F.array_except("near", "items")).cast("long").alias("n_near"))
    joined = base.join(found, (F.col("segment") == F.col("of")) & (F.col("ordinal") == F.col("nth")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    names = F.coalesce("items", F.expr("CAST(array() AS array<string>)"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the benchmark contaminates; columns stay as they are, whatever their names."""
    bad = decontaminate(docs, benchmark, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"))
    return packed.join(bad, F.col("own").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")


def digest_of_items(items: list[str]) -> str:
    """The digest of a list of item ids; for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
