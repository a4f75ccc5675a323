"""Substring dedup with a count-min prefilter (operator 2).

Pass 1 hashes every window of ``WINDOW`` words of every whole text and adds it to count-min
sketches, one for each flush of a task.  Counters saturate at two, as all that matters is whether
a count may exceed one.  Sketches travel as sorted bucket numbers, cut into segments; segments
are merged one at a time and leave a bit per counter.  A merged count is never below the true one.

Pass 2 hashes the windows again and drops those whose estimate is one.  The others are grouped
exactly by a 96-bit hash of their word sequence.  Inside a flush, only the smallest
document of a window can still be judged wrongly, so all others are settled there and at most
one document for each flush and window enters the shuffle: a window that a third of all documents
share is no reducer's burden.

Removed positions are then joined with the texts, whose covered words go.

The sketch has about two counters a window and row, of one bit each when merged, up to ``MAX_WIDTH``
counters a row; that bounds what is broadcast.  Beyond it more windows pass for repeated, which
costs shuffle but loses none and changes no result.

Defined results: a null text has no words; a null identifier is larger than all others; repeated
rows (equal in identifier and text) give equal rows, and do not count against each other; a text of fewer than 13 words
stays whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .packed import pack as _pack, unpack as _unpack
from .words import SPACED, Words, mix, split_words

WINDOW = 13
DEPTH = 2
#: Counters of a sketch row at most; a merged row takes an eighth of that in bytes.
MAX_WIDTH = 1 << 28
SEGMENT = 1 << 22
#: Windows of a flush; bounds a task's memory at about 60 bytes each.
FLUSH = 500_000
#: Windows of an exact group's bucket, about; settling one takes about 100 bytes each.
BUCKET = 500_000
_ROW_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_LAST = np.iinfo(np.int64).max


def _buckets(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * np.uint64(_ROW_MULTIPLIERS[row])) >> np.uint64(64 - bits)).astype(np.uint32)


def _flushes(batches: Iterator[pa.RecordBatch], k: int, second: bool) -> Iterator[dict[str, np.ndarray]]:
    """Whole windows, FLUSH or so at a time: hash, second hash, document number, position; documents' ids."""
    held: list[tuple] = []
    ids: list[np.ndarray] = []
    prints: list[np.ndarray] = []
    windows = docs = 0

    def out() -> dict[str, np.ndarray]:
        h, h2, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        whole = {"h": h, "h2": h2, "doc": doc, "pos": pos, "ids": np.concatenate(ids), "prints": np.concatenate(prints)}
        # The pieces go before the flush is used.
        for pieces in (held, ids, prints):
            pieces.clear()
        return whole

    for batch in batches:
        own = batch["id"].fill_null(_LAST).to_numpy(zero_copy_only=False)
        print_ = batch["print"].to_numpy(zero_copy_only=False)
        for w in split_words(batch["text"], SPACED):
            at = np.flatnonzero(w.whole(k))
            row = w.row_of_word()[at]
            h = w.windows(k)[at]
            h2 = (w.windows(k, 1)[at] >> np.uint64(32)).astype(np.uint32) if second else np.zeros(0, dtype=np.uint32)
            held.append((h, h2, (row + docs).astype(np.int32), (at - w.first[row]).astype(np.int32)))
            ids.append(own[w.first_row : w.first_row + w.rows])
            prints.append(print_[w.first_row : w.first_row + w.rows])
            docs += w.rows
            windows += len(h)
            if windows >= FLUSH:
                windows = docs = 0
                yield out()
    if windows:
        yield out()


def _sketch(rows: DataFrame, bits: int, k: int, depth: int) -> DataFrame:
    """(segment, n, data): pieces of the sketches of all flushes."""
    size = min(SEGMENT, 1 << bits)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in _flushes(batches, k, second=False):
            out: tuple[list, list, list] = ([], [], [])
            for row in range(depth):
                b = np.sort(_buckets(flush["h"], row, bits))
                again = np.zeros(len(b), dtype=bool)
                again[2:] = b[2:] == b[:-2]
                b = b[~again]  # a counter stops at two
                cuts = np.searchsorted(b, np.arange(0, (1 << bits) + 1, size, dtype=np.uint64))
                for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if hi > lo:
                        piece = b[lo:hi] - np.uint32(s * size)
                        piece[1:] -= piece[:-1].copy()
                        for c, v in zip(out, (row * ((1 << bits) // size) + s, int(hi - lo), _pack(piece)), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["segment", "n", "data"])

    return rows.mapInArrow(sketch, "segment int, n int, data binary")


def _merge(pieces: DataFrame, size: int) -> DataFrame:
    """(segment, bits): which counters of a segment may exceed one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, once, more = None, np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for s, n, data in zip(*(batch[c].to_pylist() for c in ("segment", "n", "data")), strict=True):
                if s != segment:
                    if segment is not None:
                        yield done()
                    segment = s
                    once[:] = False
                    more[:] = False
                steps = _unpack(data, n, "<u4")
                at = np.cumsum(steps, dtype=np.int64)
                more[at[1:][steps[1:] == 0]] = True
                more[at[once[at]]] = True
                once[at] = True
        if segment is not None:
            yield done()

    return pieces.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")


def count_min_bits(rows: DataFrame, bits: int, k: int, depth: int) -> np.ndarray:
    """depth x 2**bits / 8 bytes: the merged sketch, a bit per counter.  Its size is bounded by ``MAX_WIDTH``."""
    size = min(SEGMENT, 1 << bits)
    out = np.zeros((depth, (1 << bits) // 8), dtype=np.uint8)
    per_row = (1 << bits) // size
    for r in _merge(_sketch(rows, bits, k, depth), size).toLocalIterator():
        row, s = divmod(r["segment"], per_row)
        out[row, s * size // 8 : (s + 1) * size // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _maybe_repeated(h: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    at = np.arange(len(h))
    for row in range(len(sketch)):
        b = _buckets(h[at], row, bits)
        at = at[(sketch[row][b >> np.uint32(3)] >> (b & np.uint32(7)).astype(np.uint8) & np.uint8(1)).astype(bool)]
    return at


_ROUTE = "bucket int, n int, m int, payload binary, dest int, removed binary"
_ROUTE_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), ("payload", pa.binary()), ("dest", pa.int32()), ("removed", pa.binary())])


def _packed_removals(ids: np.ndarray, prints: np.ndarray, pos: np.ndarray, dests: int) -> Iterator[tuple[int, int, bytes]]:
    """(dest, n, data): removed windows, packed by the part of the documents that they belong to.

    A few rows for each part instead of one for each document keep this linear in the tasks.  Parts go by identifier
    and text, so that the many documents of one identifier, or of none, are in many parts.
    """
    dest = (mix(ids.view(np.uint64) + mix(prints.astype(np.int64).view(np.uint64))) % np.uint64(dests)).astype(np.int32)
    order = np.lexsort((pos, prints, ids, dest))
    ids, prints, pos, dest = ids[order], prints[order], pos[order].astype("<i4"), dest[order]
    cuts = np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1], [True]])) if len(dest) else np.zeros(1, dtype=int)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        parts = [_pack(np.diff(ids[lo:hi], prepend=0)), _pack(prints[lo:hi].astype("<i4")), _pack(np.diff(pos[lo:hi], prepend=np.int32(0)))]
        yield int(dest[lo]), int(hi - lo), np.array([len(x) for x in parts], dtype="<i4").tobytes() + b"".join(parts)


def _open_removals(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(data[:12], dtype="<i4")
    ends = 12 + np.cumsum(sizes)
    ids, prints, pos = (_unpack(data[e - s : e], n, kind) for s, e, kind in zip(sizes, ends, ("<i8", "<i4", "<i4"), strict=True))
    return np.cumsum(ids), prints, np.cumsum(pos, dtype=np.int32)


def _candidates(rows: DataFrame, sketch: Broadcast, bits: int, k: int, buckets: int) -> DataFrame:
    """Windows that may be repeated, for their exact group; positions that are settled already."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _flushes(batches, k, second=True):
            at = _maybe_repeated(f["h"], sketch.value, bits)
            h, h2, doc, pos = (f[c][at] for c in ("h", "h2", "doc", "pos"))
            order = np.lexsort((f["ids"][doc], h2, h))
            h, h2, doc, pos = h[order], h2[order], doc[order], pos[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            own = f["ids"][doc]
            smallest = own == own[first]
            settled = ~smallest
            out = [{"bucket": d, "n": n, "m": 0, "payload": None, "dest": d, "removed": data} for d, n, data in _packed_removals(own[settled], f["prints"][doc[settled]], pos[settled], buckets)]
            h, h2, doc, pos = h[smallest], h2[smallest], doc[smallest], pos[smallest]
            bucket = (h >> np.uint64(40)).astype(np.int64) * buckets >> 24
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                lo, hi = cuts[b], cuts[b + 1]
                step = h[lo:hi].copy()
                step[1:] -= h[lo : hi - 1]
                used, local = np.unique(doc[lo:hi], return_inverse=True)
                parts = [_pack(step), _pack(h2[lo:hi]), _pack(local.astype("<i4")), _pack(pos[lo:hi]), _pack(f["ids"][used]), _pack(f["prints"][used].astype("<i4"))]
                head = np.array([len(p) for p in parts], dtype="<i4").tobytes()
                out.append({"bucket": int(b), "n": int(hi - lo), "m": len(used), "payload": head + b"".join(parts), "dest": None, "removed": None})
            for lo in range(0, len(out), 5000):
                yield pa.RecordBatch.from_pylist(out[lo : lo + 5000], schema=_ROUTE_ARROW)

    return rows.mapInArrow(route, _ROUTE)


def _open(payload: bytes, n: int, m: int) -> tuple[np.ndarray, ...]:
    sizes = np.frombuffer(payload[:24], dtype="<i4")
    ends = 24 + np.cumsum(sizes)
    part = [payload[e - s : e] for s, e in zip(sizes, ends, strict=True)]
    kinds = (("<u8", n), ("<u4", n), ("<i4", n), ("<i4", n), ("<i8", m), ("<i4", m))
    step, h2, local, pos, ids, prints = (_unpack(p, count, kind) for p, (kind, count) in zip(part, kinds, strict=True))
    return np.cumsum(step, dtype=np.uint64), h2, local, pos, ids, prints


def _exact_groups(routed: DataFrame, buckets: int) -> DataFrame:
    """(dest, n, removed): packed removed windows."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces = None, []
        held: list[tuple] = []
        waiting = 0
        schema = pa.schema([("dest", pa.int32()), ("n", pa.int32()), ("removed", pa.binary())])

        def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            many, docs = [], 0
            for payload, n, m in pieces:
                h, h2, local, pos, ids, prints = _open(payload, n, m)
                many.append((h, h2, local + docs, pos, ids, prints))
                docs += m
            h, h2, doc, pos, ids, prints = (np.concatenate(x) for x in zip(*many, strict=True))
            own = ids[doc]
            order = np.lexsort((own, h2, h))
            h, h2, doc, pos, own = h[order], h2[order], doc[order], pos[order], own[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            gone = own > own[first]
            return own[gone], prints[doc[gone]], pos[gone]

        def out() -> pa.RecordBatch:
            found = list(_packed_removals(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], schema=schema)

        for batch in batches:
            settled = batch.filter(batch["payload"].is_null())
            if settled.num_rows:
                yield settled.select(schema.names)
            for b, n, m, payload in zip(*(batch[c].to_pylist() for c in ("bucket", "n", "m", "payload")), strict=True):
                if payload is None:
                    continue
                if b != current and pieces:
                    held.append(settle())
                    waiting += len(held[-1][0])
                    pieces = []
                    if waiting >= FLUSH:
                        yield out()
                        waiting = 0
                current = b
                pieces.append((payload, n, m))
        if pieces:
            held.append(settle())
        yield out()

    return routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(group, "dest int, n int, removed binary")


def _by_document(removed: DataFrame) -> DataFrame:
    """(doc_id, print, positions): one row for each document that loses windows."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces = None, []

        def documents() -> pa.RecordBatch:
            ids, prints, pos = (np.concatenate(x) for x in zip(*(_open_removals(data, n) for data, n in pieces), strict=True))
            order = np.lexsort((pos, prints, ids))
            ids, prints, pos = ids[order], prints[order], pos[order]
            cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])]))
            offsets = (np.append(cuts, len(ids)) * 4).astype(np.int32)
            positions = pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pos.astype("<i4")).view(np.uint8))])
            return pa.RecordBatch.from_arrays([pa.array(ids[cuts]), pa.array(prints[cuts].astype(np.int32)), positions], names=["doc_id", "print", "positions"])

        for batch in batches:
            for dest, n, data in zip(*(batch[c].to_pylist() for c in ("dest", "n", "removed")), strict=True):
                if dest != current and pieces:
                    yield documents()
                    pieces = []
                current = dest
                pieces.append((data, n))
        if pieces:
            yield documents()

    return removed.repartition("dest").sortWithinPartitions("dest").mapInArrow(collect, "doc_id long, print int, positions binary")


def _kept(w: Words, removed: np.ndarray) -> Iterator[bytes]:
    """Each row's kept words joined by one space."""
    ends = np.zeros(w.rows, dtype=np.int64)
    words = w.counts
    full = words > 0
    ends[full] = w.end[w.first[1:][full] - 1]
    data, take = w.data.copy(), np.zeros(len(w.data) + 1, dtype=np.int8)
    start, end = w.start[~removed], w.end[~removed]
    np.add.at(take, start, 1)
    np.add.at(take, end, -1)
    inside = np.cumsum(take[:-1]).astype(bool)
    gaps = end[~np.isin(end, ends[full])]
    data[gaps] = 0x20
    inside[gaps] = True
    for r in range(w.rows):
        if not words[r]:
            yield b""
            continue
        a, b = w.start[w.first[r]], ends[r]
        text = data[a:b][inside[a:b]].tobytes()
        yield text[:-1] if text.endswith(b" ") else text


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, depth: int = DEPTH, max_width: int = MAX_WIDTH, with_text: bool = False) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 and, on request, kept_text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(F.col(text_col).cast("string")).alias("print"), F.col(text_col).cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = n_bytes // 6 + 1  # a word and its gap take about six bytes; this only sizes the sketch
    bits = min(max(16, (2 * windows - 1).bit_length()), max_width.bit_length() - 1)
    buckets = max(8, windows // BUCKET)
    sketch = spark.sparkContext.broadcast(count_min_bits(rows, bits, window, depth))
    routed = _candidates(rows, sketch, bits, window, buckets)
    removed = _by_document(_exact_groups(routed, buckets))
    removed = removed.select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print"), "positions")
    joined = rows.join(removed, (F.coalesce("id", F.lit(_LAST)) == F.col("gone_id")) & (F.col("print") == F.col("gone_print")), "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch["positions"].to_pylist()
            for w in split_words(batch["text"], SPACED):
                cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
                for r in range(w.rows):
                    if gone[w.first_row + r]:
                        at = np.unique(np.frombuffer(gone[w.first_row + r], dtype="<i4")).astype(np.int64) + w.first[r]
                        cover[at] += 1
                        cover[at + window] -= 1
                out = np.cumsum(cover)[:-1] > 0
                sums = np.concatenate([[0], np.cumsum(out)])
                texts = list(_kept(w, out))
                columns = [
                    batch["id"].slice(w.first_row, w.rows),
                    pa.array(w.counts.astype(np.int64)),
                    pa.array((sums[w.first[1:]] - sums[w.first[:-1]]).astype(np.int64)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                if with_text:
                    columns.append(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("id", "text", "positions").mapInArrow(clean, out)
