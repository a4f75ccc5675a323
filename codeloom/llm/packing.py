"""Best-fit packing by minimum bin slack (operator 5).

Documents become token pieces of ``capacity`` tokens at most; only longer documents are cut.
Full pieces are sequences of their own.  The rest is packed on the histogram of piece lengths,
which has fewer than ``capacity`` entries whatever the corpus holds: the longest remaining
length opens a bin, bitset subset-sum dynamic programming over the available lengths finds the
fullest feasible filling, and the combination is taken out as often as the histogram allows.

Pieces then find their place by their rank among the pieces of their length.  A rank is a task's
own count plus the counts of the tasks before it, so no length, however common, meets in one
task.  The plan (bounded by the capacity) is broadcast.

Tokens come from a public tokenizer's file.  Its normaliser and pre-tokenizer never look across
a space or a line feed, so words are looked up in a bounded table and only new ones are
encoded.  A document's ids end with ``end_id``.

Defined results: a null or empty text has the end id alone; repeated rows are packed like any others;
a null identifier stays null; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

CAPACITY = 4096
END_ID = 1
#: Words remembered by a task; the table is emptied when full.
REMEMBERED_WORDS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Packing of a few ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


class WordIds(dict):
    """Word -> its token ids as little-endian 32-bit bytes; encodes what it does not know.

    Letters and the punctuation mark behind them are separate tokens, and Latin letters are lower-cased one by
    one, so a word ending in a mark or in capitals is put together from simpler words.
    """

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.encode = Tokenizer.from_file(tokenizer_file).encode
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
            self[""] = b""
        body = word[:-1]
        # Some letters become a letter and a combining mark, which would join the punctuation.
        if word[-1] in ".,;:!?" and body.isalpha() and (body.isascii() or unicodedata.normalize("NFC", body).lower().isalpha()):
            ids = self[body] + self[word[-1]]
        elif word.isalpha() and (word.isascii() or max(word) < "İ") and word != (lower := word.lower()):
            ids = self[lower]
        else:
            ids = _PACK[len(found)](*found) if len(found := self.encode(word, add_special_tokens=False).ids) < len(_PACK) else np.array(found, dtype="<u4").tobytes()
        self[word] = ids
        return ids


_tables: dict[str, WordIds] = {}


def _table_of(tokenizer_file: str) -> WordIds:
    if tokenizer_file not in _tables:
        _tables[tokenizer_file] = WordIds(tokenizer_file)
    return _tables[tokenizer_file]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank[, ids]) of every piece.

    ``rank`` counts the pieces of one length that the task ``task`` made before.
    """
    file = tokenizer_file or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64()), *([("ids", pa.binary())] if keep_ids else [])])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, task = _table_of(file), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for i, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py() or ""
                ids = b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    row = (i, piece, at // 4, n, zlib.crc32(own), task, seen[n], own)
                    seen[n] += 1
                    for c, v in zip(columns, row, strict=False):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * keep_ids)


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The fullest feasible combination [(length, copies)] of the available lengths in ``room``."""
    reach, steps, mask, goal = 1, [], (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left > 0 and not reach & goal:
            many = min(many, left)
            more = reach | (reach << (many * length)) & mask
            if more != reach:
                steps.append((length, many, reach))
                reach = more
            left -= many
            many *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + many
            at -= length * many
    return sorted(used.items(), reverse=True)


def minimum_slack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """[(first bin, bins, [(length, copies in each bin)])], every piece of the histogram in one bin."""
    counts, bins, plan = {k: v for k, v in histogram.items() if v > 0}, 0, []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        used = dict(fill(rest, capacity - longest))
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        plan.append((bins, times, sorted(used.items(), reverse=True)))
        bins += times
    return plan


def _places(plan: list[tuple[int, int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For every length and run of ranks: its bins and its offset in them, ordered by length and rank."""
    taken: dict[int, int] = {}
    rows = []
    for first, times, used in plan:
        offset = 0
        for length, copies in used:
            at = taken.get(length, 0)
            rows.append((length, at, first, copies, offset))
            taken[length] = at + copies * times
            offset += length * copies
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "copies", "offset"), columns, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored) with sequence_id and offset."""
    kept = [c for c in pieces.columns if c not in ("task", "rank")]
    full = pieces.filter(F.col("length") == capacity).select(*kept, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < capacity)
    by_task = short.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_task.select("length", "task", before.alias("before"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under ``capacity`` rows
    places = pieces.sparkSession.sparkContext.broadcast(_places(minimum_slack_plan(histogram, capacity)))
    ranked = short.join(offsets, ["length", "task"]).select(*kept, (F.col("rank") + F.col("before")).alias("rank"))
    types = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        # One number that orders by length, then rank.
        keys = p["length"].astype(np.float64) * 2.0**40 + p["rank"]
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length.astype(np.float64) * 2.0**40 + rank, side="right") - 1
            into = rank - p["rank"][at]
            sequence = p["bin"][at] + into // p["copies"][at]
            offset = p["offset"][at] + into % p["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return full.unionByName(ranked.mapInArrow(place, schema))


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its place: sequence_id and offset."""
    pieces = stored(token_pieces(docs, id_col, text_col, tokenizer_file, capacity, end_id, keep_ids), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence, from packed pieces that kept their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, x: F.concat(a, x))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("parts"))
