"""Line dedup by a segment-partition edit join (operator 1).

Two lines match when their edit distance is ``TAU`` at most.  A line is cut into TAU + 1 even
segments; if two lines match, one of the shorter line's segments stands unchanged in the longer
one, at a place that its number, the lengths and TAU bound.  So every line posts its segments
(keyed by length, number and content) and probes the substrings that these bounds allow, for
each length from its own down to TAU less.  Candidates are verified with a banded bit-parallel
edit distance over full lines.

A key that many lines share is not expanded into pairs.  Its lines meet in blocks, where character
counts sort out most pairs and the others are verified on the spot; at most one earlier match
for each line and block leaves it.  A key that is already crowded among the lines of one chunk is
marked there, and its lines are dealt to tasks by line instead of by key; any other key is given
up for crowded as soon as a task has read ``CROWD`` lines of it, so no task holds a whole key.

The texts are read once: their lines are stored with a 128-bit digest, their place and, once for
each task or so, their content; all that follows reads that table.

A line is removed when an equal or matching line stands earlier in the table, by identifier and
line number; lines are judged on the input, not on what is left.

Defined results: lines are what line feeds separate; blank lines are not counted and always stay;
lines under ``MIN_CHARS`` code points match equal lines only; a null text has no lines; a
null identifier comes after all others; rows that share an identifier are one document whose lines are
counted together, and repeated rows' lines stand at the same places and do not
remove each other; an empty table gives an empty result; other columns are ignored, whatever
their names.  Lines are told apart by 128-bit digests, and near matches are verified on full texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, few_parts, shared_dir, stored
from .words import mix, powers

TAU = 2
MIN_CHARS = 20
#: A key gives pairs up to so many for each of its lines.
PAIRS_PER_LINE = 16
#: Lines of a block.
BLOCK = 512
_CHARS = 1 << 19
_MULTIPLIER = 0x9FB21C651E98DF25
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LAST = np.iinfo(np.int64).max


def _point_table() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))


_points: list[np.ndarray] = []
#: Lowest bits of a tagged line: it probes; it is dealt by line, as its chunk is crowded at the key.
_PROBES, _DEALT = np.int64(1), np.int64(2)
_ROLES = _PROBES | _DEALT
#: Says, among the lines of a key, that some are dealt by line; sorts before all of them.
_MARK = np.iinfo(np.int64).min | _ROLES
#: Entries of a key in one chunk from which they are dealt by line.
CROWDED_CHUNK = 256
#: Entries of a key that a task holds at most.
CROWD = 50_000
#: Digests that a task remembers, to give a line's content once.
_SEEN = 200_000
#: Groups of at least this share of all lines are joined by broadcast; there are so many at most.
_HOT_SHARE = 2000


class Text:
    """Code points of some texts with prefix hashes, so that any substring hashes in one step."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        n = len(self.points)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        if not _points:
            _points.append(_point_table())
        np.cumsum(_points[0][self.points] * powers(_MULTIPLIER, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + mix(np.asarray(salt, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - start).astype(np.uint64)))


def _segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i (from 0) of lines of a length; the last ones are the longer."""
    size, longer = length // (tau + 1), length % (tau + 1)
    short = tau + 1 - longer
    return i * size + np.maximum(0, i - short), size + (i >= short)


def _probes(t: Text, start: np.ndarray, end: np.ndarray, salt: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which line, key, place, size) of all substrings to look up."""
    length = end - start
    for less in range(tau + 1):
        target = length - less
        for i in range(tau + 1):
            p, size = _segment(target, i, tau)
            for shift in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1):
                at = p + shift
                ok = np.flatnonzero((at >= 0) & (at + size <= length) & (target >= 0))
                a = start[ok] + at[ok]
                yield ok, t.hash(a, a + size[ok], _salted(salt[ok], target[ok], i)), at[ok], size[ok]


def _salted(salt: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return salt + length.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64((i + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)


def _postings(t: Text, start: np.ndarray, end: np.ndarray, salt: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    length = end - start
    which = np.arange(len(start))
    for i in range(tau + 1):
        p, size = _segment(length, i, tau)
        yield which, t.hash(start + p, start + p + size, _salted(salt, length, i)), p, size


def _lines(docs: DataFrame) -> DataFrame:
    """(id, id2, doc, line, text) of every line that is not blank.

    id and id2 are its digest, with the bits of roles clear in id; text is null where the task has
    given the line's content already.
    """
    schema = pa.schema([("id", pa.int64()), ("id2", pa.int64()), ("doc", pa.int64()), ("line", pa.int64()), ("text", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        digests, docs_, numbers, contents, held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            ids = both[:, 0] & ~_ROLES
            ids[ids == np.iinfo(np.int64).min] = 0
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(docs_, pa.int64()), pa.array(numbers, pa.int64()), pa.array(contents, pa.binary())], schema=schema)

        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                for number, line in enumerate(data.split(b"\n")):
                    if not line or line.isspace():
                        continue
                    digest = hashlib.blake2b(line, digest_size=16).digest()
                    digests.append(digest)
                    docs_.append(_LAST if doc is None else doc)
                    numbers.append(number)
                    if digest in seen:
                        contents.append(None)
                    else:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(digest)
                        contents.append(line)
                        held += len(line)
                if held >= _CHARS or len(digests) >= 20_000:
                    yield out()
                    digests, docs_, numbers, contents, held = [], [], [], [], 0
        if digests:
            yield out()

    return docs.mapInArrow(read, "id long, id2 long, doc long, line long, text binary")


def _line_keys(lines: DataFrame, tau: int, min_chars: int) -> DataFrame:
    """(key, tagged): postings and probes of the lines that have their content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch["id"].to_numpy(zero_copy_only=False), batch["text"].cast(pa.string())
            off = np.concatenate([[0], np.cumsum(np.array([len(x) for x in data.to_pylist()], dtype=np.int64))])
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _CHARS, side="right")) - 1)
                yield from keys(ids[lo:hi], data.slice(lo, hi - lo).to_pylist())
                lo = hi

    def keys(ids: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
        t = Text(texts)
        long_ = np.flatnonzero(t.sizes >= min_chars)
        ids, one = np.unique(ids[long_], return_index=True)
        start, end = t.starts[long_[one]], t.starts[long_[one]] + t.sizes[long_[one]]
        salt = np.zeros(len(ids), dtype=np.uint64)
        found = [(key.view(np.int64), ids[which] | role) for role, made in ((np.int64(0), _postings(t, start, end, salt, tau)), (_PROBES, _probes(t, start, end, salt, tau))) for which, key, _, _ in made]
        key, tagged = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(key) >= CROWDED_CHUNK:
            order = np.argsort(key, kind="stable")
            key, tagged = key[order], tagged[order]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            sizes = np.diff(cuts)
            crowded = sizes >= CROWDED_CHUNK
            if crowded.any():
                tagged = tagged | np.where(np.repeat(crowded, sizes), _DEALT, np.int64(0))
                key, tagged = np.concatenate([key, key[cuts[:-1][crowded]]]), np.concatenate([tagged, np.full(crowded.sum(), _MARK)])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tagged)], names=["key", "tagged"])

    return lines.filter("text IS NOT NULL").select("id", "text").mapInArrow(read, "key long, tagged long")


def _matched(keys: DataFrame, per_line: int) -> DataFrame:
    """(kind, a, b): kind 0 pair of lines; kind 1 tagged line b of key a, which too many lines share."""
    none = np.zeros(0, dtype=np.int64)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []  # tagged lines of the key that may go on
        rest_key, held, given_up = None, 0, False

        def emit(key: np.ndarray, tagged: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (tagged[1:] != tagged[:-1])])
            key, tagged = key[new], tagged[new]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            crowds, a, b = ([none], [none]), [none], [none]
            ids = tagged & ~_ROLES
            low, high = np.minimum.reduceat(ids, cuts[:-1]), np.maximum.reduceat(ids, cuts[:-1])
            for g in np.flatnonzero(low != high):
                lo, hi = cuts[g], cuts[g + 1]
                marked = tagged[lo] == _MARK
                lo += marked
                probe = (tagged[lo:hi] & _PROBES).astype(bool)
                posted, looked = ids[lo:hi][~probe], ids[lo:hi][probe]
                n = len(posted) * len(looked)
                if marked or n > per_line * (len(posted) + len(looked)):
                    crowds[0].append(key[lo:hi])
                    crowds[1].append(tagged[lo:hi])
                elif n:
                    x, y = np.repeat(posted, len(looked)), np.tile(looked, len(posted))
                    x, y = x[x != y], y[x != y]
                    a.append(np.minimum(x, y))
                    b.append(np.maximum(x, y))
            x, y = np.concatenate(a), np.concatenate(b)
            return out(np.concatenate([x, *crowds[0]]), np.concatenate([y, *crowds[1]]), len(x))

        def out(a: np.ndarray, b: np.ndarray, pairs: int = 0) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((np.arange(len(a)) >= pairs).astype(np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        def given(key: int) -> pa.RecordBatch:
            tagged = np.concatenate(rest)
            tagged = tagged[tagged != _MARK]
            return out(np.full(len(tagged), key), tagged)

        for batch in batches:
            key, tagged = batch["key"].to_numpy(zero_copy_only=False), batch["tagged"].to_numpy(zero_copy_only=False)
            dealt = (tagged & _DEALT != 0) & (tagged != _MARK)
            if dealt.any():
                yield out(key[dealt], tagged[dealt] & ~_DEALT)
                key, tagged = key[~dealt], tagged[~dealt]
            if not len(key):
                continue
            if rest and key[0] != rest_key:
                yield given(rest_key) if given_up else emit(np.full(held, rest_key), np.concatenate(rest))
                rest, held, given_up = [], 0, False
            first = int(np.searchsorted(key, key[0], side="right")) if rest else 0
            last = int(np.searchsorted(key, key[-1], side="left"))
            if last > 0 and rest:  # the key that went on ends here
                rest.append(tagged[:first])
                yield given(rest_key) if given_up else emit(np.full(held + first, rest_key), np.concatenate(rest))
                rest, held, given_up = [], 0, False
            if last > first:
                yield emit(key[first:last], tagged[first:last])
            rest.append(tagged[last:])
            rest_key, held = key[-1], held + len(key) - last
            if held > CROWD:
                yield given(rest_key)
                rest, held, given_up = [none], 0, True
        if rest:
            yield given(rest_key) if given_up else emit(np.full(held, rest_key), np.concatenate(rest))

    by_line = (F.col("tagged").bitwiseAND(int(_DEALT)) != 0) & (F.col("tagged") != int(_MARK))
    rows = keys.select("key", "tagged").repartition(F.when(by_line, F.xxhash64("key", "tagged")).otherwise(F.col("key"))).sortWithinPartitions("key", "tagged")
    return stored(few_parts(rows.mapInArrow(match, "kind int, a long, b long")), "line-pairs")


def _texts_of(lines: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """(id, id2, line) of the wanted ids; a bitmap of 32 MB at most sorts out most others before the join."""
    bits = min(28, max(15, (16 * count).bit_length()))
    place = F.expr(f"shiftrightunsigned(id, {64 - bits})")
    found = wanted.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bits")).collect()
    table = np.zeros(max(4096, (1 << bits) // 8), dtype=np.uint8)
    for r in found:
        table[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    maybe = lines.sparkSession.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = (batch["id"].to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            hit = (maybe.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(hit)), batch["id2"].filter(pa.array(hit)), batch["text"].filter(pa.array(hit)).cast(pa.string())], names=["id", "id2", "line"])

    some = lines.filter("text IS NOT NULL").select("id", "id2", "text").mapInArrow(read, "id long, id2 long, line string")
    own = some.join(wanted.withColumnRenamed("id", "w"), F.col("id") == F.col("w"), "left_semi")
    return stored(own.dropDuplicates(["id", "id2"]), "line-texts")


def _without_common_ends(a: str, b: str) -> tuple[str, str]:
    """What is left of two strings without what they begin and end with alike; their distance is the same."""
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    return a[: len(a) - n], b[: len(b) - n]


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance of a and b is ``tau`` at most.

    R[d] has bit i set when a[:i] and the read part of b are at distance d or less; a step of all
    bits takes a few word operations.  Only the band of 2 tau + 1 diagonals is kept.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b:
        return True
    a, b = _without_common_ends(a, b)
    stands: dict[str, int] = {}
    for i, c in enumerate(a):
        stands[c] = stands.get(c, 0) | 2 << i
    rows = [(2 << d) - 1 for d in range(tau + 1)]
    band = (1 << (2 * tau + 1)) - 1
    for j, c in enumerate(b, 1):
        at = stands.get(c, 0)
        keep = band << (j - tau) if j > tau else band >> (tau - j)
        before = rows[0]
        rows[0] = before << 1 & at & keep
        for d in range(1, tau + 1):
            old = rows[d]
            rows[d] = (old << 1 & at | before | before << 1 | rows[d - 1] << 1) & keep
            before = old
        if not rows[tau]:
            return False
    return bool(rows[tau] >> len(a) & 1)


def _verified(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """(a, a2, b, b2): the pairs of lines within the distance, by their full digests."""
    one, other = (texts.select(F.col("id").alias(f"i{k}"), F.col("id2").alias(f"{k}2"), F.col("line").alias(f"l{k}")) for k in "ab")
    both = pairs.join(one, F.col("a") == F.col("ia")).join(other, F.col("b") == F.col("ib")).select("a", "a2", "b", "b2", "la", "lb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within(x, y, tau) for x, y in zip(batch["la"].to_pylist(), batch["lb"].to_pylist(), strict=True)]
            yield batch.select(["a", "a2", "b", "b2"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(verify, "a long, a2 long, b long, b2 long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: its lines, those removed as copies or near copies, and their numbers."""
    shared_dir(docs.sparkSession)
    lines = stored(_lines(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))), "lines")
    at = F.struct("doc", "line")
    distinct = checkpointed(lines.groupBy("id", "id2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")))

    level = _matched(_line_keys(lines, tau, min_chars), PAIRS_PER_LINE)
    pairs = level.filter("kind = 0").select("a", "b").distinct()
    crowded = level.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("tagged")).distinct()
    own = F.col("tagged").bitwiseAND(~int(_ROLES))
    wanted = checkpointed(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(crowded.select(own.alias("id"))).distinct())
    texts = _texts_of(lines, wanted, wanted.count())
    firsts = distinct.select(F.col("id").alias("i"), F.col("id2").alias("i2"), "first")
    links = checkpointed(_verified(pairs, texts, tau))
    near = links.select(F.col("a").alias("x"), F.col("a2").alias("x2"), F.col("b").alias("y"), F.col("b2").alias("y2"))
    near = near.unionByName(links.select(F.col("b").alias("x"), F.col("b2").alias("x2"), F.col("a").alias("y"), F.col("a2").alias("y2")))
    earlier = near.join(firsts, (F.col("y") == F.col("i")) & (F.col("y2") == F.col("i2"))).select("x", "x2", "first").unionByName(_crowds(crowded, texts, firsts, tau))
    earlier = earlier.groupBy("x", "x2").agg(F.min("first").alias("near_first"))
    judged = distinct.join(earlier, (F.col("id") == F.col("x")) & (F.col("id2") == F.col("x2")), "left").select("id", "id2", "n", "first", "near_first")
    # Lines without a copy or a near line stay anyway.
    judged = checkpointed(judged.filter("n > 1 OR near_first IS NOT NULL"))
    marked = _with_judgement(lines.select("id", "id2", "doc", "line"), judged, distinct.agg(F.sum("n")).first()[0] or 0)
    copy = F.coalesce(F.col("first") < at, F.lit(False))
    close = F.coalesce(F.col("near_first") < at, F.lit(False))
    per_doc = marked.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(copy | close).alias("n_removed"), F.count_if(close & ~copy).alias("n_near"), F.array_sort(F.collect_set(F.when(copy | close, F.col("line")))).alias("removed_lines"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id")).join(per_doc, F.coalesce("doc_id", F.lit(_LAST)) == F.col("doc"), "left").select(
        "doc_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_lines", "n_removed", "n_near")],
        F.coalesce("removed_lines", F.expr("CAST(array() AS array<bigint>)")).alias("removed_lines"),
    )


def _with_judgement(lines: DataFrame, judged: DataFrame, total: int) -> DataFrame:
    """Lines with the first places of their copies and near lines.

    Lines of which there are total / _HOT_SHARE or more, so _HOT_SHARE different ones at most, are
    joined by broadcast, and dealt by their place in the join of the others.
    """
    hot_at = max(2, total // _HOT_SHARE)
    columns = ("first", "near_first")
    hot = judged.filter(F.col("n") >= hot_at).select(F.col("id").alias("h"), F.col("id2").alias("h2"), F.lit(True).alias("hot"), *[F.col(c).alias(f"hot_{c}") for c in columns])
    cold = judged.filter(F.col("n") < hot_at).select(F.col("id").alias("c"), F.col("id2").alias("c2"), *[F.col(c).alias(f"cold_{c}") for c in columns])
    dealt = lines.join(F.broadcast(hot), (F.col("id") == F.col("h")) & (F.col("id2") == F.col("h2")), "left").withColumn("deal", F.when(F.col("hot"), F.xxhash64("doc", "line")).otherwise(F.col("id")))
    joined = dealt.join(cold, (F.col("deal") == F.col("c")) & (F.col("id2") == F.col("c2")), "left")
    return joined.select("doc", "line", *[F.when(F.col("hot"), F.col(f"hot_{c}")).otherwise(F.col(f"cold_{c}")).alias(c) for c in columns])


def _crowds(crowded: DataFrame, texts: DataFrame, firsts: DataFrame, tau: int) -> DataFrame:
    """(x, x2, first): an earlier match of a line among the lines that share a crowded key with it.

    Blocks of probes meet blocks of postings; no pair leaves a block, only the earliest match found for each
    line.  Counts of hashed characters, which an edit changes by two at most, sort out most pairs.
    """
    is_probe = F.col("tagged").bitwiseAND(int(_PROBES)) != 0
    sizes = crowded.groupBy("key").agg(*[F.ceil(F.count_if(is_probe == tag) / BLOCK).cast("int").alias(name) for tag, name in ((False, "posted"), (True, "probed"))])
    lines = texts.join(firsts, (F.col("id") == F.col("i")) & (F.col("id2") == F.col("i2"))).select("id", "id2", "line", F.col("first.doc").alias("doc"), F.col("first.line").alias("number"))
    sized = crowded.withColumn("own", F.col("tagged").bitwiseAND(~int(_ROLES))).join(sizes.withColumnRenamed("key", "k"), F.col("key") == F.col("k"))
    rows = sized.join(lines, F.col("own") == F.col("id"))
    probe = is_probe
    deal = F.pmod(F.xxhash64("id"), F.when(probe, F.col("probed")).otherwise(F.col("posted"))).cast("int")
    others = F.explode(F.expr(f"sequence(0, greatest(IF((tagged & {int(_PROBES)}) != 0, posted, probed), 1) - 1)"))
    meets = rows.select("key", probe.alias("probe"), deal.alias("mine"), others.alias("theirs"), "id", "id2", "line", "doc", "number")
    x, y = F.when(F.col("probe"), F.col("mine")).otherwise(F.col("theirs")), F.when(F.col("probe"), F.col("theirs")).otherwise(F.col("mine"))
    blocks = meets.select("key", x.alias("x"), y.alias("y"), "probe", "id", "id2", "line", "doc", "number").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def settle(postings: list[tuple], probes: list[tuple]) -> dict[tuple, tuple]:
        """The earliest match of each line of a block that has an earlier one; rows are (id, id2, line, doc, number)."""

        def counts(rows: list[tuple]) -> np.ndarray:
            out = np.zeros((len(rows), 32), dtype=np.int32)
            for r, row in enumerate(rows):
                out[r, :31] = np.bincount(np.frombuffer(row[2].encode("utf-32-le", "surrogatepass"), dtype="<u4") % 31, minlength=31)
                out[r, 31] = len(row[2])
            return out

        best: dict[tuple, tuple] = {}
        postings.sort(key=lambda r: r[3:])
        probes.sort(key=lambda r: r[3:])
        have, want = counts(postings), counts(probes)
        for p, (i, i2, line, *first) in zip(want, probes, strict=True):
            first = tuple(first)
            for k in np.flatnonzero((np.abs(have[:, 31] - p[31]) <= tau) & (np.abs(have[:, :31] - p[:31]).sum(axis=1) <= 2 * tau)):
                j, j2, other, *place = postings[k]
                place = tuple(place)
                # Both come by place, so what a line has found already is earlier than what follows.
                gains = (i, i2) if place < first else (j, j2)
                if (j, j2) != (i, i2) and place != first and gains not in best and within(other, line, tau):
                    best[gains] = min(place, first)
        return best

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, ([], []), {}
        for batch in batches:
            for key, x, y, probe, *row in zip(*(batch[c].to_pylist() for c in ("key", "x", "y", "probe", "id", "id2", "line", "doc", "number")), strict=True):
                if (key, x, y) != at:
                    merge(out, settle(*held))
                    at, held = (key, x, y), ([], [])
                held[probe].append(tuple(row))
            if len(out) > 5000:
                yield rows_of(out)
                out = {}
        merge(out, settle(*held))
        yield rows_of(out)

    def merge(out: dict[tuple, tuple], more: dict[tuple, tuple]) -> None:
        for line, place in more.items():
            out[line] = min(place, out.get(line, place))

    def rows_of(out: dict[tuple, tuple]) -> pa.RecordBatch:
        columns = list(zip(*((*line, *place) for line, place in out.items()), strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x", "x2", "doc", "line"])

    return blocks.mapInArrow(match, "x long, x2 long, doc long, line long").select("x", "x2", F.struct("doc", "line").alias("first"))


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that :func:`line_dedup` leaves."""
    taken = set(docs.columns)
    of, gone_lines = (next(n for k in range(len(taken) + 1) if (n := f"{name}{k}") not in taken) for name in ("of", "removed"))
    gone = removed.select(F.col("doc_id").alias(of), F.col("removed_lines").alias(gone_lines)).distinct()
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(gone_lines, i.cast("long"))), "\n")
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(of)), "left")
    return joined.select(*[F.when(F.col(gone_lines).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])
