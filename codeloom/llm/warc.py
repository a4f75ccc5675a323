"""WARC archives (operator 9): a writer with revisit records and a splittable reader.

Archives are sequences of gzip members, one WARC record each.  The writer goes through Spark's
text sink, so commits and retries are Spark's: every member ends with the zero byte of its
length field, and that byte is the sink's line separator.  (A record of 16 MiB or more ends in
another byte and is followed by an empty member, which ends in zero.)

The reader goes through Spark's text source with the gzip magic as line separator: each task
scans its byte range for the magic and owns the candidates that start inside it.  A candidate
counts only if its gzip header and its deflate stream decode.  A magic inside a member cuts the
member in two; a task joins the pieces again, and pieces cut apart by the edge of a byte range
are stitched by file.

Damage stops nothing: a member that does not decode or is cut short, a record without a WARC header or with a bad
or too large length, and a payload that does not fit its SHA-1 digest come back as rows with ``damage``, on
request; without the request they are left out.

Defined results: null payloads are empty, null URLs leave the header out, null identifiers are
written as such and read back as null; repeated rows give repeated records, and every row with
the largest identifier of a group of equal payloads is a response; line breaks in a URL are
percent-encoded; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import left_join_groups, shared_path

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are always stored in full.
REVISIT_FROM = 1000


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    return out if out[-1] == 0 else out + _member(b"")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, size: int, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            out.append(_member(_record(row["page_id"], row["url"], row["payload"], row["digest"], "revisit" if row["refers_to"] is not None else "response", row["size"], row["refers_to"]))[:-1])
        yield pa.record_batch([pa.array(out, type=pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one WARC record per row below ``path``."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    groups = base.filter(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = left_join_groups(base, groups, "digest", "n", pages.count())
    refers = F.when((F.col("size") >= REVISIT_FROM) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    rows = joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "size", refers.alias("refers_to"))
    rows.mapInArrow(_pack, "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\u0000").text(path)


# --- reading -----------------------------------------------------------------------------------

_READ_SCHEMA = "file string, block long, seq long, part binary, damage string, record_id string, record_type string, url string, digest string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _parse(record: bytes) -> dict | None:
    """The fields of a record; None for an empty member, which only fills the writer's line."""
    if not record:
        return None
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        return {"damage": "no WARC header", "payload_bytes": len(record)}
    fields = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    length, damage = fields.get(b"content-length", ""), None
    if not (length.isascii() and length.isdigit()):
        damage, block = "bad content length", rest
    else:
        block = rest[: int(length)]
        if len(block) < int(length):
            damage = "short record"
    kind = fields.get(b"warc-type")
    http, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
    algorithm, _, digest = fields.get(b"warc-payload-digest", "").rpartition(":")
    if kind == "revisit":
        said = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, found, payload = int(said[0]) if said and said[0].isdigit() else None, digest, None
    else:
        hashed = hashlib.sha1(payload)
        size, found = len(payload), hashed.hexdigest()
        if damage is None and algorithm.lower() == "sha1" and digest.lower() not in (found, base64.b32encode(hashed.digest()).decode().lower()):
            damage = "payload digest"
    url = fields.get(b"warc-target-uri")
    if url is not None:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return {"damage": damage, "record_id": fields.get(b"warc-record-id"), "record_type": kind, "url": url, "digest": digest, "refers_to": fields.get(b"warc-refers-to"), "payload_bytes": size, "payload_digest": found, "payload": payload}


class _Joiner:
    """Turns the candidates of one byte range, in order, into records and unresolved pieces."""

    def __init__(self) -> None:
        self.open, self.held = None, b""  # a member that has not ended yet, and its bytes so far

    def feed(self, piece: bytes) -> tuple[list[bytes], list[bytes]]:
        """Complete records, and pieces that belong to no member begun here."""
        if self.open is not None:
            try:
                text = self.text + self.open.decompress(piece)
            except zlib.error:
                lost, self.open = self.held, None
                records, pieces = self.feed(piece)
                return records, [lost, *pieces]
            return self._advance(text, piece, self.held + piece)
        if len(piece) < 10 or not piece.startswith(MAGIC) or piece[3] & 0xE0:
            return [], [piece]
        self.open = zlib.decompressobj(31)
        try:
            text = self.open.decompress(piece)
        except zlib.error:
            self.open = None
            return [], [piece]
        return self._advance(text, piece, piece)

    def _advance(self, text: bytes, piece: bytes, held: bytes) -> tuple[list[bytes], list[bytes]]:
        if self.open.eof:
            self.open, self.held = None, b""
            return [text], []
        self.text, self.held = text, held
        return [], []

    def end(self) -> list[bytes]:
        left = [self.held] if self.open is not None else []
        self.open, self.held = None, b""
        return left


def _rows(file: str, block: int, seq: int, records: list[bytes], pieces: list[bytes]) -> list[dict]:
    blank = {"part": None, "damage": None, "record_id": None, "record_type": None, "url": None, "digest": None, "refers_to": None, "payload_bytes": None, "payload_digest": None, "payload": None}
    out = [blank | {"file": file, "block": block, "seq": seq, "part": p} for p in pieces if p]
    return out + [blank | {"file": file, "block": block, "seq": seq} | r for r in map(_parse, records) if r]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("part", pa.binary()), ("damage", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    at, seq, joiner, rest = None, 0, _Joiner(), []
    for batch in batches:
        out = rest
        rest = []
        for file, block, value in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["value"].to_pylist(), strict=True):
            if at != (file, block):
                if at is not None:
                    out += _rows(*at, seq + 1, [], joiner.end())
                at, seq = (file, block), 0
            seq += 1
            if value:
                out += _rows(file, block, seq, *joiner.feed(MAGIC + value))
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        rest = out
    if at is not None:
        rest = rest + _rows(*at, seq + 1, [], joiner.end())
    yield pa.RecordBatch.from_pylist(rest, schema=schema)


def _stitch(pieces: pd.DataFrame) -> pd.DataFrame:
    """Members of one file that the edges of byte ranges cut apart; what joins to no member is damage."""
    joiner, out, columns = _Joiner(), [], list(pieces.columns)

    def add(row, records: list[bytes], lost: list[bytes]) -> None:
        out.extend(_rows(row.file, row.block, row.seq, records, []))
        out.extend(_rows(row.file, row.block, row.seq, [], lost))

    row = None
    for row in pieces.sort_values(["block", "seq"], kind="stable").itertuples():
        add(row, *joiner.feed(row.part))
    if row is not None:
        add(row, [], joiner.end())
    for r in out:
        if r["part"] is not None:
            r |= {"damage": "member does not decode", "payload_bytes": len(r["part"]), "part": None}
    return pd.DataFrame(out, columns=columns)


def read_archives(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """The records of all archives below ``path``, read in byte ranges; with ``damaged``, what is not whole comes along."""
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    parsed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")).mapInArrow(_unpack, _READ_SCHEMA)
    whole = parsed.filter(F.col("part").isNull())
    cut = parsed.filter(F.col("part").isNotNull()).groupBy("file").applyInPandas(_stitch, _READ_SCHEMA)
    rows = whole.unionByName(cut).drop("part", "seq", "block")
    return rows if damaged else rows.filter("damage IS NULL").drop("damage")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and return one row per record."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*)>$', 1), '') AS long)")
    return read_archives(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
