"""Workspace manifest of source files as a Spark data source.

The format: a version line, a line with the number of files (10,000 at most), then for each file three
lines with the byte lengths of its path, language and content, followed by these three fields.  Files
are sorted by path.  Files over the size cap are read over and left out.  An empty path or language, an
unknown version, too many files, a cut-off record or trailing bytes are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, language string, content_hash string, size long, content string"
#: The version line; writer and reader must agree on it, so both take another one.
VERSION = "workspace-sources-v1"
# Fixed values.
MAX_FILES = 10_000
MAX_PATH_BYTES, MAX_LANGUAGE_BYTES = 1024 * 1024, 1024
#: Languages that are written as another.
WRITTEN_AS = {"typescriptreact": "typescript", "javascriptreact": "javascript"}


def encode_manifest(files: Iterable[tuple[str, str, str]], version: str = VERSION) -> bytes:
    """The manifest of (path, language, content) triples."""
    rows = sorted(files, key=lambda r: r[0])
    out = [f"{version}\n{len(rows)}\n".encode()]
    for path, language, content in rows:
        fields = [x.encode() for x in (path, WRITTEN_AS.get(language, language), content)]
        out.append("".join(f"{len(x)}\n" for x in fields).encode() + b"".join(fields))
    return b"".join(out)


def decode_manifest(data: bytes, size_cap: int, version: str = VERSION) -> Iterator[tuple]:
    """(path, language, content hash, size, content) of the files up to the size cap."""
    at = 0

    def line(what: str) -> str:
        nonlocal at
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"manifest {what} has no line end")
        at, text = end + 1, data[at:end]
        return text.decode()

    def number(what: str, most: int | None = None) -> int:
        text = line(what)
        if not text.isascii() or not text.isdigit():
            raise ValueError(f"manifest {what} is no number: {text!r}")
        if most is not None and int(text) > most:
            raise ValueError(f"manifest {what} is {text}, over {most}")
        return int(text)

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError(f"manifest ends inside a record at byte {at}")
        at += n
        return data[at - n : at]

    if (told := line("version")) != version:
        raise ValueError(f"unknown manifest version {told!r}")
    for _ in range(number("file count", MAX_FILES)):
        sizes = number("path length", MAX_PATH_BYTES), number("language length", MAX_LANGUAGE_BYTES), number("content length")
        path, language, content = (take(n) for n in sizes)
        if not path or not language:
            raise ValueError("manifest file has an empty path or language")
        if sizes[2] <= size_cap:
            yield path.decode(), language.decode(), hashlib.sha256(content).hexdigest(), sizes[2], content.decode()
    if at != len(data):
        raise ValueError("manifest has trailing bytes")


def read_manifests(spark: SparkSession, path: str, size_cap: int = 1024 * 1024, version: str = VERSION) -> DataFrame:
    """The files of all manifests that ``path`` names, read through Spark's file systems, one manifest a task.

    A manifest is bounded by its number of files and is decoded where it is read.
    """

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = [r for data in batch["content"] for r in decode_manifest(bytes(data), size_cap, version)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, SCHEMA)


def write_manifest(files: DataFrame, path: str) -> None:
    """One manifest of ``files`` (path, language, content); more than its limit of files is an error."""
    rows = files.select("path", "language", "content").limit(MAX_FILES + 1).collect()
    if len(rows) > MAX_FILES:
        raise ValueError(f"a manifest holds {MAX_FILES} files at most")
    spark = files.sparkSession
    data = encode_manifest((r["path"], r["language"], r["content"]) for r in rows).decode()
    spark.createDataFrame([(data,)], "value string").coalesce(1).write.option("lineSep", "\u0000").text(path)


class ManifestDataSource(DataSource):
    """``spark.read.format("code_manifest").option("size_cap", n).load(path)`` of one manifest on a local disk.

    For manifests elsewhere, and for many, see :func:`read_manifests`.
    """

    @classmethod
    def name(cls) -> str:
        return "code_manifest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.size_cap = int(options.get("size_cap", 1024 * 1024))
        self.version = options.get("version", VERSION)

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from decode_manifest(f.read(), self.size_cap, self.version)


def size_in_bytes(files: DataFrame) -> DataFrame:
    """The length of the manifest that the files would make, without making it."""
    fields = [F.octet_length(c) for c in ("path", "language", "content")]
    record = sum((f + F.length(f.cast("string")) + 1 for f in fields[1:]), fields[0] + F.length(fields[0].cast("string")) + 1)
    head = len(VERSION) + 2
    return files.agg((F.lit(head) + F.length(F.count(F.lit(1)).cast("string")) + F.coalesce(F.sum(record), F.lit(0))).cast("long").alias("bytes"))
