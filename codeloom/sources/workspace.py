"""Workspace scans: source files, manifests, graph snapshots."""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.selection import running_total

# Fixed values.  S2: directories never scanned, besides the tool's own cache folder.
EXCLUDED_DIRECTORIES = (".git", ".vscode", "node_modules", "dist", "build", "coverage", ".venv", "venv", "__pycache__", "target", "out")
# S3: language of each extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "vue": "vue", "svelte": "svelte", "py": "python", "rs": "rust", "go": "go", "java": "java",
    "fs": "fsharp", "fsx": "fsharp", "ml": "ocaml", "mli": "ocaml", "ex": "elixir", "exs": "elixir",
    "kt": "kotlin", "kts": "kotlin", "php": "php", "rb": "ruby",
}
DEFAULT_SIZE_CAP = 1024 * 1024

#: Manifest file name -> ecosystem.
MANIFESTS = {
    "package.json": "npm",
    "pyproject.toml": "python",
    "requirements.txt": "python",
    "Cargo.toml": "cargo",
    "go.mod": "go",
    "pom.xml": "jvm",
    "build.gradle": "jvm",
    "composer.json": "composer",
    "Gemfile": "ruby",
}


def language_of(path: Column) -> Column:
    """S3: language by extension; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, F.lower(F.substring_index(path, ".", -1)))


def excluded(path: Column, cache_folder: str | None = None) -> Column:
    """Whether a directory of the path is on the exclusion list, or the tool's own cache folder."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    names = [*EXCLUDED_DIRECTORIES, *([cache_folder] if cache_folder else [])]
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, names)))


def below(path: Column, root: str) -> Column:
    """The part of a file's path below ``root``; a root without a scheme and leading slash is a local folder's path."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    bare = bare if bare.startswith("/") else os.path.abspath(bare)
    start = len(posixpath.normpath(bare).rstrip("/")) + 2
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "").substr(F.lit(start), F.length(path))


def scan_workspace(spark: SparkSession, root: str, size_cap: int = DEFAULT_SIZE_CAP, cache_folder: str | None = None) -> DataFrame:
    """(path, language, size, mtime, content, content_hash, dirty_hash) of all source files below ``root``, by path.

    Sizes and paths are filtered before contents are read; folders are excluded by their names below the root.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    known = files.filter((F.col("length") <= size_cap) & language_of(F.col("path")).isNotNull() & ~excluded(below(F.col("path"), root), cache_folder))
    return known.select("path", language_of(F.col("path")).alias("language"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), F.lit(None).cast("string").alias("dirty_hash")).orderBy("path")


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether a path relative to the workspace fits a glob with ``**``, ``*``, ``?`` and ``{a,b}``."""
    out, depth = "", 0
    for part in re.findall(r"\*\*/?|\*|\?|\{|\}|,|[^*?{},]+", pattern):
        if part.startswith("**"):
            out += "(?:.*/)?" if part.endswith("/") else ".*"
        elif part in "*?":
            out += "[^/]*" if part == "*" else "[^/]"
        elif part in "{}" or (part == "," and depth):
            depth += {"{": 1, "}": -1}.get(part, 0)
            out += {"{": "(?:", "}": ")", ",": "|"}[part]
        else:
            out += re.escape(part)
    return path.rlike(f"^{out}$")


#: Source files that a search gives at most.
FILE_LIMIT = 10_000


def find_source_files(files: DataFrame, include: str, exclude: str | None = None, limit: int = FILE_LIMIT) -> DataFrame:
    """Files that fit the globs, the first by path up to the limit of a workspace."""
    found = files.filter(matches_glob(F.col("path"), include) & (F.lit(True) if exclude is None else ~matches_glob(F.col("path"), exclude)))
    return found.orderBy("path").limit(limit)


def with_overlay(disk: DataFrame, overlay: DataFrame) -> DataFrame:
    """Unsaved editor text wins over the file on disk."""
    edited = overlay.select(F.col("path").alias("edited_path"), F.col("content").alias("edited"))
    joined = disk.join(edited, F.col("path") == F.col("edited_path"), "left")
    text = F.coalesce("edited", "content")
    return joined.select("path", "language", F.octet_length(text).cast("long").alias("size"), "mtime", text.alias("content"), F.sha2(text, 256).alias("content_hash"), F.sha2("edited", 256).alias("dirty_hash"))


def package_roots(spark: SparkSession, root: str, cache_folder: str | None = None) -> DataFrame:
    """Directories with manifests: their ecosystems and manifest names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.substring_index("path", "/", -1)
    table = F.create_map(*[F.lit(x) for pair in MANIFESTS.items() for x in pair])
    found = files.filter(name.isin(*MANIFESTS) & ~excluded(below(F.col("path"), root), cache_folder)).select(F.regexp_replace("path", "/[^/]*$", "").alias("root"), name.alias("manifest"), F.element_at(table, name).alias("ecosystem"))
    return found.groupBy("root").agg(F.array_sort(F.collect_set("ecosystem")).alias("ecosystems"), F.array_sort(F.collect_set("manifest")).alias("manifests"))


def fingerprint(files: DataFrame, config: str = "") -> DataFrame:
    """One digest of a workspace: its configuration and every file's path, size, time and dirty content hash.

    Files are digested in 256 parts by the digest of their path, so no row gathers the whole workspace.
    ``files`` has path, size, mtime and dirty_hash, which is null for saved files.
    """
    line = F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime").cast("string"), F.coalesce("dirty_hash", F.lit("")))
    part = F.left(F.sha2("path", 256), F.lit(2)).alias("part")
    parts = files.groupBy(part).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("digest"))
    joined = F.array_join(F.array_sort(F.collect_list(F.concat("part", "digest"))), ",")
    return parts.agg(F.sha2(F.concat(F.lit(config), F.lit(","), joined), 256).alias("fingerprint"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph snapshot as JSON lines, a folder for each table."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot back, failing on rows that do not fit the schemas."""
    read = lambda name, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")
    return read("nodes", node_schema), read("edges", edge_schema)


def retained(snapshots: DataFrame, caps: dict[str, int] | int, byte_budget: int) -> DataFrame:
    """Which cached snapshots stay: the latest of each scope up to its cap, then within the byte budget.

    One number as ``caps`` holds for every scope; of a dict, scopes without a cap keep nothing.
    """
    cap = F.lit(caps) if isinstance(caps, int) else F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("scope"))
    latest = Window.partitionBy("scope").orderBy(F.desc("saved_at"), "cache_key")
    kept = snapshots.withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= cap)
    running = running_total(kept, [F.desc("saved_at"), F.asc("scope"), F.asc("cache_key")], F.col("bytes"), "running")
    return running.filter(F.col("running") <= byte_budget).drop("n", "running")


def merge_supplement(base: DataFrame, supplement: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, the base's where both have a key."""
    keys = base.select(F.col(key).alias("_k"))
    return base.unionByName(supplement.join(keys, F.col(key) == F.col("_k"), "left_anti"))


def merge_supplement_edges(base: DataFrame, supplement: DataFrame, supplement_nodes: DataFrame) -> DataFrame:
    """The base's edges, and those of the supplement that are new and have both ends in it."""
    ids = supplement_nodes.select(F.col("id").alias("_n"))
    own = supplement.join(ids, F.col("source_id") == F.col("_n"), "left_semi").join(ids, F.col("target_id") == F.col("_n"), "left_semi")
    return merge_supplement(base, own)
