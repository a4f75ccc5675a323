"""The import graph of files: roots, entry points, its summary, and import resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import forward_slashes

# How likely a file is where an application starts, first pattern that fits.
ENTRY_SCORES = (
    (130, r"(^|/)manage\.py$"),
    (124, r"(^|/)(apps|packages|services)/[^/]+/src/(main|index)\.(ts|tsx|js|jsx)$"),
    (122, r"(^|/)src/(main|index)\.(ts|tsx|js|jsx)$"),
    (116, r"^(main|index)\.(ts|tsx|js|jsx|py)$"),
    (110, r"(^|/)src/(app|bootstrap|client|server)\.(ts|tsx|js|jsx)$"),
    (104, r"(^|/)src/pages/(_app|_document|_error)\.(ts|tsx|js|jsx)$"),
    (104, r"(^|/)src/app/layout\.(ts|tsx|js|jsx)$"),
    (98, r"(^|/)(apps|packages|services)/[^/]+/(main|index)\.(ts|tsx|js|jsx|py)$"),
)
# Paths that are no root of an application.
NON_APPLICATION = (
    r"(^|/)(node_modules|dist|build|coverage)/",
    r"(^|/)(stories|__tests__|tests)/",
    r"(^|/)\.storybook/",
    r"\.(stories|test|spec|d)\.(ts|tsx|js|jsx)$",
    r"(^|/)(__generated__|generated|generated-icons)(/|$)",
    r"(^|/)pages/",
    r"(^|/)app/[^/]+/page\.(ts|tsx|js|jsx)$",
    r"-page(/|\.|-)",
)
FALLBACK_ROOTS = 24
ROOT_DIRECTORIES = 12
#: What may follow a module name in the file that holds it.
MODULE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")


def entry_score(path: Column) -> Column:
    """From 130 down to 98 for conventional entry points, 0 for other paths relative to the workspace."""
    p = forward_slashes(path)
    out = F.lit(0)
    for score, pattern in reversed(ENTRY_SCORES):
        out = F.when(p.rlike(pattern), score).otherwise(out)
    return out


def non_application(path: Column) -> Column:
    """Stories, tests, pages, build output and generated files."""
    p = forward_slashes(path)
    out = F.lit(False)
    for pattern in NON_APPLICATION:
        out = out | p.rlike(pattern)
    return out


def import_roots(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Files (path) that import and are never imported; if there are none, all that import; without imports, all files.

    ``imports`` has source and target paths; targets outside ``files`` are external.
    """
    importers, imported = imports.select(F.col("source").alias("i")).distinct(), imports.select(F.col("target").alias("t")).distinct()
    own = files.select("path").distinct()
    using = own.join(importers, F.col("path") == F.col("i"), "left_semi")
    roots = using.join(imported, F.col("path") == F.col("t"), "left_anti")
    if not roots.isEmpty():
        return roots
    return own if using.isEmpty() else using


def application_entries(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, score): entry points that nothing imports; if there are none, the roots with most imports, 24 at most."""
    imported = imports.select(F.col("target").alias("t")).distinct()
    scored = files.select("path", entry_score(F.col("path")).alias("score")).distinct().filter("score > 0").join(imported, F.col("path") == F.col("t"), "left_anti")
    if not scored.isEmpty():
        return scored
    roots = import_roots(files, imports)
    chosen = roots.filter(~non_application(F.col("path")))
    chosen = roots if chosen.isEmpty() else chosen
    degree = imports.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    ordered = chosen.join(degree, F.col("path") == F.col("s"), "left").orderBy(F.desc_nulls_last("n"), "path").limit(FALLBACK_ROOTS)
    return ordered.select("path", F.lit(0).alias("score"))


def import_summary(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Counters of the import graph, one row."""
    own = files.select("path").distinct()
    targets = own.withColumnRenamed("path", "p")
    inside = F.col("p").isNotNull()
    counted = imports.join(targets, F.col("target") == F.col("p"), "left").agg(
        F.count(F.lit(1)).alias("import_edges"),
        F.count_distinct("source").alias("importer_files"),
        F.count_distinct(F.when(inside, F.col("target"))).alias("imported_files"),
        F.count_if(~inside).alias("external_imports"),
    )
    entries = application_entries(files, imports).agg(F.count(F.lit(1)).alias("application_entrypoints"))
    roots = import_roots(files, imports).agg(F.count(F.lit(1)).alias("entry_roots"))
    return counted.crossJoin(own.agg(F.count(F.lit(1)).alias("file_nodes"))).crossJoin(entries).crossJoin(roots)  # one row each


def root_directories(roots: DataFrame, limit: int = ROOT_DIRECTORIES) -> DataFrame:
    """(path, count): the directories with most import roots."""
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    return roots.groupBy(F.when(directory == "", ".").otherwise(directory).alias("path")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "path").limit(limit)


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(source, specifier, target) of imports by module specifier; target is null for external ones.

    A relative specifier is taken from the importing file's directory, an alias (prefix ending in
    ``*`` to path) is put in place, a dotted name is taken for a path whose suffix only one file has.  Of
    the possible endings the first that exists wins.  All candidates are equi-join keys.
    """
    from ..functions.scalars import parent_path, path_key

    spec = F.col("specifier")
    relative = F.startswith(spec, F.lit("."))
    based = F.when(F.startswith(spec, F.lit("./")) | F.startswith(spec, F.lit("../")), path_key(F.concat(parent_path(F.col("source")), F.lit("/"), spec)))
    for alias, to in (aliases or {}).items():
        head, place = alias.removesuffix("*"), to.removesuffix("*")
        based = F.when(based.isNull() & F.startswith(spec, F.lit(head)), path_key(F.concat(F.lit(place), F.substring(spec, len(head) + 1, 1 << 20)))).otherwise(based)
    rows = imports.select("source", "specifier").distinct().withColumn("base", based)
    endings = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(e).alias("ending")) for k, e in enumerate(MODULE_ENDINGS)])
    tried = rows.filter("base IS NOT NULL").select("source", "specifier", "base", F.inline(endings)).select("source", "specifier", "rank", F.concat("base", "ending").alias("candidate"))
    own = files.select("path").distinct()
    direct = tried.join(own, F.col("candidate") == F.col("path")).groupBy("source", "specifier").agg(F.min_by("path", "rank").alias("target"))
    # Dotted modules: every suffix of a Python file's module path is a key; it must belong to one file.
    module = F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "^/", "")
    parts = F.split(module, "/")
    suffixes = own.filter(F.endswith("path", F.lit(".py"))).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))).alias("suffix"))
    unique = suffixes.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("home")).filter("n = 1")
    dotted = rows.filter(F.col("base").isNull() & ~relative).join(unique, spec == F.col("suffix")).filter("home <> source").select("source", "specifier", F.col("home").alias("target"))
    found = direct.unionByName(dotted)
    return rows.select("source", "specifier").join(found, ["source", "specifier"], "left")
