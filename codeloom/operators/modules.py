"""Boundaries of a workspace's modules, found from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import base_name, confidence_rank, parent_path, path_key, path_prefixes, source_area

# Kinds of a boundary, the strongest first.
BASES = ("workspacePackage", "frameworkRoot", "sourceArea", "workspaceRoot")
_EVIDENCE = ("key", "name", "basis", "confidence", "evidence", "manifest", "ecosystem", "framework")


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None)).cast("string").alias(c) for c in _EVIDENCE])


def _told(column: str) -> Column:
    """A trimmed text; null when there is nothing in it."""
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def boundary_evidence(packages: DataFrame, explicit: DataFrame, frameworks: DataFrame, units: DataFrame, workspace: str) -> DataFrame:
    """What five sources say of roots inside the workspace, one row each: manifests of packages, roots named by a caller, framework roots, roots of framework units, the workspace itself.

    ``packages`` has root_path, manifest and ecosystem; ``explicit`` root_path, name, basis, confidence, label and framework; ``frameworks`` name and
    root_path (null: the workspace); ``units`` framework, kind and root_path.
    """
    root = F.coalesce("root_path", F.lit(workspace))
    kind = lambda name, label: F.concat(F.lit(f"{name}|"), label)
    said = [
        _rows(packages, key=path_key(F.col("root_path")), basis=F.lit("workspacePackage"), confidence=F.lit("exact"), evidence=kind("manifest", F.concat(F.lit("Manifest root: "), F.coalesce(_told("manifest"), F.col("root_path")))), manifest=_told("manifest"), ecosystem=_told("ecosystem")),
        _rows(
            explicit,
            key=path_key(F.col("root_path")),
            name=_told("name"),
            basis=F.col("basis"),
            confidence=F.coalesce("confidence", F.when(F.col("basis") == "workspacePackage", "exact").otherwise("resolved")),
            evidence=kind("explicitRoot", F.coalesce("label", F.concat(F.lit("Explicit "), "basis", F.lit(": "), "root_path"))),
            framework=_told("framework"),
        ),
        _rows(frameworks, key=path_key(root), basis=F.lit("frameworkRoot"), confidence=F.lit("resolved"), evidence=kind("framework", F.concat("name", F.lit(" root: "), root)), framework=_told("name")),
        _rows(units, key=path_key(F.col("root_path")), basis=F.lit("frameworkRoot"), confidence=F.lit("resolved"), evidence=kind("frameworkUnit", F.concat("framework", F.lit(" "), "kind", F.lit(" root: "), "root_path")), framework=_told("framework")),
        _rows(packages.sparkSession.range(1), key=path_key(F.lit(workspace)), basis=F.lit("workspaceRoot"), confidence=F.lit("inferred"), evidence=F.lit("workspace|Analyzed workspace root")),
    ]
    out = said[0]
    for rows in said[1:]:
        out = out.unionByName(rows)
    return out.filter(_inside(F.col("key"), workspace))


def _inside(key: Column, workspace: str) -> Column:
    own = path_key(F.lit(workspace))
    return (key == own) | F.startswith(key, F.concat(own, F.lit("/")))


def source_areas(files: DataFrame, evidence: DataFrame, workspace: str) -> DataFrame:
    """The sixth source: areas of files that no boundary but the workspace owns, by the boundaries told before any area."""
    own = path_key(F.lit(workspace))
    keys = files.select(path_key(F.col("file_path")).alias("file")).filter(_inside(F.col("file"), workspace)).distinct()
    told = evidence.select("key").distinct().filter(F.col("key") != own)
    owned = keys.select("file", F.inline(path_prefixes(F.col("file")))).join(told, F.col("root") == F.col("key"), "left_semi").select(F.col("file").alias("had"))
    area = source_area(F.substring(F.col("file"), F.length(own) + 2, F.length("file")))
    areas = keys.join(owned, F.col("file") == F.col("had"), "left_anti").select(area.alias("area")).filter("area IS NOT NULL").distinct()
    return _rows(areas, key=F.concat(own, F.lit("/"), "area"), basis=F.lit("sourceArea"), confidence=F.lit("inferred"), evidence=F.concat(F.lit("sourceArea|Inferred source area: "), "area"))


def module_boundaries(evidence: DataFrame, files: DataFrame, workspace: str) -> DataFrame:
    """Every module once: its name, strongest basis and that basis' best confidence, all evidence, manifests, ecosystems and frameworks, and its nearest boundary above.

    Lists are sorted and joined; they hold distinct labels, which are few for each root.
    """
    own = path_key(F.lit(workspace))
    every = evidence.unionByName(source_areas(files, evidence, workspace))
    order = F.struct(F.array_position(F.array(*map(F.lit, BASES)), F.col("basis")), confidence_rank(F.col("confidence")))
    joined = lambda c, by: F.array_join(F.array_sort(F.collect_set(c)), by).alias(f"{c}s" if c != "evidence" else c)
    merged = every.groupBy("key").agg(F.min("name").alias("name"), F.min_by(F.struct("basis", "confidence"), order).alias("best"), joined("evidence", ";"), joined("manifest", ","), joined("ecosystem", ","), joined("framework", ","))
    above = every.select(F.col("key").alias("up")).distinct()
    parents = merged.select("key", F.inline(path_prefixes(parent_path(F.col("key"))))).join(above, F.col("root") == F.col("up")).groupBy(F.col("key").alias("k")).agg(F.max_by("root", "depth").alias("parent"))
    is_root = F.col("key") == own
    shown = merged.join(parents, F.col("key") == F.col("k"), "left")
    return shown.select(
        "key",
        F.coalesce("name", base_name(F.col("key"))).alias("name"),
        F.when(is_root, ".").otherwise(F.substring(F.col("key"), F.length(own) + 2, F.length("key"))).alias("display_path"),
        "best.basis",
        "best.confidence",
        "evidence",
        "manifests",
        "ecosystems",
        "frameworks",
        "parent",
    )
