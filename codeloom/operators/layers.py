"""Architectural layers of functions, by where their source stands and what framework units they are bound to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Directory segments and unit kinds of each layer.
TEST_DIRECTORIES = ("test", "tests", "__tests__", "spec", "specs")
INTERFACE_DIRECTORIES = ("presentation", "controllers", "routes", "resolvers")
APPLICATION_DIRECTORIES = ("application", "usecase", "usecases")
DATA_DIRECTORIES = ("persistence", "dao", "database", "databases", "orm")
INFRASTRUCTURE_DIRECTORIES = ("infrastructure", "infra", "clients", "gateways", "bootstrap", "config", "configuration")
CROSS_CUTTING_DIRECTORIES = ("middleware", "middlewares", "interceptors", "observability", "telemetry", "logging")
INTERFACE_UNITS = ("route", "operation", "controller", "view", "serializer", "component", "command")
DATA_UNITS = ("repository", "model", "entity")
INFRASTRUCTURE_UNITS = ("app", "configuration", "module")
TEST_FILE_NAMES = (r"(^|\.)test\.[^.]+$", r"(^|\.)spec\.[^.]+$", r"^test_.+\.py$", r"_test\.py$")
# Order of layers in evidence lists.
LAYERS = ("interface", "application", "domain", "dataAccess", "infrastructure", "crossCutting", "test", "unclassified")


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda x: x != "")


def _after_last(parts: Column, word: str) -> Column:
    """The segments after the last ``word``; null without one."""
    from_end = F.array_position(F.reverse(parts), F.lit(word)).cast("int")
    return F.when(from_end > 0, F.slice(parts, F.size(parts) - from_end + 2, F.greatest(from_end - 1, F.lit(0))))


def path_layer(path: Column) -> Column:
    """The layer of the first rule that the path meets, ``unclassified`` for none.

    Rules in their fixed order: tests, adapters by their direction, domain, application, data access,
    interface, cross-cutting, infrastructure; an infrastructure path with a repository is data access.
    """
    parts = _parts(path)
    has = lambda words: F.arrays_overlap(parts, F.array(*map(F.lit, words)))
    name = F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1), F.lit(""))
    test = has(TEST_DIRECTORIES)
    for pattern in TEST_FILE_NAMES:
        test = test | name.rlike(pattern)
    direction = F.try_element_at(_after_last(parts, "adapters"), F.lit(1))
    return (
        F.when(test, "test")
        .when(direction == "in", "interface")
        .when(direction == "out", "infrastructure")
        .when(F.array_contains(parts, "domain"), "domain")
        .when(has(APPLICATION_DIRECTORIES), "application")
        .when(has(DATA_DIRECTORIES), "dataAccess")
        .when(has(INTERFACE_DIRECTORIES), "interface")
        .when(has(CROSS_CUTTING_DIRECTORIES), "crossCutting")
        .when(has(INFRASTRUCTURE_DIRECTORIES), F.when(has(("repository", "repositories")), "dataAccess").otherwise("infrastructure"))
        .otherwise("unclassified")
    )


def is_domain_port(path: Column) -> Column:
    """Whether a domain path is a port or repository contract, which is no business rule."""
    parts = _parts(path)
    tail = _after_last(parts, "domain")
    return (path_layer(path) == "domain") & F.coalesce(F.arrays_overlap(tail, F.array(F.lit("ports"), F.lit("repositories"))), F.lit(False))


def unit_layer(unit_kind: Column) -> Column:
    """The layer that a bound framework unit speaks for; null for kinds that tell nothing."""
    return (
        F.when(unit_kind.isin(*INTERFACE_UNITS), "interface")
        .when(unit_kind == "service", "application")
        .when(unit_kind.isin(*DATA_UNITS), "dataAccess")
        .when(unit_kind == "middleware", "crossCutting")
        .when(unit_kind.isin(*INFRASTRUCTURE_UNITS), "infrastructure")
    )


def assess(functions: DataFrame, bindings: DataFrame) -> DataFrame:
    """(id, layer, conflicted, business) of every function.

    ``functions`` has id and file_path, ``bindings`` function_id and unit_kind.  A test source is decisive;
    else one layer among all evidence is the function's, several conflict and leave it unclassified.
    """
    own = functions.select("id", path_layer(F.col("file_path")).alias("by_path"), is_domain_port(F.col("file_path")).alias("port"))
    by_unit = bindings.select("function_id", unit_layer(F.col("unit_kind")).alias("l")).filter("l IS NOT NULL").groupBy("function_id").agg(F.collect_set("l").alias("by_units"))  # eight layers at most
    none = F.expr("CAST(array() AS array<string>)")
    joined = own.join(by_unit, F.col("id") == F.col("function_id"), "left")
    path_evidence = F.when(F.col("by_path") == "unclassified", none).otherwise(F.array("by_path"))
    layers = F.when(F.col("by_path") == "test", F.array("by_path")).otherwise(F.array_union(path_evidence, F.coalesce("by_units", none)))
    layer = F.when(F.size("layers") == 1, F.element_at("layers", 1)).otherwise(F.lit("unclassified"))
    business = F.when(F.col("port"), "notBusinessLogic").when(F.col("layer") == "domain", "domainRuleCandidate").when(F.col("layer") == "application", "applicationWorkflowCandidate")
    return joined.select("id", "port", layers.alias("layers")).select("id", "port", layer.alias("layer"), (F.size("layers") > 1).alias("conflicted")).select("id", "layer", "conflicted", business.alias("business"))


def layer_summary(assessed: DataFrame) -> DataFrame:
    """Callables in all, classified, business candidates and conflicted ones, one row."""
    return assessed.agg(
        F.count(F.lit(1)).alias("callables"),
        F.count_if(F.col("layer") != "unclassified").alias("classified"),
        F.count_if(F.col("business").isin("domainRuleCandidate", "applicationWorkflowCandidate")).alias("business"),
        F.count_if("conflicted").alias("conflicted"),
    )
