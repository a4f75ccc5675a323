"""Symbols, imports and calls of Python sources, one task per share of the files.

Files are parsed where they are read; a file that does not parse becomes a diagnostic row and stops
nothing.  Resolution across files is left to joins.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

FACTS = "path string, fact string, kind string, name string, scope string, line int, end_line int, detail string"


def python_facts(path: str, content: str) -> Iterator[tuple]:
    """(path, fact, kind, name, scope, line, end_line, detail); facts are symbol, import, call and diagnostic."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield path, "diagnostic", "analysis.fileFailed", type(e).__name__, "", getattr(e, "lineno", None) or 0, 0, str(e)[:200]
        return
    stack: list[tuple[ast.AST, str, bool]] = [(tree, "", False)]
    while stack:
        node, scope, inside = stack.pop()
        for child in ast.iter_child_nodes(node):
            where, called = scope, inside
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                where = f"{scope}.{child.name}" if scope else child.name
                yield path, "symbol", "class" if is_class else "function", child.name, where, child.lineno, child.end_lineno, ""
                called = inside or not is_class
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield path, "import", "module", a.asname or a.name.split(".")[0], scope, child.lineno, child.end_lineno, a.name
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield path, "import", "name", a.asname or a.name, scope, child.lineno, child.end_lineno, "." * child.level + (child.module or "") + ":" + a.name
            elif isinstance(child, ast.Call) and inside:
                name = ast.unparse(child.func) if isinstance(child.func, ast.Name | ast.Attribute) else ""
                if name:
                    yield path, "call", "qualified" if "." in name else "bare", name, scope, child.lineno, child.end_lineno, ""
            stack.append((child, where, called))


def extract(files: DataFrame) -> DataFrame:
    """The facts of all Python files.  ``files`` has path, language and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [f for p, c in zip(batch["path"], batch["content"], strict=True) for f in python_facts(p, c or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.filter(F.col("language") == "python").select("path", "content").mapInPandas(run, FACTS)


def symbols(facts: DataFrame) -> DataFrame:
    """Nodes with stable ids."""
    node_id = F.concat_ws("::", F.lit("symbol"), "path", "kind", "scope", F.col("line").cast("string"))
    return facts.filter("fact = 'symbol'").select(node_id.alias("id"), "kind", "name", F.col("scope").alias("qualified_name"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), "end_line")


def resolve_calls(facts: DataFrame) -> DataFrame:
    """Call edges; a call finds its target in the innermost scope outward, then by a unique name of the file, then through a unique import.

    Scopes are exploded into prefixes, so the ladder is a few equi-joins and one smallest rank.
    """
    known = symbols(facts)
    calls = facts.filter("fact = 'call'").select("path", "scope", "name", "line")
    # The caller: the innermost callable around the call is its scope.
    callers = known.select(F.col("id").alias("source_id"), F.col("file_path").alias("cp"), F.col("qualified_name").alias("cq"))
    calls = calls.join(callers, (F.col("path") == F.col("cp")) & (F.col("scope") == F.col("cq"))).drop("cp", "cq")
    calls = calls.withColumn("call_id", F.concat_ws("::", F.lit("edge"), F.lit("calls"), "source_id", "name", F.col("line").cast("string"))).dropDuplicates(["call_id"])
    parts = F.split("scope", r"\.")
    bare = F.regexp_replace("name", r"^(self|cls)\.", "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.concat_ws(".", F.array_join(F.slice(parts, F.lit(1), n), "."), bare).alias("qualified")))
    tried = calls.select("call_id", "path", F.inline(prefixes)).withColumn("qualified", F.regexp_replace("qualified", r"^\.", ""))
    own = known.select(F.col("file_path").alias("p"), F.col("qualified_name").alias("q"), F.col("id").alias("target_id"))
    first = Window.partitionBy("p", "q").orderBy("target_id")
    own = own.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    scoped = tried.join(own, (F.col("path") == F.col("p")) & (F.col("qualified") == F.col("q"))).select("call_id", (-F.col("depth")).alias("rank"), "target_id", F.lit("resolved").alias("confidence"))
    unique = known.groupBy(F.col("file_path").alias("p"), F.col("name").alias("n")).agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("target_id")).filter("many = 1")
    by_name = calls.join(unique, (F.col("path") == F.col("p")) & (bare == F.col("n"))).select("call_id", F.lit(1).alias("rank"), "target_id", F.lit("inferred").alias("confidence"))
    imports = facts.filter("fact = 'import' AND kind = 'name'").select(F.col("path").alias("ip"), F.col("name").alias("local"), F.translate(F.regexp_replace(F.split_part("detail", F.lit(":"), F.lit(1)), r"^\.+", ""), ".", "/").alias("module"), F.split_part("detail", F.lit(":"), F.lit(2)).alias("imported"))
    single = imports.groupBy("ip", "local").agg(F.count(F.lit(1)).alias("many"), F.min("module").alias("module"), F.min("imported").alias("imported")).filter("many = 1")
    top = known.filter("qualified_name = name").select(F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.py$", "").alias("last"), F.regexp_replace("file_path", r"(/__init__)?\.py$", "").alias("module_path"), "name", F.col("id").alias("target_id"))
    top = top.groupBy("last", "module_path", "name").agg(F.min("target_id").alias("target_id"), F.count(F.lit(1)).alias("defined")).filter("defined = 1")
    reached = single.join(top, (F.substring_index("module", "/", -1) == F.col("last")) & (F.col("imported") == F.col("name")) & F.endswith("module_path", F.col("module")))
    reached = reached.groupBy("ip", "local").agg(F.count(F.lit(1)).alias("homes"), F.min("target_id").alias("target_id")).filter("homes = 1")
    imported = calls.join(reached, (F.col("path") == F.col("ip")) & (F.col("name") == F.col("local"))).select("call_id", F.lit(2).alias("rank"), "target_id", F.lit("resolved").alias("confidence"))
    best = scoped.unionByName(by_name).unionByName(imported).groupBy("call_id").agg(F.min_by(F.struct("target_id", "confidence"), F.struct("rank", "target_id")).alias("best"))
    joined = calls.join(best, "call_id", "left")
    missing = F.concat_ws("::", F.lit("external"), "path", "name")
    return joined.select(F.col("call_id").alias("id"), F.lit("calls").alias("kind"), "source_id", F.coalesce("best.target_id", missing).alias("target_id"), F.coalesce("best.confidence", F.lit("unresolved")).alias("confidence"), F.col("line").alias("start_line"))
