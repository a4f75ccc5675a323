"""Resolution of calls: by scopes inside a file, and through imports whose names nothing may rebind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import kept

_ID = r"([A-Za-z_$][A-Za-z0-9_$]*)"
#: What a pattern's \\s stands for.
SPACES = " \t\n\x0b\f\r"
#: Kinds of symbols that calls may name.
CALLABLE_KINDS = ("function", "method", "constructor")


# --- names that a source line may bind --------------------------------------------------------------------


def _none() -> Column:
    return F.expr("CAST(array() AS array<string>)")


def _identifiers(text: Column) -> Column:
    return F.when(text != "", F.regexp_extract_all(text, F.lit(_ID), F.lit(1))).otherwise(_none())


def _one(text: Column) -> Column:
    """Its first identifier, as an array."""
    return F.slice(_identifiers(text), F.lit(1), F.lit(1))


def _found(text: Column, pattern: str) -> Column:
    """The first group of the first match; empty without one."""
    return F.regexp_extract(text, pattern, 1)


def _after(text: Column, word: str) -> Column:
    """The text behind the first whole word."""
    return _where(text, word, _found(text, rf"(?:^|[^A-Za-z0-9]){word}(?![A-Za-z0-9_])\s*(.*)$"))


def _brackets(text: Column) -> Column:
    return _where(text, "(", _found(text, r"^[^(]*\(([^)]*)\)"))


def _union(*parts: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*parts)))


def _where(text: Column, sign: str, found: Column) -> Column:
    """``found`` of texts that hold ``sign``, without which it is empty: most lines are spared the pattern."""
    return F.when(text.contains(sign), found).otherwise("")


def _javascript(lines: DataFrame) -> DataFrame:
    """(path, line, names) that a line of JavaScript or TypeScript may declare, assign or take as parameters."""
    outside = r"""^((?:[^'"`/]|'(?:\\.|[^'\\])*(?:'|$)|"(?:\\.|[^"\\])*(?:"|$)|`(?:\\.|[^`\\])*(?:`|$)|/(?!/))*+)//.*$"""
    bare = F.when(F.col("code").contains("//"), F.regexp_replace("code", outside, "$1")).otherwise(F.col("code"))
    code = lines.withColumn("code", F.btrim(bare, F.lit(SPACES)))
    # Columns of their own, so that each is worked out once.
    parts = code.withColumns(
        {
            **{w: _after(F.col("code"), w) for w in ("const", "let", "var", "function", "class")},
            "brackets": _brackets(F.col("code")),
            "before_arrow": _where(F.col("code"), "=>", F.regexp_replace(_found(F.col("code"), r"^(.*?)=>"), r"\s+$", "")),
        }
    ).withColumn("parameters", F.when(F.col("before_arrow").rlike(r"^[^(]*\([^)]*\)"), _brackets(F.col("before_arrow"))).otherwise(F.col("before_arrow")))
    bound = [
        *[_identifiers(F.split_part(w, F.lit("="), F.lit(1))) for w in ("const", "let", "var")],
        *[_one(F.col(w)) for w in ("function", "class")],
        F.when(F.col("code").contains("function") | F.col("code").startswith("catch"), _identifiers(F.col("brackets"))).otherwise(_none()),
        _identifiers(F.col("parameters")),
        _identifiers(_where(F.col("code"), "=", _found(F.col("code"), r"^([A-Za-z_$][A-Za-z0-9_$]*)\s*=(?!=)"))),
    ]
    imported = _identifiers(F.split_part(F.regexp_replace("code", "^import ", ""), F.lit(" from "), F.lit(1)))
    return parts.select("path", "line", F.when(F.col("code").startswith("import "), imported).otherwise(_union(*bound)).alias("names"))


def _python(lines: DataFrame) -> DataFrame:
    """(path, line, names) that a line of Python code, without comments and strings, may bind."""
    code = lines.withColumn("code", F.btrim("code", F.lit(SPACES)))
    declaration = F.regexp_replace("code", "^async ", "")
    parts = code.withColumns({"defined": _where(declaration, "def ", _found(declaration, r"^def (.*)$")), "classed": _where(declaration, "class ", _found(declaration, r"^class (.*)$")), "pieces": F.split("code", " as ")})
    aliases = F.filter(F.transform(F.slice("pieces", F.lit(2), F.size("pieces")), lambda p: F.regexp_extract(p, _ID, 1)), lambda x: x != "")
    bound = [
        _one(F.col("defined")),
        _identifiers(_brackets(F.col("defined"))),
        _one(F.col("classed")),
        _identifiers(F.split_part(_where(F.col("code"), "for ", _found(F.col("code"), r"^for (.*)$")), F.lit(" in "), F.lit(1))),
        F.when(F.col("code").rlike("^(with|except) "), aliases).otherwise(_none()),
        _identifiers(_where(F.col("code"), "=", _found(F.col("code"), r"^(.*?)(?<![=!<>])=(?!=)"))),
        _identifiers(_where(F.col("code"), ":", _found(F.col("code"), r"^([A-Za-z_$][A-Za-z0-9_$]*)\s*:"))),
    ]
    return parts.select("path", "line", F.when(F.col("code").rlike("^(import|from) "), _identifiers(F.col("code"))).otherwise(_union(*bound)).alias("names"))


def possible_bindings(lines: DataFrame) -> DataFrame:
    """(path, line, name), one row for each name that a line of source may bind.  ``lines`` has path, language, line and code."""
    own = lines.select("path", "language", "line", "code")
    both = _javascript(own.filter(F.col("language").isin("javascript", "typescript"))).unionByName(_python(own.filter("language = 'python'")))
    # Other than explode, of which Spark infers a filter that spells the whole pattern out again, and in code too long to compile.
    return both.select("path", "line", F.explode_outer("names").alias("name")).filter("name IS NOT NULL")


# --- imported calls -----------------------------------------------------------------------------------------


def single_imports(imports: DataFrame) -> DataFrame:
    """Named imports that are the only ones of their local name in a file.

    ``imports`` has path, import_line, local_name, target_path and imported_name.
    """
    return imports.groupBy("path", "local_name").agg(F.count(F.lit(1)).alias("many"), *[F.first(c).alias(c) for c in ("import_line", "target_path", "imported_name")]).filter("many = 1").drop("many")


def unshadowed(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows (path, local_name, import_line, ...) whose name no other line of the file may bind.

    Of the lines' names only those that rows ask for meet them; ``rows`` are used twice.
    """
    asked = rows.select(F.col("path").alias("asked_path"), F.col("local_name").alias("asked_name")).distinct()
    bound = possible_bindings(lines).select(F.col("path").alias("p"), F.col("line").alias("l"), "name")
    met = bound.join(asked, (F.col("p") == F.col("asked_path")) & (F.col("name") == F.col("asked_name")), "left_semi")
    return rows.join(met, (F.col("path") == F.col("p")) & (F.col("local_name") == F.col("name")) & (F.col("import_line") != F.col("l")), "left_anti")


def top_level_callables(nodes: DataFrame) -> DataFrame:
    """(file_path, name, target_id): functions that their file owns, where no other has their name."""
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("file_id"), F.col("file_path").alias("fp"))
    own = nodes.filter("kind = 'function' AND qualified_name = name").join(files, (F.col("file_path") == F.col("fp")) & (F.col("parent_id") == F.col("file_id")))
    return own.groupBy("file_path", "name").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("target_id")).filter("many = 1").drop("many")


def resolve_imported_calls(edges: DataFrame, nodes: DataFrame, imports: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, target_id) of unresolved bare calls whose name is a unique import, rebound nowhere, of a unique top-level function.

    ``edges`` has id, kind, source_id, target_id, confidence and file_path; ``nodes`` also parent_id.
    """
    open_ = edges.filter("kind = 'calls' AND confidence = 'unresolved'").select("id", "source_id", F.col("target_id").alias("external"), F.col("file_path").alias("edge_path"))
    bare = nodes.filter((F.col("kind") == "external") & (F.col("name") == F.col("qualified_name")) & F.col("name").rlike(f"^{_ID}$")).select(F.col("id").alias("x"), F.col("name").alias("called"))
    # Few names are bare and few calls are left after each step, which files tell to what follows.
    named = open_.join(kept(bare, clear=True), F.col("external") == F.col("x")).select("id", "source_id", "edge_path", "called")
    through = kept(named.join(single_imports(imports), (F.col("edge_path") == F.col("path")) & (F.col("called") == F.col("local_name"))).drop("edge_path", "called"), clear=True)
    aimed = through.join(top_level_callables(nodes), (F.col("target_path") == F.col("file_path")) & (F.col("imported_name") == F.col("name"))).select("id", "source_id", "path", "local_name", "import_line", "target_id")
    sources = nodes.select(F.col("id").alias("s"), F.col("file_path").alias("source_path"))
    own = kept(aimed.join(sources, (F.col("source_id") == F.col("s")) & (F.col("path") == F.col("source_path"))).select("id", "path", "local_name", "import_line", "target_id"), clear=True)
    return unshadowed(own, lines).select("id", "target_id")


def with_resolved_calls(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """The edges, those of ``resolved`` pointing to what was found."""
    found = kept(resolved.select(F.col("id").alias("r"), F.col("target_id").alias("found")), clear=True)
    joined = edges.join(found, F.col("id") == F.col("r"), "left")
    return joined.select(*[F.coalesce("found", c).alias(c) if c == "target_id" else F.when(F.col("found").isNotNull(), F.lit("resolved")).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in edges.columns])


# --- calls by scope -------------------------------------------------------------------------------------------


def _tries(language: Column, scope: Column, qualifier: Column, name: Column) -> Column:
    """[(rank, qualified name)] that a call may mean, best first; ``scope`` is an array of names, outermost first."""
    n = F.size(scope)
    under = lambda k, tail: F.when(k == 0, tail).otherwise(F.concat_ws(".", F.array_join(F.slice(scope, F.lit(1), k), "."), tail))
    # The scope's prefixes from the longest of ``most`` names to the shortest of ``least``.
    ladder = lambda most, least, tail, first: F.when(most >= least, F.transform(F.sequence(most, F.lit(least), F.lit(-1)), lambda k: F.struct((most - k + first).alias("rank"), under(k, tail).alias("qualified"))))
    none = F.expr("CAST(array() AS array<struct<rank: int, qualified: string>>)")
    whole = F.concat_ws(".", qualifier, name)
    exact = lambda rank: F.array(F.struct(rank.alias("rank"), whole.alias("qualified")))
    script, relative = language != "python", F.when(language == "python", qualifier.isin("self", "cls")).otherwise(qualifier == "this")
    inner = n - 1
    return (
        F.when(qualifier.isNull(), ladder(n, 0, name, 0))
        .when(relative & script, F.coalesce(ladder(inner, 1, name, 0), none))
        .when(relative, F.concat(F.coalesce(ladder(inner, 1, name, 0), none), exact(n)))
        .when(script, F.concat(exact(F.lit(0)), F.coalesce(ladder(inner, 1, whole, 1), none)))
        .otherwise(exact(F.lit(0)))
    )


def resolve_scoped_calls(calls: DataFrame, symbols: DataFrame, lexical: DataFrame) -> DataFrame:
    """(call_id, target_id, confidence) of every call.

    A bare call means the callable of its name in the innermost scope around it, else the only callable of that name
    in its file (``inferred``), unless a local of its function has the name (``lexical``: source_id, name).  A call on ``this``,
    ``self`` or ``cls`` looks through the scopes inside the file's outermost; other qualified calls mean what they
    spell, in JavaScript also inside the scopes around.  ``calls`` has call_id, file_path, language, source_id, scope
    (dotted), qualifier (null for bare calls) and name; ``symbols`` id, file_path, kind, name, qualified_name and ord.

    Scopes become a few equi-join keys a call with their ranks; of several symbols of one qualified name the first in the file's order counts.
    """
    callables = symbols.filter(F.col("kind").isin(*CALLABLE_KINDS))
    first = callables.groupBy(F.col("file_path").alias("p"), F.col("qualified_name").alias("q")).agg(F.min_by("id", F.struct("ord", "id")).alias("found"))
    only = callables.groupBy(F.col("file_path").alias("p"), F.col("name").alias("q")).agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("found")).filter("many = 1").drop("many")
    hidden = lexical.select(F.col("source_id").alias("hs"), F.col("name").alias("hn")).distinct()
    open_ = calls.join(hidden, F.col("qualifier").isNull() & (F.col("source_id") == F.col("hs")) & (F.col("name") == F.col("hn")), "left_anti")
    scope = F.when(F.col("scope") == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split("scope", r"\."))
    tried = open_.select("call_id", "file_path", F.inline(_tries(F.col("language"), scope, F.col("qualifier"), F.col("name"))))
    scoped = tried.join(first, (F.col("file_path") == F.col("p")) & (F.col("qualified") == F.col("q"))).select("call_id", "rank", "found", F.lit("resolved").alias("how"))
    by_name = open_.filter("qualifier IS NULL").join(only, (F.col("file_path") == F.col("p")) & (F.col("name") == F.col("q"))).select("call_id", F.lit(1 << 30).alias("rank"), "found", F.lit("inferred").alias("how"))
    best = scoped.unionByName(by_name).groupBy(F.col("call_id").alias("c")).agg(F.min_by(F.struct("found", "how"), "rank").alias("best"))
    return calls.join(best, F.col("call_id") == F.col("c"), "left").select("call_id", F.col("best.found").alias("target_id"), F.coalesce("best.how", F.lit("unresolved")).alias("confidence"))
