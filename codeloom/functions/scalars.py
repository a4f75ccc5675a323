"""Scalar functions of the graph operators, as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Strongest first.
CONFIDENCE = ("exact", "resolved", "inferred", "unresolved")
CALLABLE_KINDS = ("function", "method", "constructor")


def confidence_rank(confidence: Column) -> Column:
    """0 for exact .. 3 for unresolved; unknown values and null rank with unresolved."""
    return F.when(confidence == "exact", 0).when(confidence == "resolved", 1).when(confidence == "inferred", 2).otherwise(3)


def confidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), rank + 1)


def weaker(a: Column, b: Column) -> Column:
    """The weaker of two confidences."""
    return confidence_name(F.greatest(confidence_rank(a), confidence_rank(b)))


def normalise_text(text: Column) -> Column:
    """Trimmed of all Unicode white space and lower-cased."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalise_identifier(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def name_segments(qualified: Column) -> Column:
    """Parts of a qualified name between . # : / and \\."""
    return F.filter(F.split(qualified, r"[.#:/\\]+"), lambda x: x != "")


def path_key(path: Column) -> Column:
    """Portable key of an absolute or relative path: forward slashes, no ``.`` or empty segments, ``..`` undone.

    A drive letter makes the key case-insensitive; ``..`` above the root stays in relative paths and
    vanishes in absolute ones.
    """
    p = forward_slashes(path)
    drive = p.rlike("^[A-Za-z]:")
    p = F.when(drive, F.lower(p)).otherwise(p)
    rooted = F.startswith(p, F.lit("/"))
    none = F.expr("CAST(array() AS array<string>)")

    def step(done: Column, part: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        up = part == ".."
        can_pop = (F.size(done) > 0) & (last != "..") & ~last.rlike("^[a-z]:$")
        return (
            F.when((part == "") | (part == "."), done)
            .when(up & can_pop, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(up & (rooted | drive), done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(p, "/"), none, step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def path_depth(key: Column) -> Column:
    return F.size(F.filter(F.split(key, "/"), lambda x: x != ""))


def path_prefixes(key: Column) -> Column:
    """The key and all its ancestors as structs (root, depth); equi-joins on them find owners segment by segment."""
    parts = F.filter(F.split(key, "/"), lambda x: x != "")
    lead = F.when(F.startswith(key, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.struct(F.concat(lead, F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("root"), n.alias("depth")))


def parent_path(key: Column) -> Column:
    return F.regexp_replace(key, "/[^/]*$", "")


def base_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


#: Directories below which a source area takes two segments.
TWO_SEGMENT_CONTAINERS = ("app", "apps", "lib", "packages", "services", "src")


def source_area(relative_path: Column) -> Column:
    """The direct child directory, or two segments under a container directory; null for files at the root."""
    parts = F.split(relative_path, "/")
    two = F.lower(parts[0]).isin(*TWO_SEGMENT_CONTAINERS) & (F.size(parts) > 2)
    return F.when(two, F.concat_ws("/", parts[0], parts[1])).when(F.size(parts) > 1, parts[0])


def encode_uri_component(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and ``- _ . ! ~ * ' ( )``."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def bounded_text(text: Column, limit: int, tail: bool = False) -> Column:
    """At most ``limit`` code points, the cut marked by an ellipsis at the end, or at the start for ``tail``."""
    cut = F.concat(F.lit("…"), F.right(text, F.lit(limit - 1))) if tail else F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def safe_label(text: Column, fallback: str) -> Column:
    shown = F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]+", " "))
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit(fallback))


# Absolute paths inside a text: POSIX, drive letter, network share.
HOST_PATHS = (r"(?:^|[:=(\s])/(?:[^/\s:]+/)+[^/\s:]*", r"(?:^|[:=(\s])[a-z]:/(?:[^/\s:]+/)*[^/\s:]*", r"(?i)(?:^|[:=(\s])//[a-z0-9._-]+/[a-z0-9._-]+")


def leaks_host_path(text: Column) -> Column:
    """whether a text, lower-cased and with forward slashes, shows an absolute path of the host."""
    t = forward_slashes(normalise_text(text))
    out = F.lit(False)
    for pattern in HOST_PATHS:
        out = out | t.rlike(pattern)
    return out


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def graphql_operation(qualified: Column) -> Column:
    """query, mutation, subscription or other, by the first segment of a qualified name."""
    head = F.lower(F.substring_index(qualified, ".", 1))
    return F.when(head.isin("query", "mutation", "subscription"), head).otherwise(F.lit("other"))


def range_span(start_line: Column, start_char: Column, end_line: Column, end_char: Column) -> Column:
    return (end_line - start_line) * 1_000_000 + (end_char - start_char)


def range_contains(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (outer_start <= inner_start) & (outer_end >= inner_end)


def range_overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def rounded(x: Column, decimals: int) -> Column:
    """Half up, as ``floor(x * 10**d + 0.5) / 10**d``."""
    scale = 10**decimals
    return F.floor(x * scale + 0.5) / scale
