"""License scans (operator 4), in DataFrame functions only.

Base: the places where a license phrase's words stand consecutively.  They are found in the
text of lower-cased words joined by single spaces, by byte search.

Method: an exact set-similarity join between license templates and text blocks.  Blocks are bounded,
so that words far apart are no statement: for a template of n words, the lines of up to 2n words and, wherever
lines are longer or statements wrapped, all windows of 2n words at steps of n/2 over the whole text, so that
n words and up to n/2 between them lie whole in one.  A block
matches a template when it holds at least ``threshold`` of the template's distinct words.  The
words of all templates are ordered by how many documents hold them, rarest first.  A block that
matches must hold a word of the template's prefix (its first ``size - need + 1`` words in that
order), must have ``need`` words at least, and from its first prefix match on, both sides must
have words enough left; whatever passes is verified on full sets.  Documents that lack the words
for any template are left out beforehand, which is exact, as a block's words are its document's;
a document has windows for those templates only whose words it holds.
The texts are read once; what the join needs of them is stored.

Templates are a parameter of the caller and not data, so their words and prefixes are broadcast.

Defined results: null texts have no words; an empty table gives an empty result; a document
without words has score 0 and empty labels; repeated rows give equal rows; rows that share an
identifier are told apart by their text; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Label and phrase of the base search.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Label and wording of license statements; sentences of the public license texts and notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)
THRESHOLD = 0.8

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced_words(text: Column) -> Column:
    """The lower-cased words, each with a space on both sides; neighbours share it.

    ``lower`` changes letters beyond A-Z too, but never into ASCII once the Kelvin sign is out of
    the way, so word borders, ASCII words and phrase places are those of lower-casing A-Z alone.
    """
    kept = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("κ"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(kept), _SEPARATORS, " ")), F.lit(" "))


def _count(of: Column, text: str) -> Column:
    return F.octet_length(of) - F.octet_length(F.replace(of, F.lit(text), F.lit("")))


def _need(words: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * words - 1e-9))


def _templates(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, list[str]]]:
    return [(n, label, sorted(set(_WORD.findall(text.lower())))) for n, (label, text) in enumerate(templates)]


def _lengths(templates: tuple[tuple[str, str], ...]) -> list[int]:
    return [max(1, len(_WORD.findall(text.lower()))) for _, text in templates]


def _base_columns(phrases: tuple[tuple[str, str], ...]) -> list[Column]:
    """n_words, n_base, first_word, last_word and base labels, from the column ``spaced``."""
    inner = F.col("spaced")
    n_words = F.when(inner == "  ", F.lit(0)).otherwise(_count(inner, " ") - 1).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for label, phrase in phrases:
        spaced = f" {phrase} "
        found = F.contains(inner, F.lit(spaced))
        counts.append(F.when(found, F.regexp_count(inner, F.lit(f"(?<= ){re.escape(phrase)}(?= )"))).otherwise(0))
        firsts.append(F.when(found, _count(F.substring(inner, F.lit(1), F.instr(inner, spaced) - 1), " ")))
        back = F.reverse(inner)
        after = _count(F.substring(back, F.lit(1), F.instr(back, spaced[::-1]) - 1), " ")
        lasts.append(F.when(found, n_words - after - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    least = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    most = F.greatest(*lasts) if len(lasts) > 1 else lasts[0]
    return [
        n_words.alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        least.cast("long").alias("first_word"),
        most.cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    ]


def _scanned(docs: DataFrame, known: list[tuple[int, str, list[str]]], phrases: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """One pass over the texts: base columns, the template words held, and of documents that hold enough for some templates these, the lines, and the words."""
    vocabulary = sorted({w for _, _, words in known for w in words})
    texts = docs.select("id", "key", "text", spaced_words(F.col("text")).alias("spaced"))
    held = F.array_intersect(F.split(F.col("spaced"), " "), F.array(*map(F.lit, vocabulary)))
    with_words = texts.select("id", "key", "text", "spaced", *_base_columns(phrases), held.alias("held"))
    least = min(_need(len(words), threshold) for _, _, words in known)
    enough = [F.when(F.size(F.array_intersect("held", F.array(*map(F.lit, words)))) >= _need(len(words), threshold), F.lit(n)) for n, _, words in known]
    with_met = with_words.withColumn("met", F.when(F.size("held") >= least, F.array_compact(F.array(*enough))))
    some = F.coalesce(F.size("met") > 0, F.lit(False))
    blocks = F.when(some, F.array_distinct(F.split("text", r"\n+")))
    words = F.when(some, F.split(F.trim("spaced"), " "))
    return stored(with_met.withColumns({"blocks": blocks, "words": words}).drop("text", "spaced"), "license-scan")


def _windows(scanned: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, key, only, words): the windows of texts, each for the template ``only``."""
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("only") + 1)
    width, step = of([2 * n for n in lengths]), of([max(1, n // 2) for n in lengths])
    each = scanned.filter(F.col("words").isNotNull()).select("id", "key", F.explode("met").alias("only"), "words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + step), step)
    windows = F.transform(starts, lambda at: F.slice("words", at, width))
    return each.select("id", "key", "only", F.explode(windows).alias("words"))


def template_matches(scanned: DataFrame, known: list[tuple[int, str, list[str]]], lengths: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, label, containment) of every block of every document that meets a template."""
    counts = scanned.select(F.explode("held").alias("word")).groupBy("word").count()
    rank = {r["word"]: r["count"] for r in counts.collect()}  # at most one row per template word
    vocabulary = {w for _, _, words in known for w in words}
    order = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (rank.get(w, 0), w)))}
    plans = [(n, label, sorted(words, key=order.__getitem__), _need(len(words), threshold)) for n, label, words in known]
    blocks = scanned.filter(F.col("blocks").isNotNull()).select("id", "key", F.explode("blocks").alias("block"))
    ranks = F.create_map(*[x for w, n in order.items() for x in (F.lit(w), F.lit(n))])
    words = F.filter(F.split(spaced_words(F.col("block")), " "), lambda w: w != "")
    lines = blocks.select("id", "key", F.lit(None).cast("int").alias("only"), words.alias("words"))
    both_kinds = lines.unionByName(_windows(scanned, lengths)).withColumn("long", F.size("words")).filter(F.col("only").isNotNull() | (F.col("long") <= 2 * max(lengths)))
    blocks = both_kinds.withColumn("words", F.array_distinct("words")).select("id", "key", "only", "long", F.size("words").alias("size"), F.array_sort(F.filter(F.transform("words", lambda w: F.element_at(ranks, w)), lambda r: r.isNotNull())).alias("ranks"))
    index = scanned.sparkSession.createDataFrame(
        [(order[w], i, n, label, [order[x] for x in words], need, 2 * lengths[n]) for n, label, words, need in plans for i, w in enumerate(words[: len(words) - need + 1])],
        "word int, at int, template int, label string, template_ranks array<int>, need int, widest int",
    )
    probes = blocks.select("id", "key", "only", "long", "size", "ranks", F.posexplode("ranks").alias("position", "word"))
    both = probes.join(F.broadcast(index), "word").filter("CASE WHEN only IS NULL THEN long <= widest ELSE only = template END")  # the prefixes of the templates
    left = F.lit(1) + F.least(F.size("template_ranks") - F.col("at") - 1, F.size("ranks") - F.col("position") - 1)
    seen = F.size(F.array_intersect(F.slice("ranks", F.lit(1), F.col("position")), F.slice("template_ranks", F.lit(1), F.col("at"))))
    candidates = both.filter((F.col("size") >= F.col("need")) & (seen == 0) & (left >= F.col("need")))
    common = F.size(F.array_intersect("ranks", "template_ranks"))
    return candidates.filter(common >= F.col("need")).select("id", "key", "label", (common / F.size("template_ranks")).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: phrase places, their first and last word, labels of both searches, score."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    known = _templates(templates)
    base = _scanned(rows, known, phrases, threshold)
    more = template_matches(base, known, _lengths(templates), threshold).groupBy("id", "key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment")).withColumnsRenamed({"id": "more_id", "key": "more_key"})
    both = base.join(more, F.col("id").eqNullSafe(F.col("more_id")) & (F.col("key") == F.col("more_key")), "left")
    return both.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("more", F.expr("CAST(array() AS array<string>)"))))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
