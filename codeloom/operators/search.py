"""Ranked function search with exact totals and signed page cursors."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import forward_slashes, normalise_text
from .selection import running_total

PAGE_LIMIT = 100


def _match(text: Column, query: str, exact: int, prefix: int, inside: int) -> Column:
    """Literal matching; the query is never a pattern."""
    q = F.lit(query)
    return F.when(text == q, exact).when(F.startswith(text, q), prefix).when(F.contains(text, q), inside).otherwise(0)


def scored(functions: DataFrame, query: str) -> DataFrame:
    """K4, K5: functions that match, with their score and relevance.

    Name, qualified name and path are matched apart and the best counts.
    """
    q = query.strip().lower()
    score = F.greatest(
        _match(normalise_text(F.col("name")), q, 600, 500, 400),
        _match(normalise_text(F.col("qualified_name")), q, 550, 450, 350),
        _match(forward_slashes(normalise_text(F.col("file_path"))), q.replace("\\", "/"), 325, 300, 250),
    )
    role = F.when(F.col("role") == "entrypoint", 100).when(F.col("role") == "utility", 25).otherwise(0)
    relevance = role + F.col("callers") * 4 + F.col("callees") * 3 + F.col("unresolved_calls") * 2 + F.col("external_calls")
    found = functions.withColumns({"score": score, "relevance": relevance.cast("long")})
    return found.filter("score > 0") if q else found


def ranked(found: DataFrame) -> DataFrame:
    """K6: matches in their total order, numbered from 1."""
    order = [F.desc("score"), F.desc("relevance"), *[F.asc(c) for c in ("name", "qualified_name", "file_path", "start_line", "id")]]
    return running_total(found, order, F.lit(1), "position")


def top(found: DataFrame, limit: int = PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """A page by a bounded sort, with the exact number of matches and of matches left out."""
    limit = max(0, min(int(limit), PAGE_LIMIT))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    order = [F.desc("score"), F.desc("relevance"), "name", "qualified_name", "file_path", "start_line", "id"]
    page = found.orderBy(*order).offset(offset).limit(limit) if offset else found.orderBy(*order).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("omitted", F.greatest(F.col("total") - (offset + limit), F.lit(0)))


class Cursor:
    """K7: an opaque page position that proves which query and graph it belongs to."""

    VERSION = 1

    def __init__(self, query: str, graph_version: str, limit: int) -> None:
        self.signature = json.dumps([query, graph_version, limit])

    def _proof(self, offset: int) -> str:
        return hashlib.sha256(f"{self.signature}\0{offset}".encode()).hexdigest()[:24]

    def at(self, offset: int) -> str:
        told = json.dumps({"version": self.VERSION, "offset": offset, "proof": self._proof(offset)})
        return base64.urlsafe_b64encode(told.encode()).decode().rstrip("=")

    def offset(self, cursor: str) -> int | None:
        """The position, or None for a cursor that was tampered with or belongs elsewhere."""
        try:
            told = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
            offset = told["offset"]
            good = told["version"] == self.VERSION and isinstance(offset, int) and offset >= 0 and told["proof"] == self._proof(offset)
        except (ValueError, KeyError, TypeError):
            return None
        return offset if good else None


def page(found: DataFrame, query: str, graph_version: str, limit: int = PAGE_LIMIT, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """One page and the cursor of the next; a bad cursor gives a last, empty page."""
    limit = max(1, min(int(limit), PAGE_LIMIT))
    signed = Cursor(query, graph_version, limit)
    offset = 0 if cursor is None else signed.offset(cursor)
    if offset is None:
        return found.limit(0), None
    rows = top(found, limit, offset)
    more = found.count() > offset + limit
    return rows, signed.at(offset + limit) if more else None
