"""Metadata queries: a conjunction of predicates over one namespace, an order, pages.

A query becomes one plan, ``where`` then ``orderBy`` then ``limit``: Catalyst
prunes namespace partitions and pushes scalar predicates to the scan.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.functions.attributes import in_range

#: Sort fields by name; any other sorts by creation time.
SORTS = {"SizeBytes": "size_bytes", "ObjectKey": "object_key", "ModifiedAt": "modified_at", "ContentHash": "content_hash", "CreatedAt": "created_at"}
PAGE = 100


@dataclass(frozen=True)
class AttributeRange:
    name: str
    low: object = None
    high: object = None


@dataclass(frozen=True)
class Query:
    """Dimensions are AND-ed; a list is an IN, and an empty list matches nothing; ranges include their ends, None is open."""

    namespace: str | None = ""
    key_prefix: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    attribute_ranges: Sequence[AttributeRange] = ()
    tiers: Sequence[str] | None = None
    states: Sequence[str] | None = None
    created: tuple[datetime | None, datetime | None] | None = None
    modified: tuple[datetime | None, datetime | None] | None = None
    size: tuple[int | None, int | None] | None = None
    sort: str = "CreatedAt"
    descending: bool = False
    page_size: int = PAGE
    cursor: str | None = None

    def predicates(self) -> list[Column]:
        """One for each dimension, tag and attribute range, in a fixed order."""
        out = []
        if self.key_prefix is not None:
            out.append(F.col("object_key").startswith(self.key_prefix))
        out += [F.col("tags")[k] == v for k, v in self.tags.items()]
        out += [in_range(F.col("attributes"), r.name, r.low, r.high) for r in self.attribute_ranges]
        out += [F.col(c).isin(list(values)) for c, values in (("tier", self.tiers), ("state", self.states)) if values is not None]
        for c, ends in (("created_at", self.created), ("modified_at", self.modified), ("size_bytes", self.size)):
            if ends is not None:
                out += [F.col(c) >= ends[0]] if ends[0] is not None else []
                out += [F.col(c) <= ends[1]] if ends[1] is not None else []
        return out

    def matches(self) -> Column:
        """The whole conjunction; ``namespace=None`` asks in all namespaces."""
        first = [] if self.namespace is None else [F.col("namespace_id") == self.namespace]
        return reduce(lambda a, b: a & b, first + self.predicates(), F.lit(True))

    def order(self) -> list[Column]:
        """The field, then the hash ascending; null keys come first ascending and last descending."""
        c = F.col(SORTS.get(self.sort, "created_at"))
        return [c.desc() if self.descending else c.asc(), F.col("content_hash").asc()]


@dataclass(frozen=True)
class Page:
    items: list[Row]
    next_cursor: str | None
    has_more: bool


def filtered(entries: DataFrame, query: Query) -> DataFrame:
    return entries.where(query.matches())


def ordered(entries: DataFrame, query: Query) -> DataFrame:
    return filtered(entries, query).orderBy(*query.order())


def ranked(entries: DataFrame, query: Query) -> DataFrame:
    """Matches with ``position``, their place in the order from 1 (the order made visible; one task ranks a namespace's matches)."""
    return filtered(entries, query).withColumn("position", F.row_number().over(Window.orderBy(*query.order())).cast("long"))


def encode_cursor(value: object, content_hash: str) -> str:
    shown = value.isoformat() if isinstance(value, datetime) else value
    return base64.b64encode(json.dumps({"v": shown, "h": content_hash}).encode()).decode()


def decode_cursor(cursor: str | None, sort: str) -> tuple[object, str] | None:
    """The sort value and hash to go on after; None, the start, if it can't be read."""
    try:
        token = json.loads(base64.b64decode(cursor or "", validate=True))
        value, after = token["v"], token["h"]
        if SORTS.get(sort, "created_at") in ("created_at", "modified_at"):
            value = datetime.fromisoformat(value)
        return (value, after) if isinstance(after, str) else None
    except (ValueError, KeyError, TypeError):
        return None


def after(query: Query) -> Column:
    """Rows beyond the cursor, in the query's order."""
    at = decode_cursor(query.cursor, query.sort)
    if at is None:
        return F.lit(True)
    value, last = at
    c, beyond = F.col(SORTS.get(query.sort, "created_at")), F.col("content_hash") > last
    if value is None:
        # null keys: first ascending, last descending
        return c.isNull() & beyond if query.descending else (c.isNull() & beyond) | c.isNotNull()
    if query.descending:
        return (c < F.lit(value)) | ((c == F.lit(value)) & beyond) | c.isNull()
    return (c > F.lit(value)) | ((c == F.lit(value)) & beyond)


def page_frame(entries: DataFrame, query: Query) -> DataFrame:
    """A page's rows and one more, that tells whether there are more."""
    size = query.page_size if query.page_size > 0 else PAGE
    return filtered(entries, query).where(after(query)).orderBy(*query.order()).limit(size + 1)


def page(entries: DataFrame, query: Query) -> Page:
    size = query.page_size if query.page_size > 0 else PAGE
    rows = page_frame(entries, query).collect()
    more, rows = len(rows) > size, rows[:size]
    cursor = encode_cursor(rows[-1][SORTS.get(query.sort, "created_at")], rows[-1]["content_hash"]) if more else None
    return Page(rows, cursor, more)


def pages(entries: DataFrame, query: Query) -> Iterator[Page]:
    """All pages, one after another."""
    while True:
        got = page(entries, query)
        yield got
        if not got.has_more:
            return
        query = replace(query, cursor=got.next_cursor)


def selectivity(query: Query) -> list[tuple[str, float]]:
    """(predicate, estimate) of each predicate, the most selective first; a query without any scans fully."""
    out = [] if query.key_prefix is None else [("KeyPrefix", 1 / (len(query.key_prefix) + 1))]
    out += [("Tag", 1 / 64) for _ in query.tags] + [("Attribute", 1 / 32) for _ in query.attribute_ranges]
    named = (("Tier", query.tiers), ("State", query.states), ("CreatedAt", query.created), ("ModifiedAt", query.modified), ("Size", query.size))
    out += [(name, 1 / 32) for name, value in named if value is not None]
    return sorted(out, key=lambda p: p[1]) or [("FullScan", 1.0)]
