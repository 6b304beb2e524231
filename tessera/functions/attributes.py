"""Typed attributes: one member of a struct holds the value, so that kinds survive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import ATTRIBUTE

_MEMBERS = {"string": "s", "bool": "b", "long": "l", "double": "d"}


def attribute(value: Column, kind: str) -> Column:
    """A value as an attribute; null where the value is."""
    parts = [F.lit(kind).alias("kind")]
    for f in ATTRIBUTE.fields[1:]:
        parts.append((value if f.name == _MEMBERS[kind] else F.lit(None)).cast(f.dataType).alias(f.name))
    return F.when(value.isNotNull(), F.struct(*parts))


def attributes(**values: Column) -> Column:
    """A map of the attributes that aren't null."""
    pairs = F.array(*[F.struct(F.lit(k), v) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["col2"].isNotNull()))


def in_range(attributes_: Column, name: str, low, high) -> Column:
    """Present and within [low, high], a None bound open; the bounds' type picks the member.

    Longs and doubles compare as numbers; any other mismatch of kinds is no match.
    """
    value = attributes_[name]
    bound = low if low is not None else high
    if bound is None:
        return value.isNotNull()
    if isinstance(bound, bool):
        member = value["b"]
    elif isinstance(bound, (int, float)):
        member = F.coalesce(value["l"].cast("double"), value["d"]) if isinstance(low, float) or isinstance(high, float) else None
        if member is None:
            # whole bounds compare exactly with longs, by value with doubles
            whole, real = value["l"], value["d"]
            tests = [(whole >= low) | (real >= float(low))] if low is not None else []
            tests += [(whole <= high) | (real <= float(high))] if high is not None else []
            return F.coalesce(_all(tests), F.lit(False))
    else:
        member = value["s"]
    tests = [member >= low] if low is not None else []
    tests += [member <= high] if high is not None else []
    return F.coalesce(_all(tests), F.lit(False))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def from_variant(value: Column) -> Column:
    """A JSON value as an attribute: as ``from_json`` has it; a number with a point is a double, whatever it equals."""
    kind = F.schema_of_variant(value)
    as_ = lambda t: F.try_variant_get(value, "$", t)
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(None))
        .when(kind == "STRING", attribute(as_("string"), "string"))
        .when(kind == "BOOLEAN", attribute(as_("boolean"), "bool"))
        .when(kind == "BIGINT", attribute(as_("long"), "long"))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), attribute(as_("double"), "double"))
        .otherwise(attribute(F.to_json(value), "string"))
    )


def from_json(token: Column) -> Column:
    """A JSON token as an attribute: string, bool, long if it fits, else double; nested values as their text, null dropped."""
    t = F.trim(token)
    is_text, is_bool = t.startswith('"'), t.isin("true", "false")
    is_null, nested = t == "null", t.startswith("{") | t.startswith("[")
    whole = F.when(t.rlike(r"^-?\d{1,19}$"), t.try_cast("long"))
    text = F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")
    return (
        F.when(t.isNull() | is_null, F.lit(None))
        .when(is_text, attribute(text, "string"))
        .when(is_bool, attribute(t == "true", "bool"))
        .when(nested, attribute(t, "string"))
        .when(whole.isNotNull(), attribute(whole, "long"))
        .otherwise(attribute(t.try_cast("double"), "double"))
    )
