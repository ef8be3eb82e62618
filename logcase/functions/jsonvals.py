"""JSON values with Python semantics, on Spark's VARIANT type.

* ``strict_object(text)`` -- the text is exactly one JSON object (as Python's
  ``json.loads`` would accept it) -> ``map<string,variant>``, else null.
  ``try_parse_json`` alone tolerates trailing text (``{"a":1} x``), so the
  text is wrapped between a sentinel prefix and suffix: any trailing or
  leading extra turns the wrapper into either invalid JSON or an object with
  more than two keys.
* ``truthy(v)`` -- Python truthiness: missing, null, ``""``, ``0``, ``false``,
  ``[]`` and ``{}`` are false. Decided by the value's type, so the string
  ``"0"`` is true.
* ``vtext(v)`` -- Python ``str()`` of a scalar (booleans print ``True``/``False``);
  containers come out as JSON text.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark's bound for one VARIANT value.
MOST_JSON_BYTES = 128 << 20

# Printable (JSON strings may not hold raw control characters) and unlikely
# to collide with a real key.
_SENTINEL_KEY = "~logcase:end~"
_DOC_KEY = "~logcase:doc~"


def _wrap(text: Column) -> Column:
    return F.concat(F.lit('{"' + _DOC_KEY + '":'), text, F.lit(',"' + _SENTINEL_KEY + '":1}'))


def wrapped_map(text: Column) -> Column:
    """Step 1 of ``strict_value``: the sentinel-wrapped text as a map.
    Materialise it in its own projection when the result is reused."""
    return F.try_variant_get(F.try_parse_json(_wrap(text)), "$", "map<string,variant>")


def too_large(text: Column, as_map: Column) -> Column:
    """The text opens a JSON object but is larger than VARIANT can hold, so that its null map says nothing about it."""
    return as_map.isNull() & (F.octet_length(text) > MOST_JSON_BYTES) & text.rlike(r"^\s*\{")


def value_of_wrapped(as_map: Column) -> Column:
    """Step 2 of ``strict_value``: the value when nothing else was in the text."""
    ok = (F.size(as_map) == 2) & as_map.getItem(_SENTINEL_KEY).isNotNull()
    return F.when(ok, as_map.getItem(_DOC_KEY))


def strict_value(text: Column) -> Column:
    """The text parsed as exactly one JSON value (variant), else null."""
    return value_of_wrapped(wrapped_map(text))


def as_object(v: Column) -> Column:
    """Variant -> map<string,variant> when it is a JSON object, else null."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def strict_object(text: Column) -> Column:
    return as_object(strict_value(text))


def vtype(v: Column) -> Column:
    """Type name of a variant value: STRING, BIGINT, DECIMAL(p,s), DOUBLE,
    BOOLEAN, VOID (JSON null), ARRAY<..>, OBJECT<..>; null when missing."""
    return F.schema_of_variant(v)


def truthy(v: Column) -> Column:
    t = vtype(v)
    return (F.when(v.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True))))


def vtext(v: Column) -> Column:
    t = vtype(v)
    b = F.try_variant_get(v, "$", "boolean")
    return (F.when(t == "BOOLEAN", F.when(b, F.lit("True")).otherwise(F.lit("False")))
            .otherwise(F.try_variant_get(v, "$", "string")))


def truthy_text(v: Column) -> Column:
    """``str(v)`` when ``v`` is truthy, else null."""
    return F.when(truthy(v), vtext(v))


def _text_if_truthy(t: Column, txt: Column) -> Column:
    """``truthy_text`` from a value's precomputed type name and string text."""
    return (F.when(t == "STRING", F.when(txt != "", txt))
            .when(t == "BOOLEAN", F.when(txt == "true", F.lit("True")))
            .when(t == "VOID", F.lit(None))
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.when(~txt.isin("[]", "{}"), txt))
            .otherwise(F.when(F.coalesce(txt.try_cast("double") != 0, F.lit(True)), txt)))


def truthy_texts(obj: Column, keys: tuple[str, ...]) -> Column:
    """map<string,string> of ``str(value)`` for the truthy values among
    ``keys`` of an object map (falsy values map to null). Computed once per
    row so that several fields can read it with plain lookups; the type and
    text of each value are computed once (lambdas get no common-subexpression
    elimination)."""
    wanted = F.array(*[F.lit(k) for k in sorted(set(keys))])
    picked = F.map_filter(obj, lambda k, _: F.array_contains(wanted, k))
    typed = F.transform_values(picked, lambda _, x: F.struct(
        F.schema_of_variant(x).alias("t"), F.try_variant_get(x, "$", "string").alias("s")))
    return F.transform_values(typed, lambda _, x: _text_if_truthy(x["t"], x["s"]))


def first_truthy(obj: Column, keys: tuple[str, ...]) -> Column:
    """``obj.get(k1) or obj.get(k2) or ...`` as a variant (null if none)."""
    return F.coalesce(*[F.when(truthy(obj.getItem(k)), obj.getItem(k)) for k in keys])


def first_truthy_text(obj: Column, keys: tuple[str, ...], default: str | None) -> Column:
    """``str(obj.get(k1) or obj.get(k2) or ... or default)``."""
    parts = [F.when(truthy(obj.getItem(k)), vtext(obj.getItem(k))) for k in keys]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)
