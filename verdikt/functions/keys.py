"""Canonical content keys: one text for equal values, whatever the order of their fields, and its SHA-256.

``stable_json`` walks the type of a column and writes its value with sorted
keys, no blanks, characters as they are, nulls kept, numbers in the form Spark
gives them (the shortest but for some far from 1, which get a digit more).  ``canonical_json`` brings JSON text of unknown shape to the same key order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

WHOLE = (S.ByteType, S.ShortType, S.IntegerType, S.LongType)


LETTERED = "\x0b\x0e\x0f\x1a\x1b\x1c\x1d\x1e\x1f"  # control characters whose escape has a letter


def _text(c: Column) -> Column:
    inner = F.to_json(F.array(c))
    shown = F.substring(inner, F.lit(2), F.length(inner) - 2)
    low = shown
    for char in LETTERED:  # an escape follows an even number of backslashes
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u{ord(char):04X}", rf"$1\\u{ord(char):04x}")
    return F.when(c.rlike(f"[{LETTERED}]"), low).otherwise(shown)


def _real(c: Column) -> Column:
    """A double with the fewest digits: plain from 0.0001 to below 1e16, else with an exponent of two digits or more."""
    shown = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(c.cast("string").try_cast("decimal(38,21)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    digits = F.regexp_replace(F.substring_index(shown, "E", 1), r"\.0$", "")
    power = F.substring_index(shown, "E", -1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    exponent = F.concat(digits, F.lit("e"), sign, F.lpad(F.regexp_replace(power, "^-", ""), 2, "0"))
    long_exponent = F.concat(digits, F.lit("e"), sign, F.regexp_replace(power, "^-", ""))
    far = F.when(F.length(F.regexp_replace(power, "^-", "")) > 2, long_exponent).otherwise(exponent)
    return (
        F.when(F.isnan(c), "NaN").when(size == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity"))
        .when(size == 0, F.when(shown.startswith("-"), "-0.0").otherwise("0.0"))
        .when((size >= 1e-4) & (size < 1e16), plain).otherwise(far)
    )


def stable_json(c: Column, kind: S.DataType) -> Column:
    """JSON text of a value of type ``kind``; fields and map keys in code-point order."""
    if isinstance(kind, S.StructType):
        fields = [
            F.concat(F.lit(("," if i else "") + _quoted(f.name) + ":"), stable_json(c[f.name], f.dataType))
            for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name))
        ]
        body = F.when(c.isNotNull(), F.concat(F.lit("{"), *fields, F.lit("}")))
    elif isinstance(kind, S.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: stable_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, S.MapType):
        if not isinstance(kind.keyType, S.StringType):
            raise TypeError("keys of a map must be text")
        entries = F.array_sort(F.map_keys(c))
        shown = F.transform(entries, lambda k: F.concat(_text(k), F.lit(":"), stable_json(F.element_at(c, k), kind.valueType)))
        body = F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}"))
    elif isinstance(kind, S.StringType):
        body = _text(c)
    elif isinstance(kind, S.BooleanType) or isinstance(kind, WHOLE):
        body = c.cast("string")
    elif isinstance(kind, (S.FloatType, S.DoubleType)):
        body = _real(c.cast("double"))
    elif isinstance(kind, S.VariantType):
        body = F.to_json(c)
    elif isinstance(kind, S.NullType):
        return F.lit("null")
    else:
        body = _text(c.cast("string"))
    return F.coalesce(body, F.lit("null"))


def _quoted(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null where the text is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def stable_hash(c: Column, kind: S.DataType) -> Column:
    return F.sha2(stable_json(c, kind), 256)


def cache_key(stage: str, c: Column, kind: S.DataType) -> Column:
    return F.concat(F.lit(stage + "::"), stable_hash(c, kind))
