"""Canonical JSON, one text for equal values, and digests that are made of it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DEPTH, SAFE_INTEGER = 256, 2**53 - 1
#: Keys that no object may have.
FORBIDDEN = {"__proto__", "constructor", "prototype"}


class NotCanonical(ValueError):
    """Why a text has no canonical form."""


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise NotCanonical("repeated-key")
    if not FORBIDDEN.isdisjoint(found):
        raise NotCanonical("forbidden-key")
    return found


def _constant(_: str) -> None:
    raise NotCanonical("not-finite")


def _integer(text: str) -> int | float:
    # Very long runs of digits are no safe integers, and slow to read.
    return int(text) if len(text) < 20 else float(text)


def _number(value: int | float) -> str:
    """The shortest digits that read back as the value: plain from 1e-6 up, else with an exponent."""
    if value != value or abs(value) == float("inf"):
        raise NotCanonical("not-finite")
    if value == int(value):
        if abs(value) > SAFE_INTEGER:
            raise NotCanonical("unsafe-integer")
        return str(int(value))
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text, point = "".join(map(str, digits)).rstrip("0"), len(digits) + exponent
    if point > -6:
        plain = text[:point] + "." + text[point:] if point > 0 else "0." + "0" * -point + text
    else:
        plain = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1}"
    return "-" * sign + plain


def _utf16(text: str) -> bytes:
    try:
        return text.encode("utf-16-be")
    except UnicodeEncodeError:
        raise NotCanonical("lone-surrogate") from None


def _text(value: str) -> str:
    if not value.isascii():
        _utf16(value)
    return encode_basestring(value)


def serialized(value: object, depth: int = 0) -> str:
    """Canonical text of a parsed value: keys by their UTF-16 units, no white space."""
    if depth > MOST_DEPTH:
        raise NotCanonical("too-deep")
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(serialized(v, depth + 1) for v in value) + "]"
    keys = sorted(value, key=None if all(map(str.isascii, value)) else _utf16)
    return "{" + ",".join([f"{_text(k)}:{serialized(value[k], depth + 1)}" for k in keys]) + "}"


#: Made once, as each takes longer to make than a short text to read.
_DECODER = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_constant, parse_int=_integer)


def canonical_text(text: str | None) -> tuple[str | None, str | None]:
    """(canonical JSON, problem): one of them is null; both are for a null text."""
    if text is None:
        return None, None
    try:
        return serialized(_DECODER.decode(text)), None
    except NotCanonical as why:
        return None, str(why)
    except RecursionError:
        return None, "too-deep"
    except ValueError:
        return None, "no-json"


def _canonical(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        found = [canonical_text(t) for t in batch.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["json", "problem"])


def canonical_json(text: Column) -> Column:
    """Of JSON texts, (json, problem): the canonical text, or why there is none.

    Problems: no-json, repeated-key, forbidden-key, not-finite, unsafe-integer, lone-surrogate,
    too-deep (more than 256 levels). Numbers that are equal are one: 1, 1.0 and 10e-1 are 1, -0 is 0.
    """
    # Made here, as its type can only be read where there is a session.
    return F.arrow_udf(_canonical, "json string, problem string")(text)


def canonical_row(**fields: Column) -> Column:
    """(json, problem) of an object of columns; null fields are null."""
    return canonical_json(F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]), {"ignoreNullFields": "false"}))


def digest(canonical: Column) -> Column:
    """``sha256:`` and the hex SHA-256 of a canonical text."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def utf16_order(text: Column) -> Column:
    """A key that sorts texts by their UTF-16 units, as canonical lists are sorted."""
    return F.encode(text, "UTF-16BE")


def sorted_texts(texts: Column) -> Column:
    """An array of texts in the order of their UTF-16 units."""
    return F.transform(F.array_sort(F.transform(texts, lambda t: F.struct(utf16_order(t).alias("k"), t.alias("t")))), lambda s: s["t"])
