"""Values in JSON by pointers, lists as sets, and a seeded order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pointer_tokens(pointer: Column) -> Column:
    """Steps of a JSON pointer: empty for the whole, null if it doesn't begin with a slash or has a stray ``~``."""
    unescaped = lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    valid = (pointer == "") | (pointer.startswith("/") & ~F.regexp_like(pointer, F.lit("~([^01]|$)")))
    tokens = F.when(pointer == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.substring(pointer, F.lit(2), F.length(pointer)), "/", -1), unescaped))
    return F.when(valid, tokens)


def escaped_token(name: Column) -> Column:
    """A name as a step of a pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def at_pointer(json: Column, pointer: Column) -> Column:
    """What a pointer leads to in a JSON text, as JSON; null where a step leads nowhere. A list's place is a number without leading zeros."""
    def step(value: Column, token: Column) -> Column:
        inside = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), token)
        place = F.when(F.regexp_like(token, F.lit("^(0|[1-9][0-9]{0,8})$")), token.try_cast("int"))
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.when(items.isNotNull(), F.get(items, place)).otherwise(inside)

    return F.to_json(F.aggregate(pointer_tokens(pointer), F.try_parse_json(json), step))


def sorted_unique(values: Column) -> Column:
    """Values in order, each once."""
    return F.array_sort(F.array_distinct(values))


def is_dense(places: Column) -> Column:
    """Whether numbers are 0 to n - 1 in any order, each once."""
    return sorted_unique(places) == F.when(F.size(places) > 0, F.sequence(F.lit(0).cast("long"), F.size(places).cast("long") - 1)).otherwise(F.array().cast("array<long>"))


def binding_paths_within(bindings: Column, locations: Column) -> Column:
    """Whether every path of ``path:blob`` bindings is one of the locations."""
    return F.size(F.array_except(F.transform(bindings, lambda b: F.regexp_replace(b, ":[^:]*$", "")), locations)) == 0


def seeded_key(seed: int, *parts: Column) -> Column:
    """A number to sort rows by, that looks random and is the same in every run; other seeds give other orders."""
    return F.xxhash64(F.lit(seed), *parts)
