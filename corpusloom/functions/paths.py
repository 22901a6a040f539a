"""Paths, globs and locations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def first_segments(path: Column, n: int = 2) -> Column:
    return F.substring_index(path, "/", n)


def ancestors(path: Column) -> Column:
    """All proper ancestor directories, the root being the empty path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def suffix_score(a: Column, b: Column) -> Column:
    """How many trailing segments two paths share."""
    same = F.zip_with(F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same).cast("long"))


def glob_regex(glob: str) -> str:
    """Regular expression of a glob: ``**`` any segments, ``*`` and ``?`` within one, braces, classes.

    Anything else of a glob dialect (extended patterns, escapes) is refused.
    """
    if re.search(r"[@!+*?]\(|\\", glob):
        raise ValueError(f"unsupported glob: {glob}")
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
            continue
        if c == "{":
            depth += 1
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if depth else ","}.get(c, re.escape(c))
        if c == "}":
            depth -= 1
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return F.regexp_like(path, F.lit("|".join(glob_regex(g) for g in globs))) if globs else F.lit(False)


def selected(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Any include and no exclude."""
    return matches_any(path, list(include)) & ~matches_any(path, list(exclude))


def ignored(path: Column, rules: list[str]) -> Column:
    """Ordered rules, ``!`` negates, the last that matches wins."""
    verdict = F.lit(False)
    for rule in rules:
        negated, body = rule.startswith("!"), rule.lstrip("!").strip("/")
        globs = [body if "/" in body else f"**/{body}", (body if "/" in body else f"**/{body}") + "/**"]
        verdict = F.when(matches_any(path, globs), F.lit(not negated)).otherwise(verdict)
    return verdict


def location(text: Column) -> Column:
    """``path``, ``path:line`` or ``path#symbol`` as a struct; the line must be a positive whole number."""
    line = F.regexp_extract(text, r":([1-9][0-9]{0,8})$", 1)
    symbol = F.regexp_extract(text, r"#(.+)$", 1)
    bare = F.regexp_replace(F.regexp_replace(text, r"#.+$", ""), r":[1-9][0-9]{0,8}$", "")
    return F.struct(bare.alias("path"), F.when(line != "", line.cast("int")).alias("line"), F.when(symbol != "", symbol).alias("symbol"))
