"""Program text: code and comments apart, strings blanked, and what is measured on them; all in SQL functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import BRANCHES, LISTED_IDENTIFIER, NAME_START, identifier_parts


@dataclass(frozen=True)
class Family:
    """How a family of languages writes comments and strings; ``spanning`` quotes run over line ends, ``braces`` nest its blocks."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    quotes: str = ""
    spanning: str = ""
    triple: bool = False
    braces: bool = False


#: The families, and the file endings of each.
FAMILIES = {
    "c": Family(line=("//",), block=(("/*", "*/"),), quotes="\"'`", spanning="`", braces=True),
    "css": Family(block=(("/*", "*/"),), quotes="\"'", braces=True),
    "python": Family(line=("#",), quotes="\"'", triple=True),
    "hash": Family(line=("#",), quotes="\"'"),
    "ruby": Family(line=("#",), block=(("=begin", "=end"),), quotes="\"'"),
    "sql": Family(line=("--",), block=(("/*", "*/"),), quotes="'"),
    "lua": Family(line=("--",), block=(("--[[", "]]"),), quotes="\"'"),
    "haskell": Family(line=("--",), block=(("{-", "-}"),), quotes="\""),
    "markup": Family(block=(("<!--", "-->"),)),
}
ENDINGS = {
    "c": "ts tsx js jsx mjs cjs mts cts java c h cpp cc cxx hpp hh cs go rs kt kts swift php scala sc dart m mm",
    "css": "css", "python": "py pyi", "hash": "sh bash zsh yaml yml toml pl pm r", "ruby": "rb", "sql": "sql", "lua": "lua", "haskell": "hs", "markup": "html htm xml vue",
}

#: Words of languages that are no names of a program's own, and words that say nothing in a comment.
KEYWORDS = (
    "if else elif for while do switch case default try catch except finally with return break continue throw throws new delete typeof instanceof in of const let var function class extends implements "
    "interface enum struct trait fn func def lambda async await yield go defer public private protected static final abstract override virtual internal readonly namespace package import from export as "
    "using use mod pub self this super null nil true false undefined none pass raise and or not is impl where match select chan range type record sealed get set void int long float double char bool"
).split()
STOPWORDS = (
    "the and for with this that from are was were not but when then else here there which would should could will can must only also into over under between because instead without within "
    "before after each every used uses use see note todo fixme true false null undefined let const var return new get set has have had its their our your out off per via than them they you all "
    "any both few more most other some such nor own same too very just like make makes made need"
).split()


def _any_of(words: list[str]) -> str:
    """A pattern of words, by first letters, so that few are tried at a place; longer ones first."""
    starts = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == c), key=lambda w: -len(w)))})" for c in starts)


#: What text is cut into to find names: keywords, names that are none (group 1), and the rest of a line.
OWN_NAME = rf"(?:(?i:{_any_of(KEYWORDS)}))(?![{NAME_START}0-9])|({LISTED_IDENTIFIER})|[^{NAME_START}\n]+"


def family_of(path: Column) -> Column:
    """Name of the family of a path's ending, null for other files."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for name, endings in ENDINGS.items():
        out = F.when(ending.isin(endings.split()), name).otherwise(out)
    return out


def piece_pattern(family: Family) -> str:
    """A pattern that cuts program text into comments, strings and the rest; the first that fits at a place is taken.

    A string without its end stops at the line's end, a spanning one, a block comment and a triple
    quote at the text's end. A backslash hides the character after it. Loops are possessive: what
    they take is never given back, and a long string needs no deep stack.
    """
    parts = [rf"{re.escape(mark)}[^\n]*" for mark in family.line]
    parts += [rf"{re.escape(begin)}[\s\S]*?(?:{re.escape(end)}|\z)" for begin, end in family.block]
    if family.triple:
        parts += [rf"{q * 3}[^{q}\\]*(?:(?:{q}{{0,2}}\\[\s\S]|{q}{{1,2}}[^{q}\\])[^{q}\\]*)*+(?:{q * 3}|{q}{{0,2}}\\?\z)" for q in "'\""]
    for q in family.quotes:
        within, hidden = (rf"[^{q}\\]*", r"\\[\s\S]") if q in family.spanning else (rf"[^{q}\\\n]*", r"\\[^\n]")
        parts.append(rf"{q}{within}(?:{hidden}{within})*+[{q}\\]?")
    first = {mark[0] for mark in (*family.line, *[b for b, _ in family.block], *family.quotes)}
    starts = "".join(re.escape(c) for c in sorted(first))
    return "|".join([*parts, rf"[^{starts}]+", r"[\s\S]"])


def _starts(piece: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | piece.startswith(mark)
    return found


def _line_ends(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]+", "")


def masked(text: Column, family: Family) -> Column:
    """(code, comment): each line's code with strings as two quotes, and each line's comment, as arrays of one length."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(piece_pattern(family)), F.lit(0))
    comments = [*family.line, *[b for b, _ in family.block]]

    def code(piece: Column) -> Column:
        blank = F.when(_starts(piece, comments), _line_ends(piece))
        return blank.when(_starts(piece, list(family.quotes)), F.concat(F.lit("''"), _line_ends(piece))).otherwise(piece) if family.quotes else blank.otherwise(piece)

    def comment(piece: Column) -> Column:
        return F.when(_starts(piece, comments), piece).otherwise(_line_ends(piece))

    lines = lambda part: F.split(F.array_join(F.transform(pieces, part), ""), "\n", -1)
    return F.struct(lines(code).alias("code"), lines(comment).alias("comment"))


def deepest_brace(code: Column) -> Column:
    """The greatest depth of braces where a line begins; a closing brace too many leaves the depth at zero."""
    step = lambda d, brace: F.greatest(F.lit(0), d + F.when(brace == "{", 1).otherwise(-1))
    after = lambda d, line: F.aggregate(F.regexp_extract_all(line, F.lit(r"[{}]"), F.lit(0)), d, step)
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("most"))
    return F.aggregate(code, start, lambda a, line: F.struct(after(a["d"], line).alias("d"), F.greatest(a["most"], a["d"]).alias("most")))["most"]


def deepest_indent(code: Column) -> Column:
    """How deep lines are indented below one another; a tab counts as four, blank lines don't count."""
    widths = F.transform(F.filter(code, is_filled), indent)
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("most"))

    def step(a: Column, width: Column) -> Column:
        # Widths that are open grow, so those below the line's own are the ones that stay.
        still = F.array_append(F.filter(a["open"], lambda w: w < width), width)
        return F.struct(still.alias("open"), F.greatest(a["most"], F.size(a["open"])).alias("most"))

    # How many are open after the last line is counted at the end: a step that looked at its own list would make it twice.
    return F.aggregate(widths, start, step, lambda a: F.greatest(F.lit(1), a["most"], F.size(a["open"])) - 1)


def own_names(code: Column) -> Column:
    """Identifiers of a line that are no keywords."""
    return F.filter(F.regexp_extract_all(code, F.lit(LISTED_IDENTIFIER), F.lit(0)), lambda i: ~F.lower(i).isin(KEYWORDS))


def coherence(code: Column, comment: Column) -> Column:
    """(words, hits): distinct words of each line's comment, and those that are part of a name within two lines of it.

    Only the code around lines whose comment has such words is looked at.
    """
    words = lambda text: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(STOPWORDS)))
    there = F.filter(F.transform(comment, lambda text, i: F.struct(text.alias("text"), i.alias("at"))), lambda s: s["text"] != "")
    said = F.filter(F.transform(there, lambda s: F.struct(words(s["text"]).alias("words"), s["at"].alias("at"))), lambda s: F.size(s["words"]) > 0)

    # Names without keywords and the parts of names, in all lines at once; words have three letters and are no stopwords, so parts needn't be looked at.
    names = F.regexp_replace(F.array_join(code, "\n"), OWN_NAME, "$1 ")
    parts = F.split(identifier_parts(names), "\n", -1)

    def hits(s: Column, parts: Column) -> Column:
        # Line by line: a slice would walk over the whole text for each comment.
        near = F.concat_ws(" ", *[F.get(parts, s["at"] + k) for k in range(-2, 3)])
        return F.size(F.array_intersect(s["words"], F.split(near, "[^a-z]+")))

    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("hits"))
    summed = lambda parts: F.aggregate(said, start, lambda a, s: F.struct((a["words"] + F.size(s["words"])).alias("words"), (a["hits"] + hits(s, parts)).alias("hits")))
    # In an array of one, so that the parts are made once a text and not for each line.
    return F.transform(F.array(parts), summed)[0]


def section_sizes(text: Column, callout: str = '<div class="callout"') -> Column:
    """(lines, longest) of a note's body before its first callout: its lines, and the most lines between headings of four marks, these left out."""
    at = F.instr(text, F.lit(callout))
    body = F.split(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), "\n", -1)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    head = lambda line: line.startswith("#### ")
    counted = F.aggregate(body, start, lambda a, line: F.struct(F.when(head(line), 0).otherwise(a["now"] + 1).alias("now"), F.greatest(a["most"], F.when(head(line), a["now"]).otherwise(a["now"] + 1)).alias("most")))
    return F.struct(F.size(body).alias("lines"), counted["most"].alias("longest"))


def is_wall(sizes: Column, most_section: int = 35, most_lines: int = 130) -> Column:
    """Whether a body of ``section_sizes`` is too long to be read at a stretch."""
    return (sizes["longest"] > most_section) | (sizes["lines"] > most_lines)


def sections(text: Column) -> Column:
    """Number of lines of each section: what stands before the first line that begins with ``#``, if anything, and each such line with what follows it."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?m)^(?=#)", -1)
    return F.transform(parts, lambda part, i: F.regexp_count(part, F.lit(r"\n")) + F.when(i == F.size(parts) - 1, 1).otherwise(0))


#: White space, of Unicode too, and a line with anything else.
BLANK = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
FILLED = f"[^{BLANK}]"

#: How a function begins where braces nest, tried in this order, and where indents do.
FUNCTION_STARTS = [
    r"\b(?:async\s+)?function\s*\*?\s*([\w$]+)\s*\(",
    r"\bfunc\s*\([^)]*\)\s*([\w$]+)\s*\(",
    r"\b(?:func|fn|fun)\s+([\w$]+)\s*\(",
    r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*=>",
    r"^\s*(?:(?:public|private|protected|static|async|override|abstract|final|virtual|inline|suspend|export|readonly)\s+)*([\w$]+)\s*\([^()]*\)\s*(?::\s*[^{}]+?)?\s*\{?\s*$",
]
INDENTED_START = r"^\s*(?:async\s+)?def\s+([\w$]+)\s*\("
#: Comments that are no code that was commented out, what is cut off before the look, and what looks like code.
NO_CODE = r"(?i)^(@|#+\s|\*|todo|fixme|note|https?:|<reference\b|@ts-)"
COMMENT_MARK = r"^/+\s*|^--\s*"
LOOKS_LIKE_CODE = r"([{}]|;\s*$|==|!=|<=|>=|=>|->|\w+\([^)]*\)|\)\s*$)"
REEXPORT = r"^\s*export\s+.*\bfrom\b"

#: Functions that are found are kept in lists of this many, so that a file's thousandth costs no more to add than its first.
_TOGETHER = 500
REGION = "struct<name:string,line:int,lines:int,max_line_len:int,max_nesting:int,branches:int,comment_lines:int>"
_OPEN = "array<struct<name:string,line:int,lines:int,base:int,top:int>>"


def is_filled(line: Column) -> Column:
    return F.regexp_like(line, F.lit(FILLED))


def indent(line: Column) -> Column:
    """Width of the white space that a line begins with; a tab counts as four."""
    width = F.length(F.replace(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("\t"), F.lit("    ")))
    return F.when(line.startswith(" ") | line.startswith("\t"), width).otherwise(0)


def _start_name(line: Column) -> Column:
    """Name of the function that a line begins: of the first pattern whose first match has a name that is no keyword."""
    found = [F.regexp_extract(line, pattern, 1) for pattern in FUNCTION_STARTS]
    return F.when(line.contains("{"), F.coalesce(*[F.when((name != "") & ~name.isin(KEYWORDS), name) for name in found]))


def _no_regions() -> list[Column]:
    return [F.array().cast(f"array<{_OPEN}>").alias("full"), F.array().cast(_OPEN).alias("done")]


def _n_regions(a: Column) -> Column:
    return F.size(a["full"]) * _TOGETHER + F.size(a["done"])


def _with_region(a: Column, closed: Column, region: Column) -> list[Column]:
    """The lists of functions with one more where ``closed``; a list that is full is put away at the next line."""
    room = F.size(a["done"]) < _TOGETHER
    done = F.when(room, a["done"]).otherwise(F.array().cast(_OPEN))
    return [F.when(room, a["full"]).otherwise(F.array_append(a["full"], a["done"])).alias("full"), F.when(closed, F.array_append(done, region)).otherwise(done).alias("done")]


def _all_regions(a: Column, closed: Column, region: Column) -> Column:
    return F.concat(F.flatten(a["full"]), F.when(closed, F.array_append(a["done"], region)).otherwise(a["done"]))


def _braced_regions(code: Column, most: int | None) -> Column:
    """One pass over the lines: a function that is open hides others until the depth of braces is back where it began."""

    def marked(line: Column) -> Column:
        step = lambda a, b: F.struct((a["d"] + b).alias("d"), F.least(a["low"], a["d"] + b).alias("low"))
        signs = F.transform(F.regexp_extract_all(line, F.lit(r"[{}]"), F.lit(0)), lambda b: F.when(b == "{", 1).otherwise(-1))
        return F.struct(_start_name(line).alias("name"), F.aggregate(signs, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), step).alias("net"))

    lines = F.transform(code, lambda line, i: F.struct(marked(line).alias("m"), (i + 1).alias("line")))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("line"), F.lit(0).alias("base"), F.lit(0).alias("top"),
        F.lit(False).alias("risen"), *_no_regions(),
    )

    def step(a: Column, x: Column) -> Column:
        idle, net = a["name"].isNull(), x["m"]["net"]
        # The depth never falls below zero: what a line takes too much is not missing later.
        after = F.greatest(a["depth"] + net["d"], net["d"] - net["low"])
        begun = x["m"]["name"] if most is None else F.when(_n_regions(a) < most, x["m"]["name"])
        name = F.when(idle, begun).otherwise(a["name"])
        line, base = F.when(idle, x["line"]).otherwise(a["line"]), F.when(idle, a["depth"]).otherwise(a["base"])
        top = F.when(idle, a["depth"]).otherwise(F.greatest(a["top"], a["depth"]))
        risen = (~idle & a["risen"]) | (after > base)
        closed = name.isNotNull() & risen & (after <= base)
        region = F.struct(name.alias("name"), line.alias("line"), (x["line"] - line + 1).alias("lines"), base.alias("base"), top.alias("top"))
        return F.struct(
            after.alias("depth"), F.when(~closed, name).alias("name"), line.alias("line"), base.alias("base"), top.alias("top"),
            (risen & ~closed).alias("risen"), *_with_region(a, closed, region),
        )

    def finish(a: Column) -> Column:
        region = F.struct(a["name"].alias("name"), a["line"].alias("line"), (F.size(code) - a["line"] + 1).alias("lines"), a["base"].alias("base"), a["top"].alias("top"))
        return _all_regions(a, a["name"].isNotNull(), region)

    return F.aggregate(lines, start, step, finish)


def _indented_regions(code: Column, most: int | None) -> Column:
    """One pass over the lines: a function holds the lines after it that are blank or indented further; without any it is none."""
    lines = F.transform(code, lambda line, i: F.struct(F.when(line.contains("def"), F.nullif(F.regexp_extract(line, INDENTED_START, 1), F.lit(""))).alias("name"), is_filled(line).alias("filled"), indent(line).alias("width"), (i + 1).alias("line")))
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("line"), F.lit(0).alias("end"), F.lit(0).alias("base"), F.lit(0).alias("top"), *_no_regions())

    def region(a: Column) -> Column:
        return F.struct(a["name"].alias("name"), a["line"].alias("line"), (a["end"] - a["line"] + 1).alias("lines"), a["base"].alias("base"), a["top"].alias("top"))

    def is_one(a: Column) -> Column:
        return a["name"].isNotNull() & (a["end"] > a["line"])

    def step(a: Column, x: Column) -> Column:
        goes_on = a["name"].isNotNull() & (~x["filled"] | (x["width"] > a["base"]))
        closed = ~goes_on & is_one(a)
        name = F.when(goes_on, a["name"])
        name = name.otherwise(x["name"]) if most is None else name.when(_n_regions(a) + closed.cast("int") < most, x["name"])
        top = F.when(goes_on & x["filled"], F.greatest(a["top"], x["width"])).when(goes_on, a["top"]).otherwise(x["width"])
        return F.struct(
            name.alias("name"), F.when(goes_on, a["line"]).otherwise(x["line"]).alias("line"), x["line"].alias("end"),
            F.when(goes_on, a["base"]).otherwise(x["width"]).alias("base"), top.alias("top"), *_with_region(a, closed, region(a)),
        )

    return F.aggregate(lines, start, step, lambda a: _all_regions(a, is_one(a), region(a)))


def function_regions(raw: Column, code: Column, comment: Column, family: Family, most: int | None = None) -> Column:
    """The functions of a file, in order, only the first ``most`` if that is given, as an array of REGION; bodies within a body are counted once, as part of it.

    ``raw``, ``code`` and ``comment`` are arrays of lines as ``masked`` gives them. Where braces nest, a function goes from the line of its name,
    which has a brace, to the line that brings the depth back, or the file's end; elsewhere it is a
    ``def`` and the lines indented further. Nesting is what depth or indents (by four) rise above the first line's.
    """
    found = (_braced_regions if family.braces else _indented_regions)(code, most)
    # Line by line: a slice would walk over the whole file for each function.
    within = lambda lines, r: F.transform(F.sequence(r["line"], r["line"] + r["lines"] - 1), lambda i: F.get(lines, i - 1))
    nesting = lambda r: r["top"] - r["base"] if family.braces else F.greatest(F.lit(0), F.floor((r["top"] - r["base"] - 1) / 4).cast("int"))
    return F.transform(
        found,
        lambda r: F.struct(
            r["name"].alias("name"), r["line"].alias("line"), r["lines"].alias("lines"),
            F.aggregate(within(raw, r), F.lit(0), lambda most, s: F.greatest(most, F.length(s))).alias("max_line_len"), nesting(r).alias("max_nesting"),
            F.regexp_count(F.array_join(within(code, r), "\n"), F.lit(BRANCHES)).alias("branches"),
            F.size(F.filter(within(comment, r), is_filled)).alias("comment_lines"),
        ),
    ).cast(f"array<{REGION}>")


def block_end(lines: Column, start: Column, most: int = 200) -> Column:
    """The line, from 1, where the brackets that open at line ``start`` or after are balanced again, ``most`` lines on at most; ``start`` itself if none opens."""
    part = F.slice(lines, start, F.lit(most))
    signs = lambda line: F.transform(F.regexp_extract_all(line, F.lit(r"[{}()\[\]]"), F.lit(0)), lambda b: F.when(b.isin("{", "(", "["), 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("end"))

    def step(a: Column, line: Column) -> Column:
        depth = F.aggregate(signs(line), a["depth"], lambda d, b: d + b)
        opened = a["opened"] | F.regexp_like(line, F.lit(r"[{(\[]"))
        return F.struct(depth.alias("depth"), opened.alias("opened"), (a["seen"] + 1).alias("seen"), F.coalesce(a["end"], F.when(opened & (depth <= 0), a["seen"])).alias("end"))

    found = F.aggregate(part, zero, step)
    return F.coalesce(start + found["end"], F.when(found["opened"], start + found["seen"] - 1).otherwise(start))


def run_lengths(sorted_values: Column) -> Column:
    """(distinct, bits): how many distinct values a sorted array of values without line ends has, and the sum of n * log2(n) over the counts n of each.

    Values that stand more than once are found as runs of equal lines, so that what is done for each value is done by one pattern.
    """
    runs = F.regexp_extract_all(F.array_join(sorted_values, "\n"), F.lit(r"(?<![^\n])([^\n]*+)(?:\n\1(?![^\n]))++"), F.lit(0))
    counts = F.transform(runs, lambda run: ((F.length(run) + 1) / F.instr(run, F.lit("\n"))).cast("int"))
    bits = F.aggregate(counts, F.lit(0.0), lambda bits, n: bits + n * F.log2(n))
    return F.struct(F.size(F.array_distinct(sorted_values)).alias("distinct"), bits.alias("bits"))
