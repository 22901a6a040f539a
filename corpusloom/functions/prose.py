"""Prose of notes: paragraphs that are walls, lines about the text itself, lists hidden in a sentence, flat structure; paths and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that are no paragraphs, marks of list items, ends of sentences, phrases about the text itself, and the two forms of a list in a line.
NO_PARAGRAPH, ITEM, SENTENCE_END = r"^(#{1,6} |>|\||!\[|<)", r"^\s*([-*+]|\d+[.、)])\s", r"[。！？]"
ABOUT_ITSELF = r"这一篇是地图|(?i:不是\s?territory)|初读可(跳过|略)|回头(排查|再看)|见文末|(?i:文末\s?(进阶|callout|细节))|讲决策海拔|本篇(不讲|只讲|不展开)"
LISTED = r"(?:[二三四五六七八九十两]|[2-9]\d*)\s*(?:个|种|块|步|条|类|扇|轴|层|面|部分|方面|点)[^，。；：\n]{0,10}[：:][^。；\n]*、[^。；\n]*、"
EXAMPLES, NO_LINE = r"比如|例如|诸如|譬如|如：", r"^(#{1,6} |>|\||!\[|<|\s*[-*+] |\s*\d+[.、)] )"
CALLOUT = '<div class="callout"'


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unfenced(text: Column) -> Column:
    return F.regexp_replace(text, r"```[\s\S]*?```", "")


def before_callout(body: Column) -> Column:
    at = F.instr(body, F.lit(CALLOUT))
    return F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), _trimmed), lambda t: t != "")


def long_paragraphs(body: Column, most_chars: int, most_sentences: int) -> Column:
    """(is_item, chars, sentences) of paragraphs, one a line, and list items before the first callout that are longer than either limit."""
    prose = F.filter(_lines(_unfenced(before_callout(body))), lambda t: ~F.regexp_like(t, F.lit(NO_PARAGRAPH)))
    bare = lambda t: F.when(F.regexp_like(t, F.lit(ITEM)), F.regexp_replace(t, rf"{ITEM}+", "")).otherwise(t)
    measured = F.transform(prose, lambda t: F.struct(F.regexp_like(t, F.lit(ITEM)).alias("is_item"), F.length(bare(t)).alias("chars"), F.regexp_count(bare(t), F.lit(SENTENCE_END)).alias("sentences")))
    return F.filter(measured, lambda m: (m["chars"] > most_chars) | (m["sentences"] > most_sentences))


def lines_about_itself(body: Column) -> Column:
    """Lines that say how the text is to be read."""
    return F.filter(_lines(_unfenced(body)), lambda t: F.regexp_like(t, F.lit(ABOUT_ITSELF)))


def hidden_lists(body: Column) -> Column:
    """Lines of prose that are lists: a counted series after a colon, or three parts with brackets; examples are none."""
    prose = F.filter(_lines(_unfenced(body)), lambda t: ~F.regexp_like(t, F.lit(NO_LINE)))
    return F.filter(prose, lambda t: F.regexp_like(t, F.lit(LISTED)) | (~F.regexp_like(t, F.lit(EXAMPLES)) & (F.regexp_count(t, F.lit("）、")) >= 2)))


def is_flat(body: Column, most_section: int = 55, most_lines: int = 60) -> Column:
    """Whether a page with a diagram or many lines has at most two headings, or one section that holds too many lines."""
    own = before_callout(body)
    lines = F.split(own, "\n", -1)
    head = lambda line: F.regexp_like(line, F.lit("^#{2,4} "))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("heads"))
    counted = F.aggregate(
        lines, start,
        lambda a, line: F.struct(F.when(head(line), 0).otherwise(a["now"] + 1).alias("now"), F.greatest(a["most"], F.when(head(line), a["now"]).otherwise(a["now"] + 1)).alias("most"), (a["heads"] + head(line).cast("int")).alias("heads")),
    )
    hub = F.contains(body, F.lit("```mermaid")) | (F.size(lines) > most_lines)
    return hub & ((counted["heads"] <= 2) | (counted["most"] > most_section))


def is_repository_path(path: Column) -> Column:
    """Whether a text is a normal path below a root: relative, without empty segments, ``.``, ``..``, backslashes, a drive or a zero character."""
    like = lambda pattern: F.regexp_like(path, F.lit(pattern))
    return F.coalesce((path != "") & ~like(r"[\x00\\]") & ~like(r"^[A-Za-z]:($|/)") & ~like(r"(^|/)(\.{0,2})(/|$)"), F.lit(False))


def anchor_text(lines: Column, first: Column, last: Column) -> Column:
    """The lines from ``first`` to ``last``, white space as single spaces, blank ones left out."""
    part = F.slice(lines, first, F.greatest(F.lit(0), last - first + 1))
    return F.array_join(F.filter(F.transform(part, lambda s: _trimmed(F.regexp_replace(s, r"\s+", " "))), lambda s: s != ""), "\n")


def fingerprint(tag: str, *parts: Column) -> Column:
    """``tag:sha256:`` and the hex SHA-256 of the tag and the parts, joined by NUL; a null part is empty."""
    joined = F.concat_ws("\0", F.lit(tag), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{tag}:sha256:"), F.sha2(joined, 256))


def finding_id(prefix: str, of: Column) -> Column:
    """``prefix`` and the first 24 hex digits of a fingerprint's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(of, 256), 1, 24))
