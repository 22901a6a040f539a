"""Panels of readers over notes: gates with their reasons, the best of several rounds; paragraphs that explain a concept again; files dealt into batches."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import prose as S
from corpusloom.operators.consensus import consensus


@dataclass(frozen=True)
class Limits:
    """What a panel lets pass; ``above`` is the similarity from which two flagged sentences are one."""

    unclear: int = 4
    section: float = 3
    overall: float = 4
    concreteness: float = 4
    unsupported: int = 0
    misleading: int = 0
    above: float = 0.55
    paragraph: int = 360
    sentences: int = 6


def is_hub(kind: Column, body: Column, most_lines: int = 60) -> Column:
    """Whether a page explains several things: one with a diagram, or many lines before its callouts."""
    return (kind == "dir") | F.contains(body, F.lit("```mermaid")) | (F.size(F.split(S.before_callout(body), "\n", -1)) > most_lines)


def panel_reasons(notes: DataFrame, readers: DataFrame, sections: DataFrame, flagged: DataFrame, claims: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(note, readers, overall, worst_section, worst_score, unclear, reasons) of notes (note, body); no reasons means a pass.

    Readers: (note, reader, overall, retells, concreteness or null). Sections: (note, reader, section, score); those on callouts don't count. Flagged: (note,
    reader, key, sentence), sentences of callouts left out; one counts if most of the panel flags it in near the same words. Claims: (note, verdict), ``unsupported`` or ``misleading``.
    Reasons, in this order: unclear, section, overall, retell, concreteness (only of hubs), unsupported, misleading, paragraphs, about-itself, lists.
    """
    of = readers.groupBy("note").agg(F.count("*").alias("readers"), F.median("overall").alias("overall"), F.min(F.coalesce("retells", F.lit(True))).alias("retells"), F.coalesce(F.median("concreteness"), F.lit(5.0)).alias("concreteness"))
    graded = sections.where(~F.regexp_like("section", F.lit("进阶|(?i:callout)"))).groupBy("note", "section").agg(F.median("score").alias("median"))
    worst = graded.groupBy("note").agg(F.min(F.struct("median", "section")).alias("w")).select("note", F.col("w.section").alias("worst_section"), F.col("w.median").alias("worst_score"))
    callouts = notes.select("note", F.when(F.instr("body", F.lit(S.CALLOUT)) > 0, F.substring(F.col("body"), F.instr("body", F.lit(S.CALLOUT)), F.length("body"))).alias("callout"))
    own = flagged.join(callouts, "note").where(~F.coalesce(F.contains("callout", F.substring("sentence", 1, 30)), F.lit(False)))
    # Of panels of different sizes each has its own majority: sentences with two readers are found, then held against it.
    agreed = consensus(own.select(F.col("note").alias("group"), "reader", "key", "sentence"), limits.above, 1, of.select(F.col("note").alias("group"), (F.floor(F.col("readers") / 2) + 1).alias("least")))
    unclear = agreed.groupBy(F.col("group").alias("note")).agg(F.count("*").alias("unclear"))
    told = claims.groupBy("note").agg(F.count_if(F.col("verdict") == "unsupported").alias("unsupported"), F.count_if(F.col("verdict") == "misleading").alias("misleading"))
    body = F.col("body")
    text = notes.select(
        F.col("note").cast("string").alias("note"), is_hub(F.lit("file"), body).alias("hub"), F.size(S.long_paragraphs(body, limits.paragraph, limits.sentences)).alias("paragraphs"),
        F.size(S.lines_about_itself(body)).alias("about"), F.size(S.hidden_lists(body)).alias("lists"))
    keyed = lambda df: df.withColumn("note", F.col("note").cast("string"))
    joined = text.join(keyed(of), "note").join(keyed(worst), "note", "left").join(unclear, "note", "left").join(keyed(told), "note", "left").fillna(0, ["unclear", "unsupported", "misleading"])
    rules = [
        (F.col("unclear") > limits.unclear, "unclear"), (F.col("worst_score") < limits.section, "section"), (F.col("overall") < limits.overall, "overall"), (~F.col("retells"), "retell"),
        (F.col("hub") & (F.col("concreteness") < limits.concreteness), "concreteness"), (F.col("unsupported") > limits.unsupported, "unsupported"), (F.col("misleading") > limits.misleading, "misleading"),
        (F.col("paragraphs") > 0, "paragraphs"), (F.col("about") > 0, "about-itself"), (F.col("lists") > 0, "lists"),
    ]
    return joined.select("note", "readers", "overall", "worst_section", "worst_score", "unclear", F.array_compact(F.array(*[F.when(c, name) for c, name in rules])).alias("reasons"))


def best_rounds(readings: DataFrame, rounds: DataFrame, unclear: dict[str, int], breaks: dict[str, int], retellers: int = 2) -> DataFrame:
    """(page, round, passes, reasons, penalty, best): rounds of pages judged by their readers, and for each page the first that passes, else the one with the least penalty, the first of equals.

    Readings: (page, round, reader, unclear, breaks, retells), counts of sentences. Rounds: (page, round, audience, other_reasons, unsupported). Medians are held against
    the audience's limits (key ``general`` or ``dev``); the penalty is 2 for each reason, the median of unclear sentences, 2 for each break and 3 for each unsupported claim. What comes after a round that passes wasn't needed.
    """
    medians = readings.groupBy("page", "round").agg(F.median("unclear").alias("unclear"), F.median("breaks").alias("breaks"), F.count_if("retells").alias("retold"))
    limit = lambda table: F.when(F.col("audience") == "general", table["general"]).otherwise(table["dev"])
    joined = rounds.join(medians, ["page", "round"])
    rules = [F.col("unclear") > limit(unclear), F.col("breaks") > limit(breaks), F.col("retold") < retellers, F.col("unsupported") > 0]
    reasons = F.col("other_reasons") + sum((F.when(r, 1).otherwise(0) for r in rules), F.lit(0))
    judged = joined.withColumn("reasons", reasons).withColumn("penalty", F.col("reasons") * 2 + F.col("unclear") + F.col("breaks") * 2 + F.col("unsupported") * 3)
    chosen = judged.groupBy("page").agg(F.min_by("round", F.struct((F.col("reasons") > 0).alias("fails"), F.when(F.col("reasons") > 0, F.col("penalty")).otherwise(0.0).alias("p"), "round")).alias("chosen"))
    return judged.join(chosen, "page").select("page", "round", (F.col("reasons") == 0).alias("passes"), "reasons", "penalty", (F.col("round") == F.col("chosen")).alias("best"))


#: Words of a paragraph that explains how something works.
MECHANISM = "是|指|表示|负责|流程|按需|解析|组装|分两|分三|三步|构建|校验|钉|投影|派发|签发|维持|长驻|反代|递增|快照|合成"


@dataclass(frozen=True)
class Concept:
    """A concept, the pattern of its name, and the note that is its home: a file, or a directory with all below it."""

    name: str
    pattern: str
    home: str
    is_dir: bool


def explained_again(notes: DataFrame, concepts: list[Concept], least_chars: int = 240, mechanism: str = MECHANISM) -> DataFrame:
    """(concept, path, chars, paragraphs): notes (path, body) outside a concept's home that explain it: their paragraphs that match its pattern are long together and say how it works.

    Concepts are a list of the configuration, so their patterns are literals and no tables meet.
    """
    paragraphs = notes.select("path", F.explode_outer(F.split(F.coalesce("body", F.lit("")), r"\n\n+", -1)).alias("p"))
    path = F.col("path")
    away = lambda c: (path != c.home) & ~path.startswith(c.home + ("/" if c.is_dir else ""))
    named = F.array_compact(F.array(*[F.when(away(c) & F.regexp_like("p", F.lit(c.pattern)), c.name) for c in concepts])) if concepts else F.array().cast("array<string>")
    hits = paragraphs.select("path", "p", F.explode_outer(named).alias("concept")).where("concept is not null")
    found = hits.groupBy("concept", "path").agg((F.sum(F.length("p")) + F.count("*") - 1).alias("chars"), F.count("*").alias("paragraphs"), F.max(F.regexp_like("p", F.lit(mechanism))).alias("mechanism"))
    return found.where((F.col("chars") >= least_chars) & F.col("mechanism")).select("concept", "path", "chars", "paragraphs")


BATCHED = pa.schema([("unit", pa.string()), ("path", pa.string()), ("batch", pa.int64())])


def batches(files: DataFrame, most: int) -> DataFrame:
    """(unit, path, batch from 0) of files (unit, path), ``most`` to a batch: files of one name apart, and of one directory where that can be.

    Names with most files come first, equal ones by their first path. A file goes to the emptiest batch with room that has neither its name nor its directory, else to one
    without its name, else to any. Each placing depends on those before, so a unit's files are dealt in one task.
    """
    def dealt(table: pa.Table) -> pa.Table:
        unit, paths = table.column("unit")[0].as_py(), sorted(set(table.column("path").to_pylist()))
        groups: dict[str, list[str]] = {}
        for path in paths:
            groups.setdefault(path.rpartition("/")[2], []).append(path)
        held = [(0, set(), set()) for _ in range(-(-len(paths) // most))]
        out = []
        for name, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[1][0])):
            for path in group:
                directory = path.rpartition("/")[0]
                room = [(n, i) for i, (n, _, _) in enumerate(held) if n < most]
                choices = [[c for c in room if name not in held[c[1]][1] and directory not in held[c[1]][2]], [c for c in room if name not in held[c[1]][1]], room]
                _, batch = min(next(c for c in choices if c))
                n, names, directories = held[batch]
                held[batch] = (n + 1, names | {name}, directories | {directory})
                out.append((unit, path, batch))
        return pa.Table.from_pylist([dict(zip(BATCHED.names, row, strict=True)) for row in out], schema=BATCHED)

    return files.select(F.col("unit").cast("string").alias("unit"), "path").groupBy("unit").applyInArrow(dealt, "unit string, path string, batch long")
