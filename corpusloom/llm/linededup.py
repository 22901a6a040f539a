"""Near-duplicate lines across documents by a deletion-neighbourhood join, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

#: Lines with more words hash their variants from running sums (linear) rather than one by one.
DIRECT_WORDS = 256
#: Running sums are kept modulo this prime, so a term (a hash times a place) stays within 64 bits at any length of line.
PRIME = (1 << 31) - 1
#: Ratio of successive half lengths by which lines are first matched.
STEP = 1.25
#: Segments of which the words around are hashed before the words within are varied.
SEGMENTS = 8


def normal_lines(text: Column) -> Column:
    """Lines in lower case, white space within them as single spaces, none at their ends."""
    # A single space, by far the most common case, is no match.
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")
    # Given F.trim itself, transform would pass each line's index as the characters to trim.
    return F.transform(F.split(spaced, "\n", -1), lambda line: F.trim(line))


def _half(words: Column) -> Column:
    """A power of STEP, rounded down, that is at most half of ``words``: lines of near lengths share it."""
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(STEP), F.floor(F.log(STEP, words / 2) + 1e-9)))).cast("int")


def _end_keys(words: Column) -> list[Column]:
    """Hashes of the first and of the last ``words`` words of the column ``line``."""
    part = lambda n: F.call_function("substring_index", F.col("line"), F.lit(" "), n)
    return [F.xxhash64(F.lit("first"), words, part(words)), F.xxhash64(F.lit("last"), words, part(-words))]


def _running_sums(values: Column) -> Column:
    """Inclusive running sums modulo PRIME of an array of longs, over blocks so that long arrays stay near linear."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.pmod(a + x, F.lit(PRIME)))

    def of_blocks(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda a, part: F.concat(a, F.array(F.pmod(F.element_at(a, -1) + total(part), F.lit(PRIME)))))
        return _let(before, lambda starts: F.flatten(F.transform(parts, lambda part, b: F.transform(part, lambda _, i: F.pmod(F.get(starts, b) + total(F.slice(part, F.lit(1), i + 1)), F.lit(PRIME))))))

    def of_values(v: Column) -> Column:
        return _let(F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / 128).cast("int")), lambda b: F.slice(v, b * 128 + 1, F.lit(128))), of_blocks)

    return _let(values, of_values)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_hashes(words: Column, seed: int) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(F.lit(seed), w), F.lit(PRIME)))


def _placed(hashes: Column) -> Column:
    """Hashes times their places, from 1."""
    return F.transform(hashes, lambda h, i: F.pmod(h * (i + 1), F.lit(PRIME)))


def _variants(words: Column) -> Column:
    """Hashes of the line without its i-th word, for each i, in order; equal remainders have equal hashes."""
    n = F.size(words)
    direct = F.transform(words, lambda _, i: F.xxhash64(F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, n))))

    def linear(seed: int) -> Column:
        # sum of hash * place over the words that stay, each after the gap one place further left
        hashes = _word_hashes(words, seed)
        moved = F.zip_with(_running_sums(_placed(hashes)), _running_sums(hashes), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        before = lambda s, i: F.when(i > 0, F.get(s, i - 1)["p"]).otherwise(0)
        return _let(moved, lambda s: F.transform(s, lambda x, i: F.pmod(F.element_at(s, -1)["p"] - x["p"] + before(s, i) - (F.element_at(s, -1)["q"] - x["q"]), F.lit(PRIME))))

    long = F.zip_with(linear(1), linear(2), lambda a, b: F.xxhash64(F.lit("sums"), n, a, b))
    return F.when(n <= DIRECT_WORDS, direct).otherwise(long)


def _one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one insertion, deletion or substitution."""
    def common(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        first = F.array_position(same, F.lit(False))
        return F.when(first > 0, first - 1).otherwise(F.size(x).cast("long"))

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


#: Document keys up to this number are sent to the scan as a filter (32 MB or so); beyond it, texts are joined by shuffle.
MAX_SENT_KEYS = 1 << 20


def _shared(keyed: DataFrame, member: str) -> DataFrame:
    """Distinct ``member`` of rows (key, member) whose key has another member: a sum by key, then a join with the few that have."""
    several = keyed.groupBy("key").agg(F.min(member).alias("low"), F.max(member).alias("high")).where("low <> high").select("key")
    return keyed.join(several, "key", "left_semi").select(member).distinct()


def dropped_lines(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """Lines to drop: (doc_id, text_key, dropped: array of 0-based line numbers), for ``dedup_lines``."""
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), normal_lines(F.col("text")).alias("all"))
        .select("doc_id", "text_key", F.posexplode("all").alias("pos", "line"))
        .withColumn("words", F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1)
        .where("line <> ''")
        .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line"), "half": _half(F.col("words")), "less": _half(F.greatest(F.lit(2), F.col("words") - 1))})
    )
    both, less = F.array(*_end_keys(F.col("half"))), F.array(*_end_keys(F.col("less")))
    keys = F.when(F.col("words") < near_words, F.array().cast("array<bigint>")).when(F.col("half") == F.col("less"), both).otherwise(F.concat(both, less))
    lines = written(
        lines.select("doc_id", "text_key", "pos", "h1", "h2", keys.alias("keys")),
        "dedup-lines",
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "pos")
    distinct = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "dedup-distinct")
    # Only a line that shares a half with another can be one edit from it; the others need no variants.
    near = _shared(lines.select(F.explode("keys").alias("key"), "h1"), "h1")
    candidates = written(_with_words(docs, distinct.join(near, "h1", "left_semi")), "dedup-candidates")
    near_dropped = _near_earlier(candidates)
    affected = (
        distinct.join(near_dropped.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
        .where((F.col("n") > 1) | F.col("near")).select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    hit = lines.select("doc_id", "text_key", "pos", "h1", "h2").join(affected, ["h1", "h2"]).where(F.col("near") | (place != F.col("first")))
    return hit.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("dropped"))


def _with_words(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, ord, words) of distinct ``lines`` (h1, h2, first): their words, from the document they are first in.

    ``ord`` numbers them in the order of first places: ranged, sorted, and numbered within ranges.
    """
    wanted = written(
        lines.select("h1", "h2", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), F.col("first.pos").alias("pos")),
        "dedup-wanted",
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    sent = wanted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    if sent.count() <= MAX_SENT_KEYS:
        texts = texts.join(F.broadcast(sent), texts["_id"].eqNullSafe(sent["_id"]) & (texts["_key"] == sent["_key"]), "left_semi")
    by_document = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", "h1", "h2", "first")).alias("wanted"))
    found = by_document.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("wanted", normal_lines(F.col("text")).alias("lines"))
    words = found.select("lines", F.explode("wanted").alias("w")).select("w.h1", "w.h2", "w.first", F.split(F.get("lines", F.col("w.pos")), " ").alias("words"))
    ranged = words.dropDuplicates(["h1", "h2"]).repartitionByRange("first").sortWithinPartitions("first")
    return ranged.select("h1", "h2", F.monotonically_increasing_id().alias("ord"), "words")


def _spans(t: Column, j: Column) -> tuple[Column, Column]:
    """Words before and after segment ``j`` of ``t`` words."""
    return (j * t / SEGMENTS).cast("int"), t - ((j + 1) * t / SEGMENTS).cast("int")


def _around(words: Column, t: Column) -> Column:
    """(key, t, j) of each segment j of a line that is taken as ``t`` words long: a hash of all words around it."""

    def around(j: Column) -> Column:
        before, after = _spans(t, j)
        rest = (F.slice(words, F.lit(1), before), F.slice(words, F.size(words) - after + 1, after))
        return F.struct(F.xxhash64(t, j, *rest).alias("key"), t.alias("t"), j.alias("j"))

    return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), around)


def _near_earlier(candidates: DataFrame) -> DataFrame:
    """(h1, h2) of lines that are one word edit from an earlier one.

    Two lines one edit apart agree in all words around one of SEGMENTS segments, cut by the length
    of the shorter; so a line is cut by its own length and by one less, and of segments with a
    partner only the words inside are varied. Such an inside emits itself (W), and each
    single-word deletion: at the line's own length as (place, remainder), which two lines share
    exactly if a substitution there makes them equal (S); at one less as the shorter line (D).
    So of each key only the earliest line of each sort is needed, never pairs.
    """
    n = F.size("words")
    keyed = candidates.select("ord", F.explode(F.concat(_around(F.col("words"), n), _around(F.col("words"), n - 1))).alias("s")).select("ord", "s.*")
    several = keyed.groupBy("key").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low <> high").select("key")
    before, after = _spans(F.col("t"), F.col("j"))
    closer = written(
        keyed.join(several, "key", "left_semi").join(candidates.select("ord", "words"), "ord")
        .select("ord", "key", (n == F.col("t")).alias("own"), F.slice("words", before + 1, n - before - after).alias("inside")),
        "dedup-closer",
    )
    inside = F.col("inside")
    variants = _variants(inside)
    # the whole inside's hash, in the form in which an inside of one word more hashes its variants
    whole = F.when(F.size(inside) < DIRECT_WORDS, F.xxhash64(inside)).otherwise(_whole_sums(inside))
    sort = lambda name, key: F.struct(F.lit(name).alias("sort"), key.alias("key"))
    emitted = closer.select("ord", "key", "own", F.when(F.col("own"), whole).alias("whole"), variants.alias("v")).select(
        "ord",
        F.explode(
            F.when(F.col("own"), F.concat(F.array(sort("W", F.xxhash64("key", "whole"))), F.transform("v", lambda k, i: sort("S", F.xxhash64("key", i, k)))))
            .otherwise(F.transform("v", lambda k: sort("D", F.xxhash64("key", k))))
        ).alias("e"),
    ).select("ord", "e.sort", "e.key")
    least = emitted.groupBy("key").agg(
        F.min(F.when(F.col("sort") == "D", F.col("ord"))).alias("d"),
        F.min(F.when(F.col("sort") != "D", F.col("ord"))).alias("w"),
        F.max("ord").alias("last"),
    ).where(F.least("d", "w") < F.col("last")).select("key", "d", "w")
    partner = F.when(F.col("sort") == "W", F.col("d")).otherwise(F.col("w"))
    pairs = emitted.join(least, "key").select("ord", partner.alias("earlier")).where("earlier < ord").distinct()
    mine = candidates.select("ord", "h1", "h2", "words")
    other = candidates.select(F.col("ord").alias("earlier"), F.col("words").alias("other"))
    return pairs.join(mine, "ord").join(other, "earlier").where(_one_edit_apart(F.col("words"), F.col("other"))).select("h1", "h2").distinct()


def _whole_sums(words: Column) -> Column:
    """A whole long line's hash, as the sums that a line of one word more has without that word."""
    def weighted(seed: int) -> Column:
        return F.aggregate(_placed(_word_hashes(words, seed)), F.lit(0).cast("long"), lambda a, x: F.pmod(a + x, F.lit(PRIME)))

    return F.xxhash64(F.lit("sums"), F.size(words) + 1, weighted(1), weighted(2))


def dedup_lines(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """``docs`` without lines that repeat an earlier line, up to one word inserted, deleted or replaced.

    Lines are compared over all documents, in lower case and with white space collapsed. Of equal
    lines, however short, the earliest (by doc_id, null last, then line) stays; blank ones are left
    alone. A line of at least ``near_words`` words that is one edit from an earlier such line, kept
    or not, goes too; in shorter lines one word is too large a part of the line to call them near.
    Returns all columns, ``text`` being the lines that stay, with n_lines and n_dropped. Lines that
    share no half with another are put aside by hashes; the rest emit deletion variants where they
    differ; see ``_near_earlier``.

    Hot lines and hot variants are reduced to their earliest place before they are shuffled, and
    joined back, which Spark can split. Text is shuffled only by document.

    Cases: a null text stays null (0 lines); empty texts have one line; rows that repeat doc_id
    and text share one fate (rows are named by doc_id and a 64-bit hash of the text); null doc_ids
    are one id, ordered last; long lines are compared whole; an empty table gives no rows; columns
    named n_lines or n_dropped are replaced, all others pass.
    """
    drops = dropped_lines(docs, near_words).select(F.col("doc_id").alias("_dl_id"), F.col("text_key").alias("_dl_key"), F.col("dropped").alias("_dl_dropped"))
    kept = docs.withColumn("_dl_text_key", F.xxhash64("text"))
    joined = kept.join(drops, kept["doc_id"].eqNullSafe(F.col("_dl_id")) & (F.col("_dl_text_key") == F.col("_dl_key")), "left")
    lines = F.split("text", "\n", -1)
    stays = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_dl_dropped", i)), "\n")
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_dropped": F.coalesce(F.size("_dl_dropped"), F.lit(0)).cast("long"),
    }).withColumn("text", F.when(F.col("_dl_dropped").isNull(), F.col("text")).otherwise(stays)).drop("_dl_id", "_dl_key", "_dl_dropped", "_dl_text_key")
