"""Secret scan: fixed patterns, and sliding-window entropy of candidate strings, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of known kinds. A match of fewer characters (of the group) is dropped.
#: Runs of one character class are sought with their least length in the pattern, which finds the
#: same spans (a run is maximal, so it fails or fits as a whole) without listing every short run.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]

#: Candidate strings of each character class: (kind, pattern, window, least entropy of a window in bits).
#: A class asks for characters that the classes before it lack, so that one run is one candidate:
#: hex; small letters with or without digits; capitals likewise; both cases; both cases with digits.
#: Random runs reach the bits nearly always, words of natural languages don't.
CLASSES = [
    ("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}+(?![0-9A-Za-z])", 20, 3.0),
    ("entropy_lower", r"(?<![0-9A-Za-z])(?=[0-9a-f]*[g-z])[0-9a-z]{24,}+(?![0-9A-Za-z])", 24, 3.6),
    ("entropy_upper", r"(?<![0-9A-Za-z])(?=[0-9A-F]*[G-Z])[0-9A-Z]{24,}+(?![0-9A-Za-z])", 24, 3.6),
    ("entropy_letters", r"(?<![0-9A-Za-z])(?=[a-z]*[A-Z])(?=[A-Z]*[a-z])(?=[A-Fa-f]*[G-Zg-z])[A-Za-z]{24,}+(?![0-9A-Za-z])", 24, 3.8),
    ("entropy_token", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[0-9A-Za-z+/_-]{24,}+", 24, 3.8),
]
#: Placeholders, in either case: windows that overlap one don't count.
ALLOWED = ["example", "placeholder", "changeme", "your_", "xxxx", "0123456789", "abcdefghij", "lorem", "sample", "dummy"]

#: Elements that one quadratic step handles: running sums and maxima go over blocks of this many.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is not expanded where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, step) -> Column:
    """Running results of ``step`` from 0 over an array, inclusive, in time n * BLOCK: within blocks, then over the blocks' totals."""
    total = lambda part, first: F.aggregate(part, first, step)
    zero = F.lit(0)

    def of_blocks(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(zero), lambda a, part: F.concat(a, F.array(total(part, F.element_at(a, -1)))))
        return _let(before, lambda starts: F.flatten(F.transform(parts, lambda part, b: F.transform(part, lambda _, i: total(F.slice(part, F.lit(1), i + 1), F.get(starts, b))))))

    def of_values(all_values: Column) -> Column:
        blocks = F.sequence(zero, ((F.size(all_values) - 1) / BLOCK).cast("int"))
        return _let(F.transform(blocks, lambda b: F.slice(all_values, b * BLOCK + 1, F.lit(BLOCK))), of_blocks)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_let(values, of_values))


SPAN = "struct<start:int,rank:int,kind:string,end:int,text:string>"


def _matches(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans (in code points) of the leftmost non-overlapping matches whose group has ``least`` characters.

    The pieces between matches and the matches themselves come from the same leftmost scan, so
    the running sums of their lengths are where the matches end.
    """
    gap_lengths = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    span = lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("text"))

    def of_matches(found: Column) -> Column:
        steps = F.zip_with(found, gap_lengths, lambda m, g: F.length(m) + g)  # null past the last match
        ends = _running(F.filter(steps, lambda x: x.isNotNull()), lambda a, x: a + x)
        spans = F.zip_with(found, ends, span)
        kept = F.zip_with(spans, groups, lambda s, g: F.when(F.length(g) >= least, s)) if group else F.transform(spans, lambda s: F.when(F.length(s["text"]) >= least, s))
        return F.filter(kept, lambda s: s.isNotNull())

    # Most texts have no match: one scan tells.
    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_matches)
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _plogp(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def max_window_entropy(text: Column, window: int) -> Column:
    """Highest Shannon entropy (bits a character) of any ``window`` consecutive characters.

    With c the count of each character in the window, the entropy is log2(w) - sum(c log2 c) / w.
    The counts of the characters in the window are kept as it slides: those of the character that
    enters and of the one that leaves change by one, and the sum with them. So a step costs what a
    map of ``window`` entries costs, at any length. A text shorter than the window is one window.
    """
    gain = lambda n: _plogp(n + 1) - _plogp(n)
    of = lambda counts, c: F.coalesce(counts[c], F.lit(0))
    put = lambda counts, c, n: F.map_concat(F.map_filter(counts, lambda k, _: k != c), F.create_map(c, n))
    state = lambda counts, total, least: F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

    def enter(s: Column, c: Column) -> Column:
        return state(put(s["counts"], c, of(s["counts"], c) + 1), s["sum"] + gain(of(s["counts"], c)), s["least"])

    def slide(s: Column, moved: Column) -> Column:
        c, gone = moved["c"], moved["gone"]
        left = F.map_filter(put(s["counts"], gone, of(s["counts"], gone) - 1), lambda _, n: n > 0)
        now = s["sum"] - gain(of(s["counts"], gone) - 1) + gain(of(s["counts"], c))
        return F.when(c == gone, s).otherwise(state(put(left, c, of(s["counts"], c) + 1), now, F.least(now, s["least"])))

    def of_characters(chars: Column) -> Column:
        width = F.least(F.lit(window), F.size(chars))
        empty = state(F.create_map().cast("map<string,int>"), F.lit(0.0), F.lit(0.0))
        start = F.aggregate(F.slice(chars, F.lit(1), width), empty, enter)
        moves = F.zip_with(F.slice(chars, width + 1, F.size(chars)), F.slice(chars, F.lit(1), F.size(chars) - width), lambda c, gone: F.struct(c.alias("c"), gone.alias("gone")))
        least = _let(start, lambda s: F.aggregate(moves, state(s["counts"], s["sum"], s["sum"]), slide)["least"])
        return F.log2(width) - least / width

    return _let(F.split(text, ""), of_characters)


def _entropy_spans(candidates: Column, window: int, bits: float) -> Column:
    """Candidates with a window of enough entropy that overlaps no placeholder: such a window lies in a piece between them."""
    pieces = lambda s: F.filter(F.split(s["text"], f"(?i:{'|'.join(ALLOWED)})", -1), lambda p: F.length(p) >= window)
    return F.filter(candidates, lambda s: F.exists(pieces(s), lambda p: max_window_entropy(p, window) >= bits))


def _not_inside(candidates: Column, base: Column) -> Column:
    """Candidates that lie in no span of ``base``: swept by start, base spans first, with the furthest end of those so far."""
    merged = F.array_sort(F.concat(base, candidates))
    is_base = lambda s: s["rank"] < len(KINDS)
    reach = lambda spans: _running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), lambda a, x: F.greatest(a, x))
    marked = lambda spans: F.zip_with(spans, reach(spans), lambda s, r: F.when(~is_base(s) & (s["end"] > r), s))
    kept = F.filter(_let(merged, marked), lambda s: s.isNotNull())
    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(kept)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of likely secrets in each whole text of ``docs`` (doc_id, text).

    Returns doc_id, base (spans of the fixed patterns) and added (spans found by entropy), both
    arrays of (start, rank, kind, end, text), by start and then kind; offsets are code points,
    end exclusive. ``added`` are candidate strings of a character class in which some window, clear
    of allow-listed placeholders, has enough entropy, without those that lie in a base span.
    Row by row with built-in functions: no shuffle, no Python.

    Cases: null and empty texts have no spans; a null doc_id is kept; repeated rows each get a
    row; a text of any length is scanned whole, in time that grows with its length (running
    sums and maxima go in blocks, a window's counts are kept as it slides); an empty table gives
    no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"))
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found = found.withColumn(f"_{kind}", _matches(F.col("text"), kind, rank, pattern, group, least))
    for rank, (kind, pattern, window, _) in enumerate(CLASSES, len(KINDS)):
        found = found.withColumn(f"_{kind}", _matches(F.col("text"), kind, rank, pattern, 0, window))
    base = F.array_sort(F.concat(*[F.col(f"_{kind}") for kind, *_ in KINDS]))
    with_base = found.select("doc_id", base.alias("base"), *[f"_{kind}" for kind, *_ in CLASSES])
    added = F.concat(*[_entropy_spans(_not_inside(F.col(f"_{kind}"), F.col("base")), window, bits) for kind, _, window, bits in CLASSES])
    return with_base.select("doc_id", "base", F.array_sort(added).alias("added"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_secrets``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs).select(
        "doc_id",
        *[count(kind) for kind, *_ in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
