"""Histories of occurrences and decision events: links between them, what an event may supersede, deadlines.

An event that breaks a rule is a row of the result, not an error that ends the fold. Keys are
findings, receipts or slugs; a key's events are ordered in one task, so its history bounds memory
only by Spark's sort, which spills.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graph import components, reachability
from corpusloom.operators.tables import written


def consecutive(occurrences: DataFrame, explicit: DataFrame) -> DataFrame:
    """(before, after, finding, slug): neighbours in a finding's published history of one slug.

    ``occurrences`` are (occurrence, finding, slug, place, ahead); those ahead of what is
    published are left out. An occurrence that an ``explicit`` event (occurrence) leads to gets no
    such link.
    """
    order = Window.partitionBy("finding", "slug").orderBy("place", "occurrence")
    linked = occurrences.where("not ahead").withColumn("before", F.lag("occurrence").over(order)).where("before is not null")
    return linked.join(explicit.select("occurrence").distinct(), "occurrence", "left_anti").select("before", F.col("occurrence").alias("after"), "finding", "slug")


def earliest(occurrences: DataFrame, explicit: DataFrame) -> DataFrame:
    """(occurrence, seed): where the walk back by ``consecutive`` links from each published occurrence ends."""
    order = Window.partitionBy("finding", "slug").orderBy("place", "occurrence")
    marked = occurrences.where("not ahead").join(explicit.select("occurrence").distinct().withColumn("is_explicit", F.lit(True)), "occurrence", "left")
    starts = F.col("is_explicit").isNotNull() | (F.row_number().over(order) == 1)
    seed = F.last(F.when(F.col("starts"), F.col("occurrence")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("starts", starts).select("occurrence", seed.alias("seed"))


def publication_state(history: DataFrame, current: DataFrame) -> DataFrame:
    """(slug, observation, state) of (slug, observation, place): current, history-ahead behind a current place that is not the last, else historical.

    ``current`` are (slug, observation, has_ahead); a slug without one has only historical rows.
    """
    at = history.join(current.select("slug", F.col("observation").alias("_now"), "has_ahead"), "slug", "left")
    now = history.select("slug", F.col("observation").alias("_now"), F.col("place").alias("_at"))
    state = F.when(F.col("place") == F.col("_at"), "current").when(F.col("has_ahead") & (F.col("place") > F.coalesce("_at", F.lit(-1))), "history-ahead").otherwise("historical")
    return at.join(now, ["slug", "_now"], "left").select("slug", "observation", state.alias("state"))


def frontier(occurrences: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(finding, frontier, conflict): published occurrences (occurrence, finding) that no edge (before, outcome) leads on from.

    Edges of outcome distinct don't count. More than one component (occurrence, component) at a
    finding's frontier is a conflict.
    """
    onward = edges.where("outcome <> 'distinct'").select(F.col("before").alias("occurrence")).distinct()
    ends = occurrences.join(onward, "occurrence", "left_anti").join(components, "occurrence", "left")
    return ends.groupBy("finding").agg(F.count("*").alias("frontier"), (F.count_distinct(F.coalesce("component", "occurrence")) > 1).alias("conflict"))


def unmatched_partitions(bindings: DataFrame) -> DataFrame:
    """(event, shared, differs) of reconciliations (event, side, occurrence, binding) that are no partition of one set on both sides.

    ``shared`` counts bindings that two occurrences of one side share, ``differs`` those that only one side has.
    """
    sides = bindings.groupBy("event", "binding").agg(*[F.count_distinct(F.when(F.col("side") == s, F.col("occurrence"))).alias(s) for s in ("before", "after")])
    overlap = (F.col("before") > 1).cast("int") + (F.col("after") > 1).cast("int")
    return sides.groupBy("event").agg(F.sum(overlap).alias("shared"), F.count_if((F.col("before") == 0) != (F.col("after") == 0)).alias("differs")).where("shared > 0 or differs > 0")


def boundary_problem(before: Column, after: Column) -> Column:
    """What is wrong with two sets to compare: empty, repeated or shared; null if nothing."""
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    return (
        F.when(F.coalesce(F.size(before), F.lit(0)).isin(0, -1) | F.coalesce(F.size(after), F.lit(0)).isin(0, -1), "empty")
        .when(repeated(before) | repeated(after), "repeated").when(F.arrays_overlap(before, after), "shared"))


def same_set(actual: Column, expected: Column) -> Column:
    """Whether a list without repeats has just the members of another, in any order."""
    return (F.size(F.array_distinct(actual)) == F.size(actual)) & (F.array_sort(actual) == F.array_sort(expected))


#: Actions that close a finding and can be superseded.
CLOSURES = ["accepted-risk", "separate-design", "false-positive", "remediated", "superseded"]


def closure_errors(events: DataFrame) -> DataFrame:
    """(event, finding, supersedes, active): dispositions (event, finding, place, action, supersedes) that supersede another than the active closure.

    A disposition other than open becomes the active closure of its finding; open ends it, and so does one that supersedes it.
    """
    order = Window.partitionBy("finding").orderBy("place", "event")
    after = F.when(F.col("supersedes").isNull() & (F.col("action") != "open"), F.struct("event", "action"))
    known = events.withColumn("_before", F.lag(after).over(order))
    active = F.col("_before.event")
    wrong = F.col("supersedes").isNotNull() & ~(F.col("supersedes").eqNullSafe(active) & F.col("_before.action").isin(CLOSURES))
    return known.where(wrong | (F.col("supersedes").isNotNull() & active.isNull())).select("event", "finding", "supersedes", active.alias("active"))


def retirement_errors(events: DataFrame) -> DataFrame:
    """(event, path, blob): retirements (event, path, blob, place, reason, supersedes) that don't fit those before them.

    A receipt is retired once: by a single event that supersedes none, or by a staged deletion and
    then a deletion that supersedes it.
    """
    order = Window.partitionBy("path", "blob").orderBy("place", "event")
    numbered = events.withColumn("_n", F.row_number().over(order)).withColumn("_before", F.lag(F.struct("event", "reason")).over(order))
    first = (F.col("_n") == 1) & ((F.col("reason") != "deleted") | F.col("supersedes").isNull())
    second = (F.col("_n") == 2) & (F.col("_before.reason") == "staged-deletion") & (F.col("reason") == "deleted") & F.col("supersedes").eqNullSafe(F.col("_before.event"))
    return numbered.where(~(first | second)).select("event", "path", "blob")


def cyclic_edges(confirmed: DataFrame, proposed: DataFrame) -> DataFrame:
    """(event, src, dst): proposed equivalences whose src is their dst, or is reached from it by confirmed edges (src, dst).

    Only what the proposed ends reach is walked.
    """
    ends = proposed.select(F.col("dst").alias("node")).distinct()
    reached = reachability(confirmed, ends).select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    own = proposed.where("src = dst").select("event", "src", "dst")
    return proposed.where("src <> dst").join(reached, ["src", "dst"], "left_semi").select("event", "src", "dst").unionByName(own)


TURNS = pa.schema([("event", pa.int64()), ("src", pa.string()), ("dst", pa.string()), ("problem", pa.string())])


def cyclic_in_turn(confirmed: DataFrame, proposed: DataFrame, most_edges: int = 10_000) -> DataFrame:
    """(event, src, dst, problem): proposed equivalences (event, place, src, dst) that close a cycle with the confirmed ones (src, dst) and the proposals before them.

    In order of place, event and ends, a proposal that closes none is an edge for those after it; one that
    does, or whose ends are one, is ``cyclic`` and left out. The graph's connected components are judged apart, each in one task; the
    proposals of a component of more than ``most_edges`` edges are ``oversized``.
    """
    text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    old = confirmed.select(F.lit(None).cast("long").alias("event"), F.lit(None).cast("long").alias("place"), *text("src", "dst")).distinct()
    edges = written(old.unionByName(proposed.select(F.col("event").cast("long").alias("event"), F.col("place").cast("long").alias("place"), *text("src", "dst"))), "proposals")
    placed = edges.join(components(edges.select("src", "dst")).withColumnRenamed("node", "src"), "src")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.count("event").alias("asked")).where("asked > 0")
    marked = placed.join(sizes.select("component", (F.col("n") > most_edges).alias("large")), "component")

    def judged(rows: pa.Table) -> pa.Table:
        onward, found = defaultdict(list), []
        for e in sorted(rows.to_pylist(), key=lambda e: (e["event"] is not None, e["place"] or 0, e["event"] or 0, e["src"], e["dst"])):
            if e["event"] is not None:
                ways, seen = [e["dst"]], set()
                while ways and e["src"] not in seen:
                    node = ways.pop()
                    if node not in seen:
                        seen.add(node)
                        ways += onward[node]
                if e["src"] in seen:
                    found.append({"event": e["event"], "src": e["src"], "dst": e["dst"], "problem": "cyclic"})
                    continue
            onward[e["src"]].append(e["dst"])
        return pa.Table.from_pylist(found, schema=TURNS)

    cyclic = marked.where("not large").select("component", "event", "place", "src", "dst").groupBy("component").applyInArrow(judged, "event long, src string, dst string, problem string")
    return cyclic.unionByName(marked.where("large and event is not null").select("event", "src", "dst", F.lit("oversized").alias("problem")))


def rfc3339(text: Column) -> Column:
    """Whether a text is an instant of RFC 3339 with a date that exists, seconds up to 59, and Z or an offset."""
    # The form and its ranges.
    form = r"^(?!0000)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
    return F.coalesce(F.regexp_like(text, F.lit(form)) & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))


def over_long(created: Column, expires: Column, severity: Column, most_days: int, overrides: dict[str, int]) -> Column:
    """Whether a deadline is not after its creation, or later than the most days allowed, fewer for some severities."""
    days = F.lit(most_days)
    for name, limit in overrides.items():
        days = F.when(severity == name, F.least(F.lit(most_days), F.lit(limit))).otherwise(days)
    return (expires <= created) | (F.unix_millis(expires) - F.unix_millis(created) > days.cast("long") * 86_400_000)


def snooze_problem(until: Column, now: Column, most_days: int = 365) -> Column:
    """``past`` for a snooze that isn't in the future, ``too-long`` for one beyond the most days, ``missing`` without a time."""
    ahead = F.unix_millis(until) - F.unix_millis(now)
    return F.when(until.isNull(), "missing").when(ahead <= 0, "past").when(ahead > most_days * 86_400_000, "too-long")


def marker_age(changed: Column, now: Column, threshold_days: int = 180) -> Column:
    """stale, recent, or unknown where the last change isn't known; stale from the threshold on."""
    return F.when(changed.isNull(), "unknown").when(F.datediff(now, changed) >= threshold_days, "stale").otherwise("recent")
