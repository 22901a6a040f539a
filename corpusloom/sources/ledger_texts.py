"""Notes, pages and glossaries out of their raw texts, in SQL functions; and the source that translations are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.canonical import canonical_row, sorted_texts
from corpusloom.operators.scopes import source_digest

#: Where front matter stands, its lines, the file of a directory's note, and the marked lines of a glossary's entries.
HEAD, FIELD, DIRECTORY_NOTE = r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?", r"^(\w+):\s*(.*)$", "__dir__.md"
ALIASES, HOME = r"(?m)^(?:别名|aliases)[:：]\s*(.+)$", r"(?m)^(?:归属|home)[:：]\s*(.+)$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def head_fields(text: Column) -> Column:
    """Key to value of the front matter, the last of equal keys; empty without one."""
    lines = F.filter(F.split(F.regexp_extract(text, HEAD, 1), r"\r?\n"), lambda s: F.regexp_like(s, F.lit(FIELD)))
    entries = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, FIELD, 1).alias("key"), trimmed(F.regexp_extract(s, FIELD, 2)).alias("value")))
    # Of a key that comes twice the later entry counts: earlier ones go before the map is made.
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def _body(text: Column) -> Column:
    return F.substring(text, F.length(F.regexp_extract(text, HEAD, 0)) + 1, F.length(text))


def _list(json: Column) -> Column:
    """Texts of a JSON list; null if it is none; what is no text in it is left out."""
    parsed = F.try_parse_json(json)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    return F.when(items.isNotNull(), F.array_compact(F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))))


def notes(files: DataFrame) -> DataFrame:
    """(path, type, file, hash, anchor, dirty, stamped, reading_order, body) of note files (file, text), file being their path below the notes' root."""
    text = F.coalesce("text", F.lit(""))
    is_dir = F.regexp_like("file", F.lit(rf"(?:^|/){DIRECTORY_NOTE}$"))
    path = F.when(is_dir, F.regexp_replace("file", rf"/?{DIRECTORY_NOTE}$", "")).otherwise(F.regexp_replace("file", r"\.md$", ""))
    of = files.where(F.col("file").endswith(".md")).select("file", path.alias("path"), F.when(is_dir, "dir").otherwise("file").alias("type"), head_fields(text).alias("m"), _body(text).alias("body"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return of.select("path", "type", "file", get("hash").alias("hash"), F.nullif(get("anchor"), F.lit("")).alias("anchor"), F.coalesce(get("dirty") == "true", F.lit(False)).alias("dirty"), get("stamped").alias("stamped"), _list(get("order")).alias("reading_order"), "body")


def concept_pages(files: DataFrame) -> DataFrame:
    """(slug, title, audience, sources, place, chapter, sources_hash, body) of page files (slug, text); ``place`` is a number of the head, null where there is none."""
    text = F.coalesce("text", F.lit(""))
    of = files.select("slug", head_fields(text).alias("m"), _body(text).alias("body"))
    get = lambda k: F.nullif(F.try_element_at("m", F.lit(k)), F.lit(""))
    place = F.when(F.try_element_at("m", F.lit("order")).isNotNull(), F.coalesce(F.try_element_at("m", F.lit("order")).try_cast("double"), F.when(F.try_element_at("m", F.lit("order")) == "", 0.0)))
    finite = F.when(~F.isnan(place) & (F.abs(place) < float("inf")), place)
    audience = F.when(get("audience") == "general", "general").otherwise("dev")
    return of.select("slug", F.coalesce(get("title"), "slug").alias("title"), audience.alias("audience"), F.coalesce(_list(get("sources")), F.array().cast("array<string>")).alias("sources"), finite.alias("place"), get("chapter").alias("chapter"), get("sources_hash").alias("sources_hash"), "body")


def _without(text: Column, part: Column) -> Column:
    """``text`` without the first ``part``, trimmed; the whole where ``part`` is empty."""
    at = F.instr(text, part)
    return F.when(part != "", trimmed(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text))))).otherwise(text)


def glossary(texts: DataFrame, key: str) -> DataFrame:
    """(key, place, term, aliases, definition, home) of glossaries (key, text): sections with a heading of two marks, in order.

    A line of aliases, split at commas, and a line with the home are taken out of the definition.
    """
    sections = texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"(?m)^##\s+", -1)).alias("place", "section")).where("place > 0")
    parts = sections.select(key, "place", trimmed(F.substring_index("section", "\n", 1)).alias("term"), trimmed(F.when(F.contains("section", F.lit("\n")), F.regexp_replace("section", r"^[^\n]*\n", "")).otherwise("")).alias("body")).where("term <> ''")
    named = parts.select(key, "place", "term", "body", F.regexp_extract("body", ALIASES, 0).alias("line"), F.regexp_extract("body", ALIASES, 1).alias("list"))
    aliases = F.filter(F.transform(F.split("list", "[,、]"), trimmed), lambda a: a != "")
    rest = named.select(key, "place", "term", aliases.alias("aliases"), _without(F.col("body"), F.col("line")).alias("body"))
    homed = rest.select("*", F.regexp_extract("body", HOME, 0).alias("line"), F.regexp_extract("body", HOME, 1).alias("value"))
    home = F.nullif(trimmed(F.regexp_replace(trimmed(F.col("value")), r"^`|`$", "")), F.lit(""))
    return homed.select(key, "place", "term", "aliases", _without(F.col("body"), F.col("line")).alias("definition"), home.alias("home"))


def translation_units(registered: DataFrame, ledgers: DataFrame) -> DataFrame:
    """(domain, slug, title, findings, source_digest, problem, digests): the units that translations are made from.

    Registered units are (domain, slug, title), ledgers (domain, slug, title, findings: array of JSON texts); a ledger stands for its unit. The digest is that of domain,
    slug, title and the sorted ``digests`` of the findings. Problems, then without a digest: ``duplicate-unit``, ``duplicate-ledger``, ``title-differs``, ``duplicate-findings``,
    ``no-canonical-form``.
    """
    r = registered.groupBy("domain", "slug").agg(F.count("*").alias("n_r"), F.max("title").alias("r_title"))
    each = ledgers.select("domain", "slug", "title", F.posexplode_outer("findings").alias("at", "finding")).withColumn("digest", source_digest(F.col("finding")))
    l = each.groupBy("domain", "slug").agg(  # noqa: E741
        F.max("title").alias("l_title"), F.min("title").alias("least_title"), F.count("finding").alias("n"), F.array_compact(F.collect_list("digest")).alias("digests"), F.count_if(F.col("finding").isNotNull() & F.col("digest").isNull()).alias("broken"))
    counted = ledgers.groupBy("domain", "slug").agg(F.count("*").alias("n_l"))
    joined = r.join(l, ["domain", "slug"], "full").join(counted, ["domain", "slug"], "left")
    problem = (
        F.when(F.col("n_r") > 1, "duplicate-unit").when(F.col("n_l") > 1, "duplicate-ledger").when(F.col("r_title") != F.col("l_title"), "title-differs").when(F.col("broken") > 0, "no-canonical-form")
        .when(F.size(F.array_distinct("digests")) < F.size("digests"), "duplicate-findings")
    )
    digests = F.coalesce("digests", F.array().cast("array<string>"))
    rows = joined.select("domain", "slug", F.coalesce("l_title", "r_title").alias("title"), F.coalesce("n", F.lit(0)).alias("findings"), sorted_texts(digests).alias("digests"), problem.alias("problem"))
    own = canonical_row(domain=F.col("domain"), slug=F.col("slug"), title=F.col("title"), findingDigests=F.col("digests"))["json"]
    return rows.select("domain", "slug", "title", "findings", F.when(F.col("problem").isNull(), F.sha2(F.concat(own, F.lit("\n")), 256)).alias("source_digest"), "problem", "digests")
