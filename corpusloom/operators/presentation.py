"""What a reader of reports sees: states and labels of files and units, filters, searches and gates; and which exclusions are safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import basename
from corpusloom.operators.freshness import scope_hashes

#: Files that lock versions, endings of plain text, names of files that steer tools, endings of programs, keys and configuration.
LOCKFILES = "bun.lock bun.lockb cargo.lock composer.lock gemfile.lock go.sum package-lock.json pipfile.lock pnpm-lock.yaml poetry.lock yarn.lock".split()
TEXT_ENDINGS = [".md", ".mdx"]
OPERATIONAL = (
    ".dockerignore .gitignore .npmrc .nvmrc .sops.yaml .sops.yml agents.md claude.md codeowners composer.json containerfile deno.json deno.jsonc dockerfile gemfile go.mod gradle.properties makefile package.json pipfile "
    "pnpm-workspace.yaml pom.xml requirements.txt review-policy.json settings.gradle build.gradle turbo.json"
).split()
RISKY_ENDINGS = (
    ".bash .c .cc .cjs .cpp .cts .fish .go .graphql .h .hcl .hpp .java .js .jsx .kt .kts .mjs .mts .key .keystore .nix .p12 .pem .pfx .proto .ps1 .py .rb .rs .sh .sql .swift .tf .tfvars .toml .ts .tsx .yaml .yml .zsh"
).split()
EXECUTABLE = "100755"


def is_hazardous(path: Column, *modes: Column) -> Column:
    """Whether leaving a file out of review is a risk: it runs, holds settings or keys, or steers tools. Lock files and plain text are none."""
    low = F.lower(path)
    base = basename(low)
    ending = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    like = lambda pattern: F.regexp_like(base, F.lit(pattern))
    runs = F.lit(False)
    for mode in modes:
        runs = runs | F.coalesce(mode == EXECUTABLE, F.lit(False))
    # The forms of configuration files' names.
    configures = like(r"^(?:dockerfile|containerfile)(?:\..+)?$") | like(r"^(?:tsconfig|eslint|prettier|vitest|vite|playwright|babel|jest)(?:\.[^.]+)*\.json$") | like(r"(?:^|[-.])(?:config|manifest|schema)\.json$")
    secret = (base == ".env") | base.startswith(".env.") | low.startswith(".agents-src/") | low.startswith(".github/workflows/")
    return F.when(runs, True).when(base.isin(LOCKFILES), False).when(secret, True).when(ending.isin(TEXT_ENDINGS), False).otherwise(base.isin(OPERATIONAL) | configures | ending.isin(RISKY_ENDINGS))


def has_magic(glob: Column) -> Column:
    return F.regexp_like(glob, F.lit(r"[*?\[\]{}()!+@]"))


def is_universal(glob: Column) -> Column:
    """Whether a glob matches every path."""
    # The forms of such globs.
    forms = F.regexp_like(glob, F.lit(r"^(?:\*\*/)*\*\*$")) | F.regexp_like(glob, F.lit(r"^(?:\*\*/)+\*$"))
    return forms | (F.regexp_replace(glob, r"(?:/\*\*)+$", "/**") == "**") | glob.isin("**/{*,.*}", "{*,.*}", "**/@(*)")


def is_exact_exclusion(path: Column, include: Column, exceptions: Column, owner: Column) -> Column:
    """Whether a rule excludes just this path by name, without exceptions, and somebody owns that."""
    named = F.exists(include, lambda g: ~has_magic(g) & (g == path))
    return F.coalesce(owner != "", F.lit(False)) & (F.size(exceptions) == 0) & named


def finding_paths(*singles: Column, lists: list[Column] = ()) -> Column:
    """Paths that a finding names in single fields and lists, without ``#symbol`` and ``:line`` at their ends."""
    every = F.concat(F.array_compact(F.array(*singles)), *[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.transform(F.array_compact(every), lambda p: F.regexp_replace(F.regexp_replace(p, r"#.*$", ""), r":\d+$", ""))


def file_status(report_state: Column, kind: Column, in_domain: Column, evidence: Column) -> Column:
    """What a file's review is worth in a domain: unknown without a valid report; a fresh claim of a stale report is stale."""
    known = F.when(report_state == "stale", F.when(evidence.isin("missing", "stale", "invalid"), evidence).otherwise("stale")).otherwise(F.coalesce(evidence, F.lit("missing")))
    return F.when(report_state.isin("missing", "invalid"), "unknown").when(kind.isin("unclassified", "conflict"), kind).when((kind == "excluded") | ~F.coalesce(in_domain, F.lit(False)), "unknown").otherwise(known)


def _counted(n: Column, word: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))


def coverage_label(state: Column, required: Column, fresh: Column, missing: Column, stale: Column, invalid: Column) -> Column:
    parts = F.concat_ws(", ", _counted(missing, "missing"), _counted(stale, "stale"), _counted(invalid, "invalid"))
    gap = F.when(parts != "", parts).otherwise(F.concat((required - fresh).cast("string"), F.lit(" coverage gaps")))
    return (
        F.when(state == "invalid", F.coalesce(_counted(invalid, "invalid evidence"), F.lit("invalid coverage"))).when(state == "unknown", "coverage unknown")
        .when(state == "gap", gap).when(state == "fresh", F.concat(fresh.cast("string"), F.lit("/"), required.cast("string"), F.lit(" fresh")))
    )


def risk_label(open_: Column, highest: Column, accepted: Column, designs: Column, least: str, none: str = "No open findings recorded") -> Column:
    """(kind, label): open findings with the highest of them (``least`` if it isn't known), else what was accepted or set apart, else none."""
    worst = F.coalesce(highest, F.lit(least))
    open_label = F.when(open_ == 1, F.concat(F.lit("1 open ("), worst, F.lit(")"))).otherwise(F.concat(open_.cast("string"), F.lit(" open (highest "), worst, F.lit(")")))
    kept = F.concat_ws(", ", _counted(accepted, "accepted risk"), _counted(designs, "separate design"))
    kind = F.when(open_ > 0, "open").when(kept != "", "retained").otherwise("none")
    return F.struct(kind.alias("kind"), F.when(open_ > 0, open_label).when(kept != "", kept).otherwise(none).alias("label"))


def outcome_label(has_ledger: Column, stale: Column, coverage: Column, open_: Column, highest: Column, accepted: Column, verdict: Column, clear: str = "No actionable findings") -> Column:
    """One line on a unit, by the first that holds; all clear only where the whole report is complete and the unit's own evidence accepted and fresh."""
    found = F.concat(open_.cast("string"), F.lit(" open findings"), F.coalesce(F.concat(F.lit(" (highest "), highest, F.lit(")")), F.lit("")))
    return (
        F.when(~has_ledger, "No completed audit evidence").when(stale, "Stale audit evidence — re-audit needed").when(coverage == "unknown", "Coverage has not been established")
        .when(coverage == "invalid", "Coverage invalid for this unit").when(coverage == "gap", "Coverage incomplete for this unit").when(open_ > 0, found)
        .when(F.coalesce(verdict == "complete", F.lit(False)) & accepted & (coverage == "fresh"), clear).otherwise("Recorded audit evidence")
    )


def found_paths(paths: DataFrame, query: str) -> DataFrame:
    """Rows whose path holds the query, in any case; all for an empty one."""
    wanted = query.strip().lower()
    return paths.where(F.contains(F.lower("path"), F.lit(wanted))) if wanted else paths


def visible_options(available: DataFrame, selected: DataFrame, order: DataFrame) -> DataFrame:
    """(option, place) of what is available (option) or selected, in the order (option, place); what the order doesn't name isn't shown."""
    return order.join(available.select("option").union(selected.select("option")).distinct(), "option", "left_semi").select("option", "place")


def failing(findings: DataFrame, fail_on: list[str]) -> DataFrame:
    """Findings whose detector, category or severity is among those that fail a run; ``any`` means all."""
    if "any" in fail_on:
        return findings
    return findings.where(F.col("detector").isin(fail_on) | F.col("category").isin(fail_on) | F.col("severity").isin(fail_on))


def card_rows(found: DataFrame, page: str, top: int = 30) -> DataFrame:
    """(page, metric, path, z, rank): the ``top`` strongest outliers of each page, by |z|, then metric and path."""
    key = F.struct((-F.abs("z")).alias("s"), "metric", "path", "z")
    # The first rows are found in 32 parts, then among those of all parts.
    parts = Window.partitionBy(page, F.pmod(F.xxhash64("path", "metric"), F.lit(32))).orderBy(key)
    near = found.withColumn("_r", F.row_number().over(parts)).where(F.col("_r") <= top).drop("_r")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(key))).where(F.col("rank") <= top).select(page, "metric", "path", "z", "rank")


def stamped_ledgers(ledgers: DataFrame, inventory: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(slug, result): ``stamped`` where the files of a ledger (slug, files, scope_hash) are all there and hash to what it says, ``drifted`` where not, ``not-found`` for a name (slug) without a ledger."""
    asked = ledgers if names is None else ledgers.join(names.select("slug").distinct(), "slug", "left_semi")
    files = asked.select("slug", F.explode(F.array_distinct("files")).alias("path")).join(inventory.select("path", "blob"), "path", "left")
    gaps = files.where("blob is null").select("slug").distinct()
    now = scope_hashes(files.where("blob is not null"), "slug").select("slug", F.col("hash").alias("now"))
    same = asked.join(now, "slug", "left").join(gaps.withColumn("gap", F.lit(True)), "slug", "left")
    out = same.select("slug", F.when(F.col("gap").isNull() & F.coalesce(F.col("now") == F.col("scope_hash"), F.lit(False)), "stamped").otherwise("drifted").alias("result"))
    if names is None:
        return out
    return out.unionByName(names.select("slug").distinct().join(ledgers.select("slug"), "slug", "left_anti").withColumn("result", F.lit("not-found")))
