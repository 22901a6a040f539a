"""Allow and block rules for URLs, held in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, UPPER

Rule = tuple[str, str, str]  # verdict, host, path

#: A rule set above this many UTF-8 bytes is joined instead of being sent to every task.
MAX_TRIE_BYTES = 64 << 20

HOST_AND_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class RuleTrie:
    """Labels of the host from the right, then segments of the path; the last segment of a rule's path is a prefix."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in sorted(rules, key=lambda r: (r[1], r[2], r[0] == "block")):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("path", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("prefixes", {})[last] = (verdict, host + path)
            node["lengths"] = sorted({len(p) for p in node["prefixes"]}, reverse=True)

    @staticmethod
    def _longest_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for length in node.get("lengths", ()):
                if (hit := node["prefixes"].get(segment[:length])) and len(segment) >= length:
                    best = hit
                    break
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the rule with the most host labels, then the longest path; else None."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "path" in node:
                best = self._longest_path(node["path"], segments) or best
        return best


def _with_parts(pages: DataFrame, url: str) -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = F.regexp_extract(text, HOST_AND_PATH, 1), F.regexp_extract(text, HOST_AND_PATH, 2)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for each row of ``pages``: (key, host, path, rule, verdict).

    ``rules`` are (verdict, host, path prefix). A rule fits its host and all subdomains if the
    path starts with the rule's. The rule with the most host labels wins, then the longest path;
    of an allow and a block entry for the same host and path, block wins. Without a fitting rule
    the verdict is ``default``. The rules are sent to the tasks as a trie; a rule set above
    MAX_TRIE_BYTES becomes a table and is joined by host suffix instead, with the same result.

    Cases: a null url, or one without ``://``, has an empty host and path and gets the default;
    repeated rows each get their row; an empty table gives none; other columns are not read.
    """
    parts = _with_parts(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")), "url")
    if sum(len(h.encode()) + len(p.encode()) for _, h, p in rules) > MAX_TRIE_BYTES:
        return _judge_by_join(parts, rules, default)
    # Bounded by MAX_TRIE_BYTES.
    shared = pages.sparkSession.sparkContext.broadcast(list(rules))

    @F.pandas_udf("verdict string, rule string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = RuleTrie(shared.value)
        for hosts, paths in batches:
            found = [trie.match(h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["verdict", "rule"], dtype=object)

    return parts.withColumn("judged", judged("host", "path")).select("page_id", "host", "path", "judged.rule", "judged.verdict")


def _judge_by_join(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts through an equi-join on the host's suffixes, for rule sets of any size."""
    spark = parts.sparkSession
    table = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    keyed = parts.withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.", -1)
    suffixes = keyed.select("row", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    fits = suffixes.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.size(F.split("rule_host", r"\.", -1)), F.length("rule_path"), F.col("verdict") == "block", "rule_host", "rule_path", "verdict")
    best = fits.groupBy("row").agg(F.max(rank).alias("best"))
    return keyed.join(best, "row", "left").select(
        "page_id", "host", "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
