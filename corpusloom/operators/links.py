"""References in pages and text, and where they lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import inline_code

HREF = r"""<a\s[^>]*href=["']([^"'#]+)["'#]"""


def url_path(url: Column) -> Column:
    """Host and path of a URL as one path, without scheme, query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^?#]*)", 1)


def link_edges(pages: DataFrame) -> DataFrame:
    """(page_id, href, n) of the links in each page's HTML."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def unresolved(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges whose absolute href is the path of no page."""
    paths = pages.select(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/]*(/[^?#]*)", 1).alias("href")).distinct()
    return edges.join(paths, "href", "left_anti")


def code_references(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, reference) of path-like inline code: no spaces, and a slash or a file ending."""
    spans = docs.select(key, F.explode(inline_code(F.col("text"))).alias("reference"))
    return spans.where(F.regexp_like("reference", F.lit(r"^[\w.@~/-]+$")) & F.regexp_like("reference", F.lit(r"/|\.[A-Za-z0-9]{1,5}$"))).distinct()


def resolved(references: DataFrame, inventory: DataFrame, bases: list[str], extensions: list[str], key: str = "doc_id") -> DataFrame:
    """(key, reference, path): the first existing path among bases x extensions; null with a unique basename as suggestion."""
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.concat(F.lit(b), "reference", F.lit(e)).alias("path")) for i, (b, e) in enumerate((b, e) for b in bases for e in extensions)])
    each = references.select(key, "reference", F.explode(tries).alias("t")).select(key, "reference", "t.i", "t.path")
    hits = each.join(inventory.select("path"), "path").groupBy(key, "reference").agg(F.min_by("path", "i").alias("path"))
    names = inventory.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("suggestion")).where("n = 1").drop("n")
    left = references.join(hits, [key, "reference"], "left").withColumn("name", F.regexp_extract("reference", "([^/]*)$", 1))
    return left.join(names, "name", "left").select(key, "reference", "path", F.when(F.col("path").isNull(), F.col("suggestion")).alias("suggestion"))
