"""Freshness queries over ``documents`` as an inventory, with notes derived from it by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.hashing import blob_sha1, stable_id
from corpusloom.functions.paths import ancestors
from corpusloom.operators import freshness as O
from corpusloom.operators import links as L
from corpusloom.sources import table


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), blob_sha1(F.col("text")).alias("blob"), "doc_id", "source", "lang", "n_chars")


def notes(inv: DataFrame) -> DataFrame:
    """A note for two in three paths: of these every fifth is of an old text, every seventh is unstamped, every eleventh was moved."""
    k = F.col("doc_id")
    path = F.when(k % 11 == 0, F.concat(F.lit("old/"), F.col("path"))).otherwise(F.col("path"))
    stamp = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 5 == 0, F.sha1(F.col("blob"))).otherwise(F.col("blob"))
    return inv.where(k % 3 != 0).select(path.alias("path"), stamp.alias("hash"))


INV = "inv as (select source || '/' || lang || '/' || doc_id as path, sha1('blob ' || strlen(text) || chr(0) || text) as blob, doc_id, source, lang, n_chars from documents)"
NOTES = "notes as (select case when doc_id % 11 = 0 then 'old/' || path else path end as path, case when doc_id % 7 = 0 then null when doc_id % 5 = 0 then sha1(blob) else blob end as hash from inv where doc_id % 3 <> 0)"
STATUS = "st as (select i.path, i.blob, n.hash, case when n.path is null then 'missing' when i.blob = n.hash then 'fresh' else 'outdated' end as status from inv i left join notes n on i.path = n.path)"


def content_hash(spark, sf):
    return inventory(spark, sf).select("doc_id", "blob", stable_id("doc-", "document", F.col("path"), F.col("blob")).alias("stable_id"))


def freshness_status(spark, sf):
    inv = inventory(spark, sf)
    return O.note_status(inv, notes(inv)).select("path", "status")


def status_by_source(spark, sf):
    inv = inventory(spark, sf)
    return O.status_counts(O.note_status(inv, notes(inv)).withColumn("source", F.substring_index("path", "/", 1)), ["source"])


def orphan_notes(spark, sf):
    inv = inventory(spark, sf)
    return O.orphans(inv, notes(inv)).select("path", "hash")


def exact_moves(spark, sf):
    inv = inventory(spark, sf)
    n = notes(inv)
    missing = O.note_status(inv, n).where("status = 'missing'")
    unique = lambda df, c: df.groupBy(c).agg(F.count("*").alias("_n")).where("_n = 1").select(c)
    orphaned, missing = O.orphans(inv, n), missing.select("path", "blob")
    orphaned = orphaned.join(unique(orphaned, "hash"), "hash", "left_semi")
    missing = missing.join(unique(missing, "blob"), "blob", "left_semi")
    return O.exact_moves(orphaned, missing)


def all_moves(spark, sf):
    """Moves with copies: blobs that several orphans or missing paths hold are claimed in order."""
    inv = inventory(spark, sf)
    n = notes(inv)
    return O.exact_moves(O.orphans(inv, n), O.note_status(inv, n).where("status = 'missing'"))


def moved_overlay(spark, sf):
    inv = inventory(spark, sf)
    n = notes(inv)
    status = O.note_status(inv, n)
    moves = O.exact_moves(O.orphans(inv, n), status.where("status = 'missing'"))
    return O.status_counts(O.with_moves(status, moves))


def directory_moves(spark, sf):
    return O.directory_moves(exact_moves(spark, sf))


def all_directory_moves(spark, sf):
    return O.directory_moves(all_moves(spark, sf))


def directory_hashes(spark, sf):
    """Files of one in ten lie beside directories, so that names of both sorts are in one order."""
    below = F.when(F.col("doc_id") % 10 == 3, F.lit(None).cast("string")).otherwise((F.col("doc_id") % 10).cast("string"))
    return O.directory_hashes(inventory(spark, sf).withColumn("path", F.concat_ws("/", "source", "lang", below, F.col("doc_id").cast("string"))))


def scope_hashes(spark, sf):
    inv = inventory(spark, sf).withColumn("scope", F.concat_ws("-", "source", F.floor(F.col("doc_id") / 1000).cast("string")))
    return O.scope_hashes(inv, "scope")


def tree_rollup(spark, sf):
    inv = inventory(spark, sf)
    return O.tree_rollup(O.note_status(inv, notes(inv)))


def drift(spark, sf):
    inv = inventory(spark, sf)
    before = inv.where(F.col("doc_id") % 13 != 0).withColumn("blob", F.when(F.col("doc_id") % 9 == 0, F.sha1("blob")).otherwise(F.col("blob")))
    return O.drift(before, inv.where(F.col("doc_id") % 17 != 0))


def trend(spark, sf):
    inv = inventory(spark, sf)
    before = inv.withColumn("blob", F.when(F.col("doc_id") % 4 == 0, F.sha1("blob")).otherwise(F.col("blob"))).withColumn("n_chars", F.col("n_chars") + F.col("doc_id") % 7 - 3)
    return O.trend(before, inv, "n_chars")


def link_edges(spark, sf):
    return L.link_edges(table(spark, sf, "pages"))


def broken_links(spark, sf):
    pages = table(spark, sf, "pages")
    return L.unresolved(L.link_edges(pages), pages)


def page_tree(spark, sf):
    paths = table(spark, sf, "pages").select(L.url_path(F.col("url")).alias("path"))
    return paths.select(F.explode(ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("pages"))


ANCESTORS = "select array_to_string(list_slice(string_split(path, '/'), 1, i::int), '/') as dir"

QUERIES = {
    "freshness_status": freshness_status, "hsh1_content_hash": content_hash, "agg1_status_counts": status_by_source, "joi2_orphans": orphan_notes,
    "joi4_exact_moves": exact_moves, "joi4_all_moves": all_moves, "joi6_all_directory_moves": all_directory_moves, "joi7_moved_overlay": moved_overlay, "joi6_directory_moves": directory_moves, "agg3_directory_hashes": directory_hashes,
    "agg4_scope_hashes": scope_hashes, "agg29_tree_rollup": tree_rollup, "joi18_drift": drift, "agg37_trend": trend,
    "txt11_link_edges": link_edges, "txt9_broken_links": broken_links, "arr3_page_tree": page_tree,
}

UNIQUE_MOVES = f"""with {INV}, {NOTES}, {STATUS},
 orphan as (select n.path, n.hash from notes n anti join inv i on n.path = i.path), mis as (select path, blob from st where status = 'missing'),
 o1 as (select hash, min(path) as source from orphan where hash is not null group by hash having count(*) = 1), m1 as (select blob, min(path) as target from mis group by blob having count(*) = 1),
 mv as (select source, target from o1 join m1 on o1.hash = m1.blob)"""

#: Claims in order: one orphan of each blob a round, each taking the best path that its blob has left.
CLAIMS = f"""with recursive {INV}, {NOTES}, {STATUS}, orphan as (select n.path, n.hash from notes n anti join inv i on n.path = i.path where n.hash is not null), tg as (select path, blob from st where status = 'missing'),
 sc as (select path as source, hash as blob, row_number() over (partition by hash order by path) as k from orphan where hash in (select blob from tg)),
 pr as (select blob, source, k, t.path as target, list_aggregate(list_transform(range(1, least(len(string_split(source, '/')), len(string_split(t.path, '/'))) + 1), lambda n: case when string_split(source, '/')[-n:] = string_split(t.path, '/')[-n:] then n else 0 end), 'max') as score from sc join tg t using (blob)),
 w(blob, k, source, target, claimed) as (
  select blob, 0::bigint, null::varchar, null::varchar, []::varchar[] from (select distinct blob from sc)
  union all select blob, k, source, target, list_append(claimed, target) from (select pr.blob, pr.k, pr.source, pr.target, w.claimed, row_number() over (partition by pr.blob order by pr.score desc, pr.target) as best from w join pr on pr.blob = w.blob and pr.k = w.k + 1 where not list_contains(w.claimed, pr.target)) where best = 1),
 mv as (select source, target from w where source is not null)"""

ORACLE_SQL = {
    "joi4_all_moves": f"{CLAIMS} select source, target from mv",
    "joi7_moved_overlay": f"""{CLAIMS}, s2 as (select case when status = 'missing' and path in (select target from mv) then 'moved' else status end as status from st) select count(*) filter (status = 'fresh') as fresh, count(*) filter (status = 'outdated') as outdated,
 count(*) filter (status = 'missing') as missing, count(*) filter (status = 'moved') as moved, count(*) filter (status = 'ignored') as ignored, count(*) filter (status <> 'ignored') as total from s2""",
    "joi6_all_directory_moves": f"""{CLAIMS}, v as (select regexp_replace(source, '/?[^/]*$', '') as source_dir, regexp_replace(target, '/?[^/]*$', '') as target_dir, count(*) as votes from mv group by 1, 2),
 r as (select *, row_number() over (partition by source_dir order by votes desc, target_dir desc) as k from v where source_dir <> target_dir) select source_dir, target_dir, votes from r where k = 1""",
    "freshness_status": f"with {INV}, {NOTES}, {STATUS} select path, status from st",
    "hsh1_content_hash": f"with {INV} select doc_id, blob, 'doc-' || substr(sha256('document' || chr(0) || path || chr(0) || blob), 1, 24) as stable_id from inv",
    "agg1_status_counts": f"""with {INV}, {NOTES}, {STATUS} select string_split(path, '/')[1] as source, count(*) filter (status = 'fresh') as fresh, count(*) filter (status = 'outdated') as outdated,
 count(*) filter (status = 'missing') as missing, count(*) filter (status = 'moved') as moved, count(*) filter (status = 'ignored') as ignored, count(*) filter (status <> 'ignored') as total from st group by 1""",
    "joi2_orphans": f"with {INV}, {NOTES} select n.path, n.hash from notes n anti join inv i on n.path = i.path",
    "joi4_exact_moves": f"{UNIQUE_MOVES} select source, target from mv",
    "joi6_directory_moves": f"""{UNIQUE_MOVES}, v as (select regexp_replace(source, '/?[^/]*$', '') as source_dir, regexp_replace(target, '/?[^/]*$', '') as target_dir, count(*) as votes from mv group by 1, 2),
 r as (select *, row_number() over (partition by source_dir order by votes desc, target_dir desc) as k from v where source_dir <> target_dir) select source_dir, target_dir, votes from r where k = 1""",
    "agg3_directory_hashes": """with inv as (select source || '/' || lang || '/' || case when doc_id % 10 = 3 then '' else (doc_id % 10) || '/' end || doc_id as path, sha1('blob ' || strlen(text) || chr(0) || text) as blob from documents),
 dirs as (select distinct array_to_string(list_slice(string_split(path, '/'), 1, i::int), '/') as path from inv, range(1, 4) t(i) where i < len(string_split(path, '/'))),
 kids as (select regexp_replace(path, '/?[^/]*$', '') as dir, 'F ' || string_split(path, '/')[-1] || ' ' || blob as line, string_split(path, '/')[-1] as name from inv union all select regexp_replace(path, '/?[^/]*$', ''), 'D ' || string_split(path, '/')[-1], string_split(path, '/')[-1] from dirs)
 select dir, sha1(string_agg(line, chr(10) order by name)) as hash from kids group by dir""",
    "agg4_scope_hashes": f"with {INV} select source || '-' || (doc_id // 1000) as scope, count(*) as files, sha1(string_agg(blob || '  ' || path, chr(10) order by blob || '  ' || path) || chr(10)) as hash from inv group by 1",
    "agg29_tree_rollup": f"""with {INV}, {NOTES}, {STATUS}, up as ({ANCESTORS}, status from st, range(0, 3) t(i)) select dir, count(*) as total, count(*) filter (status = 'fresh') as fresh,
 count(*) filter (status = 'outdated') as outdated, count(*) filter (status = 'missing') as missing from up group by dir""",
    "joi18_drift": f"""with {INV}, a as (select path, case when doc_id % 9 = 0 then sha1(blob) else blob end as old from inv where doc_id % 13 <> 0), b as (select path, blob as new from inv where doc_id % 17 <> 0)
 select path, case when old is null then 'added' when new is null then 'removed' else 'changed' end as change from a full join b using (path) where old is distinct from new""",
    "agg37_trend": """with c as (select n_chars - (n_chars + doc_id % 7 - 3) as d from documents where doc_id % 4 = 0) select count(*) as changed, count(*) filter (d >= 1) as improved, count(*) filter (d <= -1) as worsened from c""",
    "txt11_link_edges": """with e as (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=["'']([^"''#]+)["''#]', 1)) as href from pages) select page_id, href, count(*) as n from e group by 1, 2""",
    "txt9_broken_links": """with e as (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=["'']([^"''#]+)["''#]', 1)) as href from pages), p as (select distinct regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) as href from pages)
 select e.href, e.page_id, count(*) as n from e anti join p on e.href = p.href group by 1, 2""",
    "arr3_page_tree": f"with p as (select regexp_extract(url, '^[a-z]+://([^?#]*)', 1) as path from pages), u as ({ANCESTORS} from p, lateral (select unnest(range(0, len(string_split(path, '/')))) as i)) select dir, count(*) as pages from u group by dir",
}
