"""Status queries over ``documents`` as an inventory: moves, change sizes, reading order, concepts, reports and order of pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import ancestors
from corpusloom.operators import attention as A
from corpusloom.operators import freshness as Fr
from corpusloom.operators import links as L
from corpusloom.operators import readingorder as R
from corpusloom.operators import status as O
from corpusloom.plans.freshness import INV, NOTES, STATUS, inventory, notes
from corpusloom.sources import table


def _k():
    return F.col("doc_id")


def _under(*parts):
    return F.concat_ws("/", *[F.lit(p) if p in ("old", "older", "new", "else", "flat", "x") else F.col(p).cast("string") for p in parts])


def joi3_ignored_directories(spark, sf):
    d = table(spark, sf, "documents")
    held = d.where("doc_id % 10 = 4").select(F.concat_ws("/", F.when(_k() % 4 == 0, "gen").otherwise(F.col("source")), "lang", F.concat(F.lit("tmp"), (_k() % 7).cast("string")), _k().cast("string")).alias("path"))
    scanned = d.where("doc_id % 10 <> 4").select(F.explode(ancestors(_under("source", "lang", "doc_id"))).alias("path")).distinct()
    return O.ignored_directories(held, scanned)


def joi5_edited_moves(spark, sf):
    d = inventory(spark, sf).where("doc_id % 11 = 0")
    anchor = F.concat(F.lit("a"), (_k() % 3).cast("string"))
    old, older = F.concat(F.lit("old/"), "path"), F.concat(F.lit("older/"), "path")
    orphaned = d.where("doc_id % 5 <> 0").select(old.alias("path"), anchor.alias("anchor")).union(d.where("doc_id % 2 = 0").select(older, anchor))
    score = (50 + _k() % 50).alias("similarity")
    renames = d.select(anchor.alias("anchor"), old.alias("source"), F.col("path").alias("target"), score).union(d.select(anchor, older, "path", score))
    return O.edited_moves(orphaned, d.where("doc_id % 33 <> 0").select("path"), renames)


def joi5_contested_moves(spark, sf):
    """Two orphans want each path; the anchors' names are in another order than their first orphans."""
    d = inventory(spark, sf).where("doc_id % 6 = 1")
    anchors = [F.concat(F.lit("a"), ((n + _k() * 5) % 7).cast("string")) for n in (0, 3)]
    sources = [F.concat(F.lit(f"{top}/"), F.lpad(((_k() * 13) % 101).cast("string"), 3, "0"), F.lit("/"), F.col("path")) for top in ("m", "n")]
    orphaned = d.select(sources[0].alias("path"), anchors[0].alias("anchor")).union(d.select(sources[1], anchors[1]))
    renames = d.select(anchors[0].alias("anchor"), sources[0].alias("source"), F.col("path").alias("target"), F.lit(90).alias("similarity")).union(d.select(anchors[1], sources[1], "path", F.lit(80)))
    claimed = d.where("doc_id % 4 = 1").select(sources[0].alias("source"), F.lit("gone").alias("target"))
    return O.edited_moves(orphaned, d.select("path"), renames, claimed)


def joi6_voted_moves(spark, sf):
    d = table(spark, sf, "documents")
    to = F.when(_k() % 4 == 0, _under("new", "source", "lang", "doc_id")).when(_k() % 4 == 1, _under("new", "source", "x", "doc_id")).when(_k() % 4 == 2, _under("else", "source", "lang", "doc_id")).otherwise(_under("flat", "doc_id"))
    moves = d.where("doc_id % 4 <> 2 or doc_id % 3 <> 0").select(_under("old", "source", "lang", "doc_id").alias("source"), to.alias("target"))
    dirs = lambda c: moves.select(F.explode(ancestors(F.col(c))).alias("path")).distinct()
    return O.voted_moves(dirs("source"), moves, dirs("target").where("path not in ('', 'else')"))


def joi8_change_sizes(spark, sf):
    inv = inventory(spark, sf)
    changes = inv.select(F.concat(F.lit("a"), (_k() % 2).cast("string")).alias("anchor"), "path", F.when(_k() % 7 != 0, F.col("n_chars") % 97).alias("added"), (F.col("n_chars") % 89).alias("removed"))
    files = inv.where("doc_id % 5 = 0").select("path", F.lit("file").alias("type"), F.lit("a0").alias("anchor"))
    dirs = inv.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit("dir").alias("type"), F.lit("a1").alias("anchor"))
    return O.change_sizes(files.union(dirs), changes)


def joi10_reading_order(spark, sf):
    inv = inventory(spark, sf)
    names = F.explode(F.array(*[F.lit(n) for n in ("en", "DE", "Fr", "xx", "SRC0", "src1")])).alias("name")
    orders = inv.select(F.explode(F.array(F.lit(""), F.col("source"))).alias("dir")).distinct().select("dir", names)
    return O.reading_order_errors(orders, inv)


def _concepts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("blob"))
    inv = d.where("doc_id % 10 <> 7").select(_k().cast("string").alias("path"), F.when(_k() % 6 == 0, "dir").otherwise("file").alias("type"), "blob")
    sources = F.when(_k() % 8 == 0, F.array(_k().cast("string"))).otherwise(F.array((_k() + 2).cast("string"), _k().cast("string"), (_k() - 1).cast("string")))
    return O.concept_status(d.where("doc_id % 4 = 0").select(F.concat(F.lit("c"), _k().cast("string")).alias("slug"), sources.alias("sources"), F.sha1("blob").alias("hash")), inv)


def joi12_concepts(spark, sf):
    return _concepts(spark, sf).withColumn("broken", F.array_join("broken", ","))


def agg2_concept_counts(spark, sf):
    return O.concept_counts(_concepts(spark, sf))


def agg28_health(spark, sf):
    """Documents by their notes, concept pages, every eighth document as a broken reference, and orphans."""
    inv = inventory(spark, sf)
    n = notes(inv)
    status = Fr.note_status(inv, n).select("path", "status")
    return A.health(status, _concepts(spark, sf), inv.where("doc_id % 8 = 3"), Fr.orphans(inv, n))


def srt5_ordered_items(spark, sf):
    items = inventory(spark, sf).select(F.col("path").alias("slug"), F.when(_k() % 3 == 0, "done").when(_k() % 3 == 1, "snoozed").otherwise("open").alias("workflow"), _k().alias("place"))
    return A.ordered_items(items.where("place % 10 = 4")).select("slug", "workflow", "rank")


def set1_all_files(spark, sf):
    inv = inventory(spark, sf)
    return O.united(inv.where("doc_id % 3 <> 0"), inv.where("doc_id % 5 <> 1"))


def set9_changed_paths(spark, sf):
    inv = inventory(spark, sf)
    return O.united(inv.where("doc_id % 4 = 0"), inv.where("doc_id % 6 = 0"), inv.where("doc_id % 10 = 1"))


def set10_new_dirty(spark, sf):
    inv = inventory(spark, sf)
    return O.new_dirty(inv.where("doc_id % 3 = 0"), inv.where("doc_id % 2 = 0"), "src1/")


def _reports(spark, sf):
    inv = inventory(spark, sf)
    before = inv.where("doc_id % 13 <> 0").withColumn("blob", F.when(_k() % 4 == 0, F.sha1("blob")).when(_k() % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("blob"))).withColumn("n_chars", F.col("n_chars") + _k() % 7 - 3)
    return O.report_changes(before, inv.where("doc_id % 17 <> 0"), "n_chars")


def joi33_report_changes(spark, sf):
    return _reports(spark, sf)


def srt12_trend_rows(spark, sf):
    return O.trend_rows(_reports(spark, sf))


def joi38_nearest_base(spark, sf):
    inv = inventory(spark, sf)
    bases = inv.where("doc_id % 40 = 3 or source in ('src1', 'src2')").select(F.explode(F.array(F.when(_k() % 40 == 3, F.substring_index("path", "/", 2)), "source")).alias("path")).where("path <> 'src0' and path not like 'src1/%'")
    return O.nearest_base(inv, bases)


def _tree(spark, sf):
    inv = inventory(spark, sf)
    every = inv.select(F.explode(F.array_union(ancestors(F.col("path")), F.array("path"))).alias("path")).where("path <> ''").distinct()
    return inv, every.select("path", (F.ascii(F.reverse("path")) % 5).alias("place"))


def _siblings(spark, sf):
    """Parts as children of their brand; parts of one order that follow one another use each other."""
    kind = F.get(F.array(*map(F.lit, ["", ".test.", "fixtures", "", "scripts", ""])), (F.col("p_partkey") % 6).cast("int"))
    name = F.when(F.col("p_partkey") % 30 == 4, "scripts").when(F.col("p_partkey") % 30 == 10, "tests").otherwise(F.concat(F.lit("c"), F.col("p_partkey") % 97, kind))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("dir"), name.alias("name"), (F.col("p_partkey") % 4 == 0).alias("is_dir"), F.when(F.col("p_partkey") % 19 == 3, F.col("p_size")).alias("head"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("next"))
    ends = [parts.select(F.col("key").alias(c), F.col("dir").alias(f"{n}_dir"), F.col("name").alias(n)) for c, n in (("l_partkey", "src"), ("next", "dst"))]
    edges = lines.join(ends[0], "l_partkey").join(ends[1], "next").where("src_dir = dst_dir").select(F.col("src_dir").alias("dir"), "src", "dst").distinct()
    return parts.select("dir", "name", "is_dir", "head"), edges


def grf3_reading_order(spark, sf):
    return R.reading_order(*_siblings(spark, sf))


def grf4_preorder(spark, sf):
    return O.preorder(_tree(spark, sf)[1])


def grf5_first_files(spark, sf):
    inv, nodes = _tree(spark, sf)
    return O.first_files(O.preorder(nodes), inv)


def joi9_references(spark, sf):
    d = table(spark, sf, "documents")
    references = d.select("doc_id", F.when(_k() % 3 == 0, F.concat_ws("/", "lang", (_k() * 7 % 1500).cast("string"))).otherwise((_k() * 3 % 1700).cast("string")).alias("reference"))
    return L.resolved(references, inventory(spark, sf), ["src1/", "src0/", "src0/en/", ""], ["", ".md"])


def prj4_without_glob(spark, sf):
    tail = F.get(F.array(*[F.lit(t) for t in ("", "/", "/*", "-*", "/*/x", "*", "*/", "-*-*", "*a/*", "//*")]), (_k() % 10).cast("int"))
    return inventory(spark, sf).select("doc_id", O.without_glob(F.concat("path", tail)).alias("path"))


def prj5_search_bases(spark, sf):
    return inventory(spark, sf).select("doc_id", F.array_join(O.search_bases(F.when(_k() % 4 == 0, "").when(_k() % 4 == 1, F.col("source")).otherwise(F.col("path"))), ",").alias("bases"))


QUERIES = {name: plan for name, plan in list(globals().items()) if name.split("_")[0][-1:].isdigit()}

UP = "array_to_string(list_slice(string_split({p}, '/'), 1, i::int), '/')"
REPORTS = f"""{INV}, b as (select doc_id, path, case when doc_id % 4 = 0 then sha1(blob) when doc_id % 9 = 0 then null else blob end as old, n_chars + doc_id % 7 - 3 as before from inv where doc_id % 13 <> 0), a as (select doc_id, path, blob as new, n_chars as after from inv where doc_id % 17 <> 0),
 r as (select path, case when b.doc_id is null then 'added' when a.doc_id is null then 'removed' when old <> new then 'changed' end as change, before, after from b full join a using (path))"""
CONCEPTS = r"""d as (select doc_id as k, sha1(coalesce(text, '')) as blob from documents), i as (select k::varchar as path, case when k % 6 = 0 then 'dir' else 'file' end as type, blob from d where k % 10 <> 7),
 c as (select 'c' || k as slug, sha1(blob) as stored, case when k % 8 = 0 then [k::varchar] else [(k + 2)::varchar, k::varchar, (k - 1)::varchar] end as sources from d where k % 4 = 0),
 e as (select slug, stored, sources[p] as path, p from c, lateral (select unnest(range(1, len(sources) + 1)) as p)),
 g as (select slug, stored, string_agg(blob, '' order by p) as blobs, coalesce(string_agg(case when blob is null then e.path end, ',' order by p), '') as broken, count(*) = count(blob) as whole,
 '[' || string_agg('{"source":"' || e.path || '","digest":"' || coalesce(type || ':' || blob, 'missing') || '"}', ',' order by p) || ']' || chr(10) as js from e left join i on e.path = i.path group by slug, stored),
 cs as (select slug, case when not whole then 'broken-source' when stored = sha1(blobs) then 'fresh' else 'outdated' end as status, case when whole then sha1(blobs) end as hash, broken, sha256(js) as snapshot from g)"""
PREORDER = f"""{INV}, every as (select distinct {UP.format(p='path')} as path from inv, range(1, 4) t(i)), steps as (select path, lpad((ascii(right(path, 1)) % 5)::varchar, 12, '0') || ' ' || string_split(path, '/')[-1] as step from every),
 sp as (select path, i, {UP.format(p='path')} as above from every, range(1, 4) t(i) where i <= len(string_split(path, '/'))), pre as (select sp.path, string_agg(step, chr(1) order by i) as key from sp join steps on sp.above = steps.path group by sp.path)"""

ORACLE_SQL = {
    "joi3_ignored_directories": f"""with h as (select case when doc_id % 4 = 0 then 'gen' else source end || '/' || lang || '/tmp' || (doc_id % 7) || '/' || doc_id as path from documents where doc_id % 10 = 4), s as (select source as path from documents where doc_id % 10 <> 4 union select source || '/' || lang from documents where doc_id % 10 <> 4)
 select distinct {UP.format(p='path')} as path from h, range(1, 4) t(i) where {UP.format(p='path')} not in (select path from s)""",
    "joi5_edited_moves": f"""with {INV} select case when doc_id % 5 <> 0 then 'old/' else 'older/' end || path as source, path as target, 50 + doc_id % 50 as similarity from inv where doc_id % 11 = 0 and doc_id % 33 <> 0 and (doc_id % 5 <> 0 or doc_id % 2 = 0)""",
    "joi5_contested_moves": f"""with {INV}, d as (select path as target, doc_id, 'm/' || lpad((doc_id * 13 % 101)::varchar, 3, '0') || '/' || path as s1, 'n/' || lpad((doc_id * 13 % 101)::varchar, 3, '0') || '/' || path as s2, 'a' || (doc_id * 5) % 7 as a1, 'a' || (3 + doc_id * 5) % 7 as a2 from inv where doc_id % 6 = 1),
 r as (select target, s1 as source, a1 as anchor, 90 as similarity from d where doc_id % 4 <> 1 union all select target, s2, a2, 80 from d), p as (select anchor, min(source) as place from r group by anchor)
 select source, target, similarity from r join p using (anchor) qualify row_number() over (partition by target order by place, anchor, source) = 1""",
    "joi6_voted_moves": f"""with m as (select 'old/' || source || '/' || lang || '/' || doc_id as src, case doc_id % 4 when 0 then 'new/' || source || '/' || lang || '/' || doc_id when 1 then 'new/' || source || '/x/' || doc_id when 2 then 'else/' || source || '/' || lang || '/' || doc_id else 'flat/' || doc_id end as dst
 from documents where doc_id % 4 <> 2 or doc_id % 3 <> 0), miss as (select distinct {UP.format(p='dst')} as path from m, range(1, 4) t(i) where i < len(string_split(dst, '/'))),
 a as (select src, dst, {UP.format(p='src')} as d from m, range(1, 4) t(i)), k as (select d, substr(dst, 1, length(dst) - length(src) + length(d)) as target_dir, src from a where ends_with(dst, substr(src, length(d) + 1))),
 v as (select d, target_dir, count(*) as votes, min(src) as f from k group by 1, 2 qualify row_number() over (partition by d order by votes desc, f) = 1)
 select d as source_dir, target_dir, votes from v where target_dir in (select path from miss) and target_dir not in ('', 'else') qualify row_number() over (partition by target_dir order by d) = 1""",
    "joi8_change_sizes": f"""with {INV}, c as (select path, doc_id, case when doc_id % 7 <> 0 then n_chars % 97 else 0 end as added, n_chars % 89 as removed from inv)
 select path, added, removed, 1 as files from c where doc_id % 10 = 0 union all select {UP.format(p='path')}, sum(added), sum(removed), count(*) from c, range(0, 3) t(i) where doc_id % 2 = 1 group by 1""",
    "joi10_reading_order": f"""with {INV}, kids as (select distinct '' as dir, source as name from inv union select distinct source, lang from inv), o as (select dir, unnest(['en', 'DE', 'Fr', 'xx', 'SRC0', 'src1']) as name from (select distinct dir from kids))
 select o.dir, o.name, (select min(k.name) from kids k where k.dir = o.dir and lower(k.name) = lower(o.name)) as suggestion from o where not exists (select 1 from kids k where k.dir = o.dir and k.name = o.name)""",
    "joi12_concepts": f"with {CONCEPTS} select slug, status, hash, broken, snapshot from cs",
    "agg2_concept_counts": f"with {CONCEPTS} select count(*) as total, count(*) filter (status = 'fresh') as fresh, count(*) filter (status = 'outdated') as outdated, count(*) filter (status = 'broken-source') as broken from cs",
    "agg28_health": f"""with {CONCEPTS}, {INV}, {NOTES}, {STATUS} select (select count(*) from st where status = 'outdated') as documents_outdated, (select count(*) from st where status = 'missing') as documents_missing, 0 as documents_ignored, (select count(*) from st) as documents,
 (select count(*) from cs where status = 'fresh') as concepts_fresh, (select count(*) from cs where status = 'outdated') as concepts_outdated, (select count(*) from cs where status = 'broken-source') as concepts_broken, (select count(*) from cs) as concepts,
 (select count(*) from documents where doc_id % 8 = 3) as broken_references, (select count(*) from notes n anti join inv i on n.path = i.path) as orphans""",
    "srt5_ordered_items": f"with {INV} select path as slug, case doc_id % 3 when 0 then 'done' when 1 then 'snoozed' else 'open' end as workflow, row_number() over (order by case doc_id % 3 when 2 then 0 when 1 then 1 else 2 end, doc_id) as rank from inv where doc_id % 10 = 4",
    "set1_all_files": f"with {INV} select path from inv where doc_id % 3 <> 0 or doc_id % 5 <> 1",
    "set9_changed_paths": f"with {INV} select path from inv where doc_id % 4 = 0 or doc_id % 6 = 0 or doc_id % 10 = 1",
    "set10_new_dirty": f"with {INV} select path from inv where doc_id % 2 = 0 and doc_id % 3 <> 0 and source <> 'src1'",
    "joi33_report_changes": f"with {REPORTS} select * from r where change is not null",
    "srt12_trend_rows": f"""with {REPORTS}, m as (select path, after - before as delta, case when after - before >= 1 then 'improved' when after - before <= -1 then 'worsened' end as direction from r where change = 'changed'),
 k as (select direction, row_number() over (partition by direction order by abs(delta) desc, path) as rank, path, delta, count(*) over (partition by direction) as n from m where direction is not null) select * from k where rank <= 10""",
    "joi38_nearest_base": f"""with {INV}, b as (select distinct source || '/' || lang as base from inv where doc_id % 40 = 3 and source <> 'src1' union select source from inv where (doc_id % 40 = 3 or source in ('src1', 'src2')) and source <> 'src0')
 select path, coalesce((select max_by(base, length(base)) from b where path = base or starts_with(path, base || '/')), '') as base from inv""",
    "grf3_reading_order": """with recursive p as (select p_partkey as key, p_brand as dir, p_partkey % 4 = 0 as is_dir, case when p_partkey % 19 = 3 then p_size end as head,
  case p_partkey % 30 when 4 then 'scripts' when 10 then 'tests' else 'c' || p_partkey % 97 || (['', '.test.', 'fixtures', '', 'scripts', ''])[p_partkey % 6 + 1] end as name from part),
 k as (select dir, name, bool_or(is_dir) as is_dir, min(head) as head from p group by all),
 nx as (select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as next from lineitem),
 hd as (select dir, name, row_number() over (partition by dir order by head, name) - 1 as place from k where head is not null), nh as (select dir, count(*) as n from hd group by dir),
 x as (select dir, name, is_dir, regexp_matches(name, '[.](test|spec)[.]|^tests?$|^__tests__$|fixtures|^test-(helpers|fixtures|utils)$|^scripts?$|^bin$|^tools?$|^examples?$|^benchmarks?$|^drizzle$|^migrations?$') as aux from k where head is null),
 e as (select distinct a.dir, a.name as src, b.name as dst from nx join p a on a.key = l_partkey join p b on b.key = next and b.dir = a.dir where a.name <> b.name),
 u as (select e.* from e join x s on s.dir = e.dir and s.name = e.src and not s.aux join x d on d.dir = e.dir and d.name = e.dst),
 s0 as (select x.dir, x.name, x.is_dir, x.aux, (select count(*) from u where u.dir = x.dir and u.dst = x.name) as waits, (select count(*) from u where u.dir = x.dir and u.src = x.name) as uses from x),
 w(dir, step, name, is_dir, aux, waits, uses, best) as (
  select dir, 0::bigint, name, is_dir, aux, waits, uses, row_number() over (partition by dir order by waits > 0, aux, -uses, not is_dir, name) from s0
  union all select dir, step, name, is_dir, aux, waits, uses, row_number() over (partition by dir order by waits > 0, aux, -uses, not is_dir, name) from (
   select w.dir, w.step + 1 as step, w.name, w.is_dir, w.aux, w.waits - (u.src is not null)::int as waits, w.uses from w join w p on p.dir = w.dir and p.best = 1 left join u on u.dir = w.dir and u.src = p.name and u.dst = w.name where w.best > 1))
 select dir, name, place from hd union all select w.dir, name, step + coalesce(nh.n, 0) from w left join nh using (dir) where best = 1""",
    "grf4_preorder": f"with {PREORDER} select path, key from pre",
    "grf5_first_files": f"with {PREORDER}, a as (select pre.path, key, {UP.format(p='pre.path')} as dir from pre join inv on pre.path = inv.path, range(0, 3) t(i)) select dir, min_by(path, key) as first from a group by dir",
    "joi9_references": f"""with {INV}, f as (select doc_id, case when doc_id % 3 = 0 then lang || '/' || (doc_id * 7 % 1500) else (doc_id * 3 % 1700)::varchar end as reference from documents), b as (select * from (values (0, 'src1/'), (1, 'src0/'), (2, 'src0/en/'), (3, '')) t(i, base)),
 h as (select f.doc_id, min_by(inv.path, i) as path from f, b join inv on inv.path = b.base || f.reference group by f.doc_id), u as (select doc_id::varchar as name, min(path) as path from inv group by 1 having count(*) = 1)
 select f.doc_id, f.reference, h.path, case when h.path is null then u.path end as suggestion from f left join h using (doc_id) left join u on u.name = string_split(f.reference, '/')[-1]""",
    "prj4_without_glob": f"""with {INV}, r as (select doc_id, path || (['', '/', '/*', '-*', '/*/x', '*', '*/', '-*-*', '*a/*', '//*'])[doc_id % 10 + 1] as p from inv), s as (select doc_id, case when ends_with(p, '/') then left(p, length(p) - 1) else p end as p from r),
 t as (select doc_id, case when ends_with(p, '/*') then left(p, length(p) - 2) when ends_with(p, '*') then left(p, length(p) - 1) else p end as p from s), u as (select doc_id, case when ends_with(p, '-*') then left(p, length(p) - 2) else p end as p from t) select doc_id, case when not contains(p, '*') then p end as path from u""",
    "prj5_search_bases": f"""with {INV}, a as (select doc_id, case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then source else path end as base from inv), u as (select doc_id, case when base = '' then [] else list_reverse(list_transform(range(1, len(string_split(base, '/')) + 1), lambda i: array_to_string(string_split(base, '/')[1:i], '/'))) end as ups from a)
 select doc_id, array_to_string(list_concat(flatten(list_transform(ups, lambda p: [p, p || '/src'])), ['', 'src']), ',') as bases from u""",
}
