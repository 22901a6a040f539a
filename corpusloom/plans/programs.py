"""Globs and imports over ``documents`` as files of a repository."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.paths import ancestors
from corpusloom.operators import globs as G
from corpusloom.operators import imports as I
from corpusloom.sources import table


def _files(spark, sf):
    k = F.col("doc_id")
    ending = F.when(k % 5 == 0, ".md").when(k % 5 == 1, ".test.ts").when(k % 5 == 2, "").otherwise(".ts")
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat(F.concat_ws("/", "source", "lang", k.cast("string")), ending).alias("path"))


def _globs(spark, sf):
    """A glob for each nation, in five forms."""
    k = F.col("n_nationkey")
    glob = (
        F.when(k % 5 == 0, F.concat(F.lit("src"), k, F.lit("/**"))).when(k % 5 == 1, F.concat(F.lit("src"), k, F.lit("/{en,fr}/*.md"))).when(k % 5 == 2, F.concat(F.lit("**/*"), k, F.lit("?.test.ts")))
        .when(k % 5 == 3, F.concat(F.lit("src["), k % 10, F.lit("-9]/*/*1*"))).otherwise(F.concat(F.lit("**/"), k * 7, F.lit(".ts")))
    )
    return table(spark, sf, "nation").select(k.cast("string").alias("id"), F.col("n_regionkey").alias("region"), glob.alias("glob"))


def glob_matches(spark, sf):
    return G.matches(_files(spark, sf), _globs(spark, sf)).select("id", "path")


def _assigned(spark, sf):
    files = _files(spark, sf)
    rows = _globs(spark, sf).groupBy("region").agg(F.collect_set("glob").alias("include"))
    assignments = rows.select(F.concat(F.lit("a"), "region").alias("id"), F.when(F.col("region") % 2 == 0, "text").otherwise("style").alias("domain"), F.concat(F.lit("u"), "region").alias("unit"), "include")
    units = table(spark, sf, "region").where("r_regionkey <> 3").select(F.when(F.col("r_regionkey") % 2 == 0, "text").otherwise("style").alias("domain"), F.concat(F.lit("u"), "r_regionkey").alias("slug"))
    return G.assign_paths(files.where("doc_id % 3 = 0"), files.where("doc_id % 3 = 1"), files.where("doc_id % 7 = 2 and doc_id % 3 = 2"), assignments, units)


def assigned_paths(spark, sf):
    return _assigned(spark, sf)[0]


def assignment_diagnostics(spark, sf):
    return _assigned(spark, sf)[1]


def review_targets(spark, sf):
    globs = _globs(spark, sf)
    k = F.col("id").cast("int")
    pick = lambda n: F.collect_list(F.when(k % 3 == n, F.col("glob")))
    units = globs.groupBy(F.concat(F.lit("u"), "region").alias("slug")).agg(pick(0).alias("include"), pick(1).alias("exclude"), pick(2).alias("context"))
    return G.review_targets(_files(spark, sf), units, ["slug"])


def _programs(spark, sf):
    """Files whose text imports others beside them, above them, by package and in vain; every tenth source is a package."""
    k, files = F.col("doc_id"), _files(spark, sf)
    beside = F.when(k % 4 == 0, F.concat(F.lit("./"), k + 1)).when(k % 4 == 1, F.concat(F.lit("./"), k - 1, F.lit(".js"))).when(k % 4 == 2, F.concat(F.lit("../../"), "source", F.lit("/./"), "lang", F.lit("//"), k + 2, F.lit(".md"))).otherwise(F.concat(F.lit("../../../"), "source"))
    text = F.concat(F.lit("import x from '"), beside, F.lit("'\nconst y = require(\"@org/src"), k % 30, F.lit("/deep\")\nexport * from 'src1'; import('./"), k, F.lit("'); // from \"plain"), F.lit("\" important 'none'"))
    packages = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("@org/src"), "n_nationkey")).otherwise(F.concat(F.lit("src"), "n_nationkey")).alias("name"), F.concat(F.lit("src"), "n_nationkey").alias("root"))
    return files.select("path", text.alias("text")), packages


def import_edges(spark, sf):
    return I.import_edges(*_programs(spark, sf))


def relations(spark, sf):
    files, packages = _programs(spark, sf)
    nodes = files.select("path", F.lit("file").alias("type")).union(files.select(F.explode(ancestors(F.col("path"))), F.lit("dir"))).distinct()
    return I.relations(nodes, I.import_edges(files, packages), packages)


def normalized_paths(spark, sf):
    k = F.col("doc_id")
    raw = F.concat_ws("/", "source", F.when(k % 3 == 0, "..").when(k % 3 == 1, "."), "lang", F.when(k % 4 == 0, "../..").when(k % 4 == 1, "..x"), F.when(k % 5 == 0, "../../..").when(k % 5 == 1, ""), k.cast("string"))
    return table(spark, sf, "documents").select("doc_id", I.normalized(raw).alias("path"))


QUERIES = {
    "joi17_glob_matches": glob_matches, "joi15_assigned_paths": assigned_paths, "joi15_diagnostics": assignment_diagnostics, "joi31_review_targets": review_targets,
    "joi11_import_edges": import_edges, "joi37_relations": relations, "str3_normalized_paths": normalized_paths,
}

FILES = "fl as (select doc_id, source, lang, source || '/' || lang || '/' || doc_id || case doc_id % 5 when 0 then '.md' when 1 then '.test.ts' when 2 then '' else '.ts' end as path from documents)"
#: Each glob as a regular expression of its own form.
GLOBS = """gl as (select n_nationkey::varchar as id, n_nationkey as k, n_regionkey as region, case n_nationkey % 5 when 0 then '^src' || n_nationkey || '/.*$' when 1 then '^src' || n_nationkey || '/(en|fr)/[^/]*[.]md$' when 2 then '^(.*/)?[^/]*' || n_nationkey || '[^/][.]test[.]ts$'
  when 3 then '^src[' || n_nationkey % 10 || '-9]/[^/]*/[^/]*1[^/]*$' else '^(.*/)?' || n_nationkey * 7 || '[.]ts$' end as re from nation),
 mt as (select id, k, region, path, doc_id from fl, gl where regexp_matches(path, re))"""
ASSIGNED = f"""{FILES}, {GLOBS}, hs as (select path from fl where doc_id % 3 = 0), ra as (select distinct region, path, doc_id from mt), cn as (select hs.path, count(ra.region) as n, min(ra.region) as region from hs left join ra using (path) group by hs.path)"""
EDGES = f"""{FILES}, im as (select doc_id, path, source, lang, case doc_id % 4 when 0 then [source || '/' || lang || '/' || (doc_id + 1)] when 1 then [source || '/' || lang || '/' || (doc_id - 1) || '.js', source || '/' || lang || '/' || (doc_id - 1) || '.ts', source || '/' || lang || '/' || (doc_id - 1) || '.tsx']
  when 2 then [source || '/' || lang || '/' || (doc_id + 2) || '.md'] else []::varchar[] end as cs from fl where regexp_matches(path, '[.]ts$')),
 ca as (select path, source, lang, doc_id, case when doc_id % 4 = 0 then list_concat(cs, list_transform(['.ts', '.tsx', '.js', '.mjs', '.cjs', '.jsx', '/index.ts', '/index.tsx', '/index.js'], lambda e: cs[1] || e)) else cs end as cs from im),
 ow as (select path, source || '/' || lang || '/' || doc_id as c from im), ex as (select path, unnest(cs) as c, unnest(range(0, len(cs))) as i from ca),
 hit as (select path, arg_min(c, i) as dst from ex where c in (select path from fl) group by path),
 self as (select ow.path, min(f.path) as dst from ow join fl f on f.path = ow.c or f.path = ow.c || '.ts' group by ow.path),
 pk as (select path, 'src' || doc_id % 30 as dst from im where doc_id % 30 < 25 and doc_id % 30 % 2 = 0 union select path, 'src1' from im),
 ed as (select path as src, dst from (select * from hit union select * from self union select * from pk) where path <> dst)"""
UP = "list_filter(list_transform(range(1, len(string_split({p}, '/')) + 1), lambda i: array_to_string(string_split({p}, '/')[1:i], '/')), lambda x: x <> '')"

ORACLE_SQL = {
    "joi17_glob_matches": f"with {FILES}, {GLOBS} select id, path from mt",
    "joi15_assigned_paths": f"with {ASSIGNED} select 'a' || region as id, case when region % 2 = 0 then 'text' else 'style' end as domain, 'u' || region as unit, path from cn where n = 1",
    "joi15_diagnostics": f"""with {ASSIGNED} select path, case when n = 0 then 'unmapped' else 'ambiguous' end as code, null as id from cn where n <> 1 union all select null, 'empty', 'a' || region from (select distinct region from gl) where region not in (select region from cn where n = 1)
 union all select path, 'current-overlap', 'a' || region from ra where doc_id % 3 = 1 union all select path, 'receipt-overlap', 'a' || region from ra where doc_id % 7 = 2 and doc_id % 3 = 2 union all select null, 'unknown-unit', 'a3' where exists (select 1 from gl where region = 3)""",
    "joi31_review_targets": f"""with {FILES}, {GLOBS}, tg as (select distinct region, path from mt where k % 3 = 0 except select region, path from mt where k % 3 = 1)
 select 'u' || region as slug, path, 'target' as role from tg union all select 'u' || region, path, 'context' from (select region, path from mt where k % 3 = 2 except select region, path from tg)""",
    "joi11_import_edges": f"with {EDGES} select src, dst from ed",
    "joi37_relations": f"""with {EDGES}, dirs as (select distinct unnest([source, source || '/' || lang]) as path from fl), nd as (select path, true as is_file from fl union select path, false from dirs),
 cr as (select unnest(list_filter({UP.format(p='src')}, lambda x: not list_contains({UP.format(p='dst')}, x))) as node, dst as other, 'uses' as direction from ed union select unnest(list_filter({UP.format(p='dst')}, lambda x: not list_contains({UP.format(p='src')}, x))), src, 'used-by' from ed),
 gr as (select node, direction, other, is_file, string_split(other, '/')[1] as og, string_split(node, '/')[1] as ng from cr join nd on nd.path = node),
 ot as (select distinct node, direction, case when is_file then other when og <> ng then og end as other from gr) select * from ot where other is not null and other <> node and other in (select path from nd)""",
    "str3_normalized_paths": """with s as (select doc_id, source, lang, case doc_id % 3 when 0 then [lang] else [source, lang] end as a from documents),
 b as (select doc_id, case doc_id % 4 when 0 then a[1:len(a) - 2] when 1 then list_append(a, '..x') else a end as a, case when doc_id % 4 = 0 then greatest(0, 2 - len(a)) else 0 end as up from s),
 c as (select doc_id, case when doc_id % 5 = 0 then a[1:greatest(0, len(a) - 3)] else a end as a, up + case when doc_id % 5 = 0 then greatest(0, 3 - len(a)) else 0 end as up from b)
 select doc_id, case when up = 0 then array_to_string(list_append(a, doc_id::varchar), '/') end as path from c""",
}
