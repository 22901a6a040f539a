"""Anchors in notes and sentences that readers flag, from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.paths import ancestors
from corpusloom.operators import anchors as A
from corpusloom.operators import consensus as S
from corpusloom.operators import references as R
from corpusloom.sources import table

SOURCE = [(". ", "\n"), (" the ", "\nfunction "), (" and ", "\nimport "), (" of ", "\nconst x = "), (" de ", "\n  def ")]


def _sources(spark, sf):
    text = F.coalesce("text", F.lit(""))
    for old, new in SOURCE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf, "documents").where("doc_id % 9 <> 4").select(F.concat(F.lit("p"), "doc_id").alias("path"), text.alias("text"))


def _notes(spark, sf):
    """Notes with five links: words of the text, words of another form, one in a fence, one in inline code, one with a blank."""
    k, words = F.col("doc_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{3,9}"), F.lit(0))
    word = lambda i: F.coalesce(F.get(words, i), F.lit("none"))
    body = F.concat(
        F.lit("# Note\n[a](code:"), word(3), F.lit(") and ![b](code:"), word(5), F.lit(".."), word(40), F.lit(")\n```\n[c](code:zzz9)\n```\n"), F.when(k % 2 == 0, "`[d](code:x)` ").otherwise(""),
        F.lit("[e](code:"), F.substring(word(7), 2, 3), F.lit("%20"), F.lit("..)\n"), F.when(k % 3 == 0, F.concat(F.lit("see [f](code:two "), word(1), F.lit(")\n"))).otherwise(""), F.lit("[g](code:gone_"), k % 5, F.lit(' "title") [h](http://x)'))
    return table(spark, sf, "documents").select(F.concat(F.lit("p"), k).alias("path"), F.when(k % 8 == 0, "dir").otherwise("file").alias("type"), body.alias("body"))


def anchor_findings(spark, sf):
    return A.anchor_findings(_notes(spark, sf), _sources(spark, sf))


def anchor_counts(spark, sf):
    return A.finding_counts(anchor_findings(spark, sf))


def marker_lines(spark, sf):
    """Where each marker leads."""
    links = A.code_links(_notes(spark, sf)).select("path", F.explode(F.array_compact(F.array("start", "end"))).alias("marker")).distinct()
    sources = _sources(spark, sf).select("path", F.split("text", "\n", -1).alias("lines"))
    return links.join(sources, "path").select("path", "marker", A.find_line(F.col("lines"), F.col("marker")).alias("line"))


def _referring(spark, sf):
    """Notes on files and directories of a tree by source and language, which name files from several places, some that were moved."""
    k = F.col("doc_id")
    tree = lambda n, ending: F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/src/"), n.cast("string"), F.lit(ending))
    refs = [
        F.concat("lang", F.lit("/src/"), k, F.lit(".ts")), F.concat(F.lit("src/"), k + 40, F.lit(".js")), F.concat(F.lit("src/"), k, F.lit("/")), F.concat(k * 3, F.lit(".ts")), F.concat(F.lit("old/"), k, F.lit(".ts")),
        F.concat("source", F.lit("/"), "lang", F.lit("/src/*")), F.lit("a/b/c"), F.lit("x.y/z1"), F.concat(F.lit("gone/"), k + 1, F.lit(".ts")), F.concat(F.lit("m"), k, F.lit(".tsx")),
    ]
    body = F.concat(*[F.concat(F.lit(" `"), r, F.lit("`")) for r in refs], F.lit("\n```\n`in/fence1`\n```\n"))
    d = table(spark, sf, "documents")
    notes = d.where("doc_id % 3 > 0").select(F.when(k % 5 == 0, F.concat_ws("/", "source", "lang")).otherwise(tree(k, ".ts")).alias("path"), F.when(k % 5 == 0, "dir").otherwise("file").alias("type"), body.alias("body"), k.alias("doc_id"))
    files = d.where("doc_id % 4 > 0").select(tree(k, ".ts").alias("path"))
    directories = files.select(F.explode(ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()
    moves = d.where("doc_id % 7 = 1").select(F.concat(F.col("source"), F.lit("/old/"), k, F.lit(".ts")).alias("source"), F.concat(F.lit("new/"), k, F.lit(".ts")).alias("target")).union(d.where("doc_id % 9 = 2").select(F.concat(F.lit("old/m"), k, F.lit(".tsx")), F.concat(F.lit("new/m"), k)))
    return notes, files.withColumn("type", F.lit("file")).unionByName(directories.withColumn("type", F.lit("dir"))), moves


def broken_references(spark, sf):
    notes, inventory, moves = _referring(spark, sf)
    one = notes.groupBy("path", "type").agg(F.min_by("body", "doc_id").alias("body"))
    return R.broken_references(one, inventory, moves)


def page_links(spark, sf):
    notes, inventory, _ = _referring(spark, sf)
    one = notes.groupBy("path", "type").agg(F.min_by("body", "doc_id").alias("body"))
    return R.page_links(one, inventory)


def _flagged(spark, sf):
    """Whole texts as flagged sentences: forty documents are a note, told by four readers."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(F.floor(k / 40).alias("group"), (k % 4).alias("reader"), k.alias("key"), F.coalesce("text", F.lit("")).alias("sentence"))


def similar_sentences(spark, sf):
    return S.similar_pairs(_flagged(spark, sf), "group", "key", "sentence", 0.55).withColumn("dice", F.round("dice", 6))


def consensus_sentences(spark, sf):
    return S.consensus(_flagged(spark, sf), above=0.55, least=2)


QUERIES = {"txt8_anchor_findings": anchor_findings, "txt8_anchor_counts": anchor_counts, "str15_marker_lines": marker_lines, "joi9_broken_references": broken_references, "joi39_page_links": page_links, "mth3_similar_sentences": similar_sentences, "txt13_consensus": consensus_sentences}


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


_TEXT = "coalesce(text, '')"
for _old, _new in SOURCE:
    _TEXT = f"replace({_TEXT}, {_quoted(_old)}, {_quoted(_new)})"

MARKERS = f"""s as (select doc_id, 'p' || doc_id as path, string_split({_TEXT}, chr(10)) as lines from documents where doc_id % 9 <> 4), w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]{{3,9}}') as w from documents),
 m as (select doc_id, coalesce(w[4], 'none') as a, coalesce(w[6], 'none') as b, coalesce(w[41], 'none') as c, trim(substr(coalesce(w[8], 'none'), 2, 3)) as e, 'gone_' || doc_id % 5 as g, coalesce(w[2], 'none') as o from w),
 k as (select doc_id, 'p' || doc_id as path, unnest([2, 2, 2, 6, 7 + (doc_id % 3 = 0)::int]) as line, unnest([a, b, c, e, g]) as marker, unnest(['[a](code:' || a || ')', '![b](code:' || b || '..' || c || ')', '![b](code:' || b || '..' || c || ')', '[e](code:' || e || '%20..)', '[g](code:' || g || ' "title")']) as raw, o from m),
 x as (select distinct k.doc_id, k.path, k.marker, unnest(lines) as l, unnest(range(1, len(lines) + 1)) as i from k join s using (path) where k.doc_id % 8 <> 0),
 f as (select doc_id, path, marker, coalesce(min(i) filter (regexp_matches(l, '\\b(?:function|class|interface|type|enum|const|let|var|def|fn)\\s+' || marker || '\\b')), min(i) filter (not regexp_matches(l, '^\\s*import\\b') and regexp_matches(l, '\\b' || marker || '\\b')),
  min(i) filter (not regexp_matches(l, '^\\s*import\\b') and contains(l, marker))) as line from x group by all)"""
FINDINGS = f"""{MARKERS}, fs as (select 'rot' as kind, k.path, k.line, k.marker, k.raw as anchor from k join f on f.path = k.path and f.marker = k.marker where f.line is null
 union all select 'parse', 'p' || doc_id, 6, null, trim('`[d](code:x)` [e](code:' || e || '%20..)') from m where doc_id % 2 = 0 union all select 'parse', 'p' || doc_id, 7, null, 'see [f](code:two ' || o || ')' from m where doc_id % 3 = 0
 union all select 'missing-source', 'p' || doc_id, null, null, null from m where doc_id % 9 = 4 and doc_id % 8 <> 0)"""
PAIRS = """fl as (select doc_id // 40 as g, doc_id % 4 as reader, doc_id as key, coalesce(text, '') as t from documents), gm as (select g, key, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) as gram from fl where length(t) > 1),
 cn as (select g, key, gram, count(*) as n from gm group by all), tt as (select g, key, sum(n) as n from cn group by all), cm as (select x.g, x.key as a, y.key as b, sum(least(x.n, y.n)) as c from cn x join cn y on x.g = y.g and x.gram = y.gram and x.key <= y.key group by all),
 pr as (select cm.g, a, b, 2 * c / (u.n + v.n) as dice from cm join tt u on u.g = cm.g and u.key = a join tt v on v.g = cm.g and v.key = b where 2 * c / (u.n + v.n) > 0.55)"""

#: Notes, references by kind, and the tree they are looked for in.
REFERRING = """fl as (select source || '/' || lang || '/src/' || doc_id || '.ts' as path from documents where doc_id % 4 > 0), dr as (select distinct unnest([source, source || '/' || lang, source || '/' || lang || '/src']) as path from documents where doc_id % 4 > 0), inv as (select path from fl union select path from dr),
 mv as (select source || '/old/' || doc_id || '.ts' as src, 'new/' || doc_id || '.ts' as dst from documents where doc_id % 7 = 1 union all select 'old/m' || doc_id || '.tsx', 'new/m' || doc_id from documents where doc_id % 9 = 2),
 n0 as (select case when doc_id % 5 = 0 then source || '/' || lang else source || '/' || lang || '/src/' || doc_id || '.ts' end as path, case when doc_id % 5 = 0 then source || '/' || lang else source || '/' || lang || '/src' end as base, * exclude (text, n_chars) from documents where doc_id % 3 > 0),
 nt as (select * from n0 qualify row_number() over (partition by path order by doc_id) = 1),
 rf as (select path, base, doc_id, unnest([lang || '/src/' || doc_id || '.ts', 'src/' || (doc_id + 40) || '.js', 'src/' || doc_id || '/', doc_id * 3 || '.ts', 'old/' || doc_id || '.ts', source || '/' || lang || '/src/*', 'a/b/c', 'x.y/z1', 'gone/' || (doc_id + 1) || '.ts', 'm' || doc_id || '.tsx']) as ref, unnest(range(1, 11)) as kind from nt),
 rt as (select *, regexp_replace(regexp_replace(ref, '/$', ''), '/?[*]$', '') as target, string_split(base, '/') as b from rf)"""

ORACLE_SQL = {
    "joi9_broken_references": f"""with {REFERRING}, ok as (select * from rt where kind not in (6, 7, 8)), up as (select *, list_concat(list_reverse(list_transform(range(1, len(b) + 1), lambda i: array_to_string(b[1:i], '/'))), ['']) as ups from ok),
 pl as (select path, ref, target, kind, unnest(list_transform(ups, lambda u: case when u = '' then target else u || '/' || target end)) as p1, unnest(list_transform(ups, lambda u: case when u = '' then 'src/' || target else u || '/src/' || target end)) as p2, unnest(range(0, len(ups))) as r from up),
 pp as (select path, ref, target, kind, p1 as p, 2 * r as r from pl union all select path, ref, target, kind, p2, 2 * r + 1 from pl), al as (select path, ref, unnest(case when kind = 2 then [p, replace(p, '.js', '.ts'), replace(p, '.js', '.tsx')] when kind = 3 then [p, p || '.ts', p || '.tsx', p || '.js', p || '/index.ts'] else [p] end) as f from pp),
 hit as (select distinct path, ref from al where f in (select path from inv)), nm as (select string_split(path, '/')[-1] as name, count(*) as n, min(path) as sole from fl group by 1), fm as (select path, ref, arg_min(dst, r) as formerly from pp join mv on mv.src = pp.p group by all),
 bn as (select string_split(src, '/')[-1] as name, arg_min(dst, src) as renamed from mv group by 1)
 select ok.path, ok.ref, case when not contains(target, '/') then renamed else coalesce(formerly, case when n = 1 then sole end) end as suggestion from ok anti join hit on hit.path = ok.path and hit.ref = ok.ref left join nm on nm.name = string_split(target, '/')[-1] left join fm on fm.path = ok.path and fm.ref = ok.ref
  left join bn on bn.name = string_split(target, '/')[-1] where contains(target, '/') or n is null""",
    "joi39_page_links": f"""with {REFERRING}, tr as (select path, ref, unnest([target, base || '/' || target, array_to_string(b[1:len(b) - 1], '/') || '/' || target]) as link, unnest([0, 1, 2]) as r from rt)
 select path, ref as code, arg_min(link, r) as link from tr where link <> path and link in (select path from inv) group by all""",
    "txt8_anchor_findings": f"with {FINDINGS} select * from fs",
    "txt8_anchor_counts": f"with {FINDINGS} select count(*) as total, count(*) filter (kind = 'parse') as parse_failures, count(*) filter (kind = 'rot') as rot_markers, count(*) filter (kind = 'missing-source') as missing_sources from fs",
    "str15_marker_lines": f"""with {MARKERS.replace("where k.doc_id % 8 <> 0", "")} select path, marker, line from f""",
    "mth3_similar_sentences": f'with {PAIRS} select g as "group", a, b, round(dice, 6) as dice from pr',
    "txt13_consensus": f"""with recursive {PAIRS}, bo as (select g, a as key, b as other from pr union select g, b, a from pr), rd as (select bo.g, bo.key, count(distinct reader) as readers, count(distinct other) as flags from bo join fl on fl.g = bo.g and fl.key = bo.other group by all having count(distinct reader) >= 2),
 od as (select *, row_number() over (partition by g order by key) as k from rd), w(g, k, key, kept, reps) as (select g, 0::bigint, null::bigint, false, []::bigint[] from (select distinct g from od)
  union all select g, k, key, ok, case when ok then list_append(reps, key) else reps end from (select w.g, od.k, od.key, w.reps, not list_has_any(w.reps, (list_filter(n.others, lambda x: x <> od.key))) as ok from w join od on od.g = w.g and od.k = w.k + 1 join (select g, key, list(other) as others from bo group by all) n on n.g = od.g and n.key = od.key))
 select w.g::varchar as "group", w.key::varchar as key, readers, flags from w join rd on rd.g = w.g and rd.key = w.key where kept""",
}
