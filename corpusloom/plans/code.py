"""Program-text queries. No table holds programs, so ``documents`` become texts with comments, strings, braces and indents by fixed replacements."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.functions import text as T
from corpusloom.operators import programs as P
from corpusloom.sources import table

REPLACED = [("the", "// "), ("ou", "/*"), ("en", "*/"), ("\nL", "\n# L"), ("\nA", "\n  A"), ("\nD", "\n\t  D"), (" e", " getE")]
#: Texts with functions: in braces, and indented.
BRACED = [
    ("\n", " // "), (". ", ";\n"), (" the ", "\nfunction the(a) {\n"), (", ", "\n}\n"), (" of ", "\n  if (of == 1) {"), (" in ", "\n}} /* x */ export in from 'y'"),
    ("that", "const that = (x) => {"), (" de ", "\n\tpublic de_Ge(x): int {\n"), (" ch", "\n} else {"), (" for ", "\nfor (;;) "), (" to ", " let to = async x => { "), (" a ", " // a(b);\n"), ("ing ", " fooBar_X "), (" y ", "\n\u00a0\n"),
]
INDENTED = [
    ("\n", " # "), (". ", "\n"), (" the ", "\ndef the(x):\n    "), (", ", "\n        if "), (" of ", "\n\n"), ("that", "\n  async def that("), (" de ", "\n\tdef de_Ge(x): # x\n\t\t"), (" ch", "\n    # todo: x()\n    while "), (" y ", " \"\"\" y \n"), (" to ", " or match "),
]


WALLS = [(". ", "\n"), ("\nT", "\n#### T"), ("\nA", "\n##### A"), ("\nO", "\n#### "), ("\nS", "\n####S"), ("edth", '<div class="callout" x')]


def _replaced(spark, sf, replaced):
    text = F.coalesce("text", F.lit(""))
    for old, new in replaced:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


def _programs(spark, sf):
    text = F.coalesce("text", F.lit(""))
    for old, new in REPLACED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf, "documents").select("doc_id", F.translate(text, "kwqv", "{}\"'").alias("text"))


def _masked(df, key, family):
    return df.select(key, C.masked(F.col("text"), C.FAMILIES[family]).alias("m")).select(key, F.col("m.code").alias("code"), F.col("m.comment").alias("comment"))


def _digest(df, key):
    filled = lambda c: F.size(F.filter(c, lambda x: F.trim(x) != ""))
    digests = [F.sha1(F.array_join(c, "\n")).alias(f"{c}_sha1") for c in ("code", "comment")]
    return df.select(key, F.size("code").alias("lines"), filled("code").alias("code_lines"), filled("comment").alias("comment_lines"), *digests)


def txt1_masked_lines(spark, sf):
    return _digest(_masked(_programs(spark, sf), "doc_id", "c"), "doc_id")


def txt1_masked_python(spark, sf):
    return _digest(_masked(_programs(spark, sf), "doc_id", "python"), "doc_id")


def txt1_masked_markup(spark, sf):
    return _digest(_masked(table(spark, sf, "pages").select("page_id", F.col("html").alias("text")), "page_id", "markup"), "page_id")


def win8_brace_depth(spark, sf):
    return _masked(_programs(spark, sf), "doc_id", "c").select("doc_id", C.deepest_brace(F.col("code")).alias("depth"))


def txt4_indent_depth(spark, sf):
    return _masked(_programs(spark, sf), "doc_id", "hash").select("doc_id", C.deepest_indent(F.col("code")).alias("depth"))


def agg13_comment_coherence(spark, sf):
    found = _masked(_programs(spark, sf), "doc_id", "c").select("doc_id", C.coherence(F.col("code"), F.col("comment")).alias("c"))
    return found.select("doc_id", "c.words", "c.hits", F.round(F.try_divide("c.hits", "c.words"), 6).alias("coherence"))


def txt2_functions(spark, sf):
    return P.functions(_replaced(spark, sf, BRACED), "doc_id", "c")


def txt2_indented_functions(spark, sf):
    return P.functions(_replaced(spark, sf, INDENTED), "doc_id", "python")


def srt4_largest_functions(spark, sf):
    return P.largest_functions(P.functions(_replaced(spark, sf, BRACED), "doc_id", "c"), "doc_id", 10).select("doc_id", "name", "line", "lines", "max_nesting", "branches")


FEATURES = "blank_ratio comment_ratio inline_comment_ratio commented_out_ratio line_len_mean line_len_sd branches_per_100 ident_avg_len ident_short_ratio dominant_share token_entropy halstead_per_line comment_coherence barrel_ratio".split()


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in FEATURES})


def txt3_file_features(spark, sf):
    return _rounded(P.file_features(_replaced(spark, sf, BRACED), "doc_id", "c"))


def txt3_python_features(spark, sf):
    return _rounded(P.file_features(_replaced(spark, sf, INDENTED), "doc_id", "python"))


def agg12_repeated_code(spark, sf):
    found = P.repeated_code(_replaced(spark, sf, BRACED), "doc_id", "c", size=2, least=4, least_chars=12)
    return found.withColumn("dup_ratio", F.round("dup_ratio", 6))


def str16_block_ends(spark, sf):
    """The block that each of the first forty lines opens."""
    lines = _replaced(spark, sf, BRACED).select("doc_id", T.lines(F.col("text")).alias("l"))
    starts = lines.select("doc_id", "l", F.explode(F.sequence(F.lit(1), F.least(F.size("l"), F.lit(40)))).alias("line"))
    return starts.select("doc_id", "line", C.block_end(F.col("l"), F.col("line"), 20).alias("end_line"))


def txt5_read_states(spark, sf):
    """Files named by source and language; an x stands for the zero character."""
    endings = F.when(F.col("lang") == "en", "ts").when(F.col("lang") == "de", "PY").when(F.col("lang") == "fr", "txt").otherwise("sql")
    path = F.concat("source", F.lit("/"), F.col("doc_id"), F.lit("."), endings)
    text = F.replace(F.col("text"), F.lit("zz"), F.lit("\0"))
    return table(spark, sf, "documents").select("doc_id", P.read_state(path, text, most_bytes=8000, looked_at=100).alias("state"))


def win9_walls(spark, sf):
    """Notes with headings of two to five marks and callouts."""
    text = F.coalesce("text", F.lit(""))
    for old, new in WALLS:
        text = F.replace(text, F.lit(old), F.lit(new))
    sizes = table(spark, sf, "documents").select("doc_id", C.section_sizes(text).alias("s"))
    return sizes.select("doc_id", "s.lines", "s.longest", C.is_wall(F.col("s"), 8, 60).alias("wall"))


def win9_sections(spark, sf):
    return _programs(spark, sf).select("doc_id", F.posexplode(C.sections(F.col("text"))).alias("section", "lines"))


QUERIES = {name: plan for name, plan in list(globals().items()) if name.split("_")[0][-1:].isdigit()}


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _program_sql():
    text = "coalesce(text, '')"
    for old, new in REPLACED:
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    marks = _quoted("{}\"'")
    return f"t as (select doc_id as id, translate({text}, 'kwqv', {marks}) as text from documents)"


def _masked_sql(family):
    f = C.FAMILIES[family]
    ends = r"regexp_replace(x, '[^\n]+', '', 'g')"
    any_of = lambda marks: " or ".join(f"starts_with(x, {_quoted(m)})" for m in marks) or "false"
    comment = any_of([*f.line, *[b for b, _ in f.block]])
    quotes = _quoted("''")
    code = f"case when {comment} then {ends} when {any_of(f.quotes)} then {quotes} || {ends} else x end"
    return f"""p as (select id, regexp_extract_all(text, {_quoted(C.piece_pattern(f).replace("*+", "*"))}) as pieces from t),
 m as (select id, string_split(array_to_string(list_transform(pieces, lambda x: {code}), ''), chr(10)) as code, string_split(array_to_string(list_transform(pieces, lambda x: case when {comment} then x else {ends} end), ''), chr(10)) as comment from p)"""


def _replaced_sql(replaced):
    text = "coalesce(text, '')"
    for old, new in replaced:
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    return f"t as (select doc_id as id, {text} as text from documents)"


KEYWORDS, STOPWORDS = (", ".join(_quoted(w) for w in words) for words in (C.KEYWORDS, C.STOPWORDS))


def _filled(column):
    return f"regexp_matches({column}, {_quoted(C.FILLED)})"


_BRANCHES = f"len(regexp_extract_all(code, {_quoted(T.BRANCHES)}))"

#: Each line with its code and comment, and whether it is filled.
LINES_SQL = f"""ml as (select m.id, t.text, m.code, m.comment, unnest(range(1, len(m.code) + 1)) as i from m join t using (id)),
 l as (select id, i, string_split(text, chr(10))[i] as raw, code[i] as code, comment[i] as comment, {_filled("code[i]")} as has_code, {_filled("comment[i]")} as has_comment from ml)"""


def _start_sql():
    first = [f"regexp_extract(code, {_quoted(pattern)}, 1)" for pattern in C.FUNCTION_STARTS]
    return "case when contains(code, '{') then coalesce(" + ", ".join(f"case when {x} not in ('', {KEYWORDS}) then {x} end" for x in first) + ") end"


#: Regions (id, name, line, lines, base, top), walked line by line.
BRACED_SQL = f"""b as (select id, i, {_start_sql()} as starts, regexp_extract_all(code, '[{{}}]') as br from l),
 k as (select id, i, starts, list_transform(range(0, len(br) + 1), lambda n: len(list_filter(br[1:n], lambda x: x = '{{')) * 2 - n) as sums from b),
 o as (select id, i, starts, sums[-1] as d, list_min(sums) as low from k),
 w(id, i, depth, name, line, base, top, risen, n_done, c_name, c_line, c_lines, c_base, c_top) as (
  select id, 0::bigint, 0::bigint, null::varchar, 0::bigint, 0::bigint, 0::bigint, false, 0::bigint, null::varchar, null::bigint, null::bigint, null::bigint, null::bigint from t
  union all select id, i, after, case when not closed then name end, line, base, top, risen and not closed, n_done + closed::int, case when closed then name end, line, i - line + 1, base, top from (
   select *, name is not null and risen and after <= base as closed from (
    select *, was_risen or after > base as risen from (
     select w.id, o.i, w.n_done, greatest(w.depth + o.d, o.d - o.low) as after, case when w.name is null then case when w.n_done < 500 then o.starts end else w.name end as name,
      case when w.name is null then o.i else w.line end as line, case when w.name is null then w.depth else w.base end as base, case when w.name is null then w.depth else greatest(w.top, w.depth) end as top,
      w.name is not null and w.risen as was_risen from w join o on o.id = w.id and o.i = w.i + 1)))),
 n as (select id, max(i) as n from l group by id),
 f as (select id, c_name as name, c_line as line, c_lines as lines, c_top - c_base as nesting from w where c_name is not null
  union all select w.id, w.name, w.line, n.n - w.line + 1, w.top - w.base from w join n on n.id = w.id and n.n = w.i where w.name is not null)"""
INDENTED_SQL = f"""o as (select id, i, nullif(regexp_extract(code, {_quoted(C.INDENTED_START)}, 1), '') as starts, has_code, length(replace(regexp_extract(code, '^([ \t]*)', 1), chr(9), '    ')) as width from l),
 w(id, i, name, line, base, top, n_done, c_name, c_line, c_lines, c_base, c_top) as (
  select id, 0::bigint, null::varchar, 0::bigint, 0::bigint, 0::bigint, 0::bigint, null::varchar, null::bigint, null::bigint, null::bigint, null::bigint from t
  union all select id, i, case when goes_on then name when n_done + closed::int < 500 then starts end, case when goes_on then line else i end, case when goes_on then base else width end,
   case when goes_on then case when has_code then greatest(top, width) else top end else width end, n_done + closed::int, case when closed then name end, line, i - line, base, top from (
   select *, not goes_on and name is not null and i - 1 > line as closed from (select o.*, w.name, w.line, w.base, w.top, w.n_done, w.name is not null and (not o.has_code or o.width > w.base) as goes_on from w join o on o.id = w.id and o.i = w.i + 1))),
 n as (select id, max(i) as n from l group by id),
 f as (select id, c_name as name, c_line as line, c_lines as lines, greatest(0, floor((c_top - c_base - 1) / 4)) as nesting from w where c_name is not null
  union all select w.id, w.name, w.line, n.n - w.line + 1, greatest(0, floor((w.top - w.base - 1) / 4)) from w join n on n.id = w.id and n.n = w.i where w.name is not null and n.n > w.line)"""
#: Features are of every function; the lists of functions end with a file's five hundredth, as in the reference.
EVERY_BRACED_SQL = BRACED_SQL.replace("case when w.n_done < 500 then o.starts end", "o.starts")
EVERY_INDENTED_SQL = INDENTED_SQL.replace("when n_done + closed::int < 500 then starts end", "else starts end")
FUNCTIONS_SQL = f"""select f.id as doc_id, f.name, f.line, f.lines, max(length(l.raw)) as max_line_len, any_value(f.nesting)::int as max_nesting, sum({_BRANCHES}) as branches, count(*) filter (has_comment) as comment_lines
 from f join l on l.id = f.id and l.i between f.line and f.line + f.lines - 1 group by f.id, f.name, f.line, f.lines"""


def _features_sql(nesting):
    trimmed = f"regexp_replace(comment, {_quoted(f'^[{C.BLANK}]+|[{C.BLANK}]+$')}, '', 'g')"
    return f"""ll as (select id, length(raw) as n, row_number() over (partition by id order by length(raw)) as k, count(*) over (partition by id) as c from l where {_filled("raw")}),
 dist as (select id, c, avg(n) as mean, stddev_pop(n) as sd, min(n) filter (k >= least(c, floor(c * 0.5) + 1)) as p50, min(n) filter (k >= least(c, floor(c * 0.95) + 1)) as p95, max(n) as longest from ll group by id, c),
 cnt as (select id, count(*) as lines, count(*) filter ({_filled("raw")}) as nb, count(*) filter (has_code) as cl, count(*) filter (not has_code and has_comment) as co, count(*) filter (has_code and has_comment) as ic,
  count(*) filter (has_comment and not regexp_matches(regexp_replace({trimmed}, {_quoted(C.COMMENT_MARK)}, '', 'g'), {_quoted(C.NO_CODE)}) and regexp_matches({trimmed}, {_quoted(C.LOOKS_LIKE_CODE)})) as cm,
  sum({_BRANCHES}) as br, count(*) filter (regexp_matches(code, {_quoted(C.REEXPORT)})) as rx from l group by id),
 nm as (select id, i, unnest(list_filter(regexp_extract_all(code, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda x: lower(x) not in ({KEYWORDS}))) as name from l),
 st as (select id, name, trim(name, '_') as core, case when length(trim(name, '_')) <= 1 then 'other' when regexp_full_match(trim(name, '_'), '[A-Z0-9_]+') then 'upper' when contains(trim(name, '_'), '_') and regexp_full_match(trim(name, '_'), '[a-z0-9_]+') then 'snake'
  when contains(trim(name, '_'), '_') then 'mixed' when regexp_matches(trim(name, '_'), '^[a-z0-9]') then 'camel' when regexp_matches(trim(name, '_'), '^[A-Z]') and regexp_matches(trim(name, '_'), '[a-z]') then 'pascal' else 'other' end as style from nm),
 ids as (select id, count(*) as c, avg(length(name)) as al, count(*) filter (length(name) <= 2) / count(*) as sr, count(*) filter (style = 'camel') as ca, count(*) filter (style = 'snake') as sn, count(*) filter (style = 'pascal') as pa, count(*) filter (style = 'upper') as up from st group by id),
 tk as (select id, unnest(regexp_extract_all(array_to_string(code, chr(10)), {_quoted(T.TOKEN)})) as token from m), tc as (select id, token, count(*) as n from tk group by all),
 tf as (select id, sum(n) as n, count(*) as v, sum(n * log2(n)) as s from tc group by id),
 wd as (select distinct id, i, unnest(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z]+')) as w from nm),
 wv as (select * from wd where length(w) >= 3 and w not in ({STOPWORDS})), cw as (select distinct id, i, unnest(regexp_extract_all(lower(comment), '[a-z]{{3,}}')) as w from l),
 hs as (select cw.id, cw.i, cw.w, bool_or(wv.w is not null) as hit from cw left join wv on wv.id = cw.id and wv.w = cw.w and abs(wv.i - cw.i) <= 2 where cw.w not in ({STOPWORDS}) group by all), ch as (select id, count(*) filter (hit) / count(*) as co from hs group by id),
 fm as (select id, count(*) as n, max(lines) as ml, max(nesting) as mn from f group by id), {nesting}
 select cnt.id as doc_id, lines, nb as non_blank_lines, cl as code_lines, round((lines - nb) / lines, 6) as blank_ratio, case when nb > 0 then round(cnt.co / nb, 6) else 0 end as comment_ratio, case when cl > 0 then round(ic / cl, 6) else 0 end as inline_comment_ratio,
 case when nb > 0 then round(cm / nb, 6) else 0 end as commented_out_ratio, round(coalesce(mean, 0), 6) as line_len_mean, round(coalesce(sd, 0), 6) as line_len_sd, coalesce(p50, 0) as line_len_p50, coalesce(p95, 0) as line_len_p95, coalesce(longest, 0) as line_len_max,
 coalesce(mx.depth, 0) as max_nesting, case when cl > 0 then round(100 * br / cl, 6) else 0 end as branches_per_100, coalesce(ids.c, 0) as identifiers, round(coalesce(al, 0), 6) as ident_avg_len, round(coalesce(sr, 0), 6) as ident_short_ratio,
 case greatest(ca, sn, pa, up) when ca then 'camel' when sn then 'snake' when pa then 'pascal' when up then 'upper' else 'camel' end as dominant_style, case when ca + sn + pa + up > 0 then round(greatest(ca, sn, pa, up) / (ca + sn + pa + up), 6) else 0 end as dominant_share,
 round(coalesce(log2(tf.n) - tf.s / tf.n, 0), 6) as token_entropy, case when cl > 0 then round(coalesce(tf.n * log2(greatest(2, v)), 0) / cl, 6) else 0 end as halstead_per_line, round(ch.co, 6) as comment_coherence, case when cl > 0 then round(rx / cl, 6) else 0 end as barrel_ratio,
 coalesce(fm.n, 0) as functions, coalesce(ml, 0) as fn_lines_max, coalesce(mn, 0)::int as fn_nesting_max
 from cnt left join dist using (id) left join ids using (id) left join tf using (id) left join ch using (id) left join fm using (id) left join mx using (id)"""


DEPTH_SQL = "mx as (select id, max(depth) as depth from (select id, i, lag(depth, 1, 0) over (partition by id order by i) as depth from w where i > 0) group by id)"
#: Open indents: a line's depth is how many lines before it are less indented than all lines from them on.
STACK_SQL = """fl as (select id, i, width from o where has_code), pv as (select a.id, a.i, count(*) as depth from fl a join fl b on b.id = a.id and b.i < a.i and b.width < a.width and not exists (select 1 from fl c where c.id = a.id and c.i > b.i and c.i < a.i and c.width <= b.width) group by a.id, a.i),
 mx as (select id, max(depth) as depth from pv group by id)"""

PROGRAMS, PAGES = _program_sql(), "t as (select page_id as id, coalesce(html, '') as text from pages)"
DIGEST = "len(code) as lines, len(list_filter(code, lambda x: trim(x) <> '')) as code_lines, len(list_filter(comment, lambda x: trim(x) <> '')) as comment_lines, sha1(array_to_string(code, chr(10))) as code_sha1, sha1(array_to_string(comment, chr(10))) as comment_sha1 from m"

BRACED_LINES = f"with recursive {_replaced_sql(BRACED)}, {_masked_sql('c')}, {LINES_SQL}"
INDENTED_LINES = f"with recursive {_replaced_sql(INDENTED)}, {_masked_sql('python')}, {LINES_SQL}"

ORACLE_SQL = {
    "txt2_functions": f"{BRACED_LINES}, {BRACED_SQL} {FUNCTIONS_SQL}",
    "txt2_indented_functions": f"{INDENTED_LINES}, {INDENTED_SQL} {FUNCTIONS_SQL}",
    "srt4_largest_functions": f"{BRACED_LINES}, {BRACED_SQL}, r as materialized ({FUNCTIONS_SQL}) select doc_id, name, line, lines, max_nesting, branches from r order by lines desc, max_nesting desc, doc_id, line limit 10",
    "txt3_file_features": f"{BRACED_LINES}, {EVERY_BRACED_SQL}, {_features_sql(DEPTH_SQL)}",
    "txt3_python_features": f"{INDENTED_LINES}, {EVERY_INDENTED_SQL}, {_features_sql(STACK_SQL)}",
    "agg12_repeated_code": f"""{BRACED_LINES}, g as (select id, list(s order by i) as s from (select id, i, trim(regexp_replace(code, '[\\s\\x0B]+', ' ', 'g')) as s from l) where length(s) >= 12 group by id),
 h as (select id, unnest(list_transform(range(1, len(s)), lambda i: s[i] || chr(10) || s[i + 1])) as h from g), c as (select id, h, count(*) as n from h group by all), e as (select h, sum(n) as total from c group by h),
 x as (select id, count(*) as shingles, count(*) filter (total > 1) as repeated from c join e using (h) group by id) select t.id as doc_id, coalesce(shingles, 0) as shingles, coalesce(repeated, 0) as repeated, case when shingles >= 4 then round(repeated / shingles, 6) end as dup_ratio from t left join x using (id)""",
    "str16_block_ends": f"""with {_replaced_sql(BRACED)}, s as (select id, string_split(text, chr(10)) as ls from t), st as (select id, ls, unnest(range(1, least(len(ls), 40) + 1)) as line from s),
 e as (select id, line, ls, unnest(range(line, least(len(ls), line + 19) + 1)) as i from st), b as (select id, line, i, len(regexp_extract_all(ls[i], '[{{(\\[]')) as up, len(regexp_extract_all(ls[i], '[}})\\]]')) as down from e),
 d as (select *, sum(up - down) over (partition by id, line order by i) as depth, sum(up) over (partition by id, line order by i) > 0 as opened from b)
 select id as doc_id, line, coalesce(min(i) filter (opened and depth <= 0), case when bool_or(opened) then max(i) else line end) as end_line from d group by id, line""",
    "txt5_read_states": """with x as (select doc_id, replace(text, 'zz', chr(0)) as text, case lang when 'en' then 'c' when 'de' then 'python' when 'fr' then null else 'sql' end as family from documents)
 select doc_id, case when family is null or text is null then 'not-code' when strlen(text) > 8000 then 'large' when contains(text, chr(0)) and strlen(string_split(text, chr(0))[1]) < 100 then 'not-code' else 'read' end as state from x""",
    "txt1_masked_lines": f"with {PROGRAMS}, {_masked_sql('c')} select id as doc_id, {DIGEST}",
    "txt1_masked_python": f"with {PROGRAMS}, {_masked_sql('python')} select id as doc_id, {DIGEST}",
    "txt1_masked_markup": f"with {PAGES}, {_masked_sql('markup')} select id as page_id, {DIGEST}",
    "win8_brace_depth": rf"""with {PROGRAMS}, {_masked_sql('c')}, b as (select id, regexp_extract_all(array_to_string(code, chr(10)), '[{{}}\n]') as bs from m), e as (select id, unnest(range(1, len(bs) + 1)) as i, bs from b),
 s as (select id, i, bs[i] as c, sum(case bs[i] when '{{' then 1 when '}}' then -1 else 0 end) over (partition by id order by i) as s from e), d as (select id, c, s - least(0, min(s) over (partition by id order by i)) as d from s),
 x as (select id, max(d) as d from d where c = chr(10) group by id) select m.id as doc_id, coalesce(x.d, 0) as depth from m left join x using (id)""",
    "txt4_indent_depth": f"""with {PROGRAMS}, {_masked_sql('hash')}, u as (select id, unnest(code) as line, unnest(range(1, len(code) + 1)) as i from m), o as (select id, i, {_filled('line')} as has_code, length(replace(regexp_extract(line, '^([ \\t]*)', 1), chr(9), '    ')) as width from u), {STACK_SQL}
 select t.id as doc_id, coalesce(mx.depth, 0) as depth from t left join mx using (id)""",
    "agg13_comment_coherence": rf"""with {PROGRAMS}, {_masked_sql('c')}, r as (select id, unnest(range(1, len(code) + 1)) as i, code, comment from m), l as (select id, i, code[i] as code, comment[i] as comment from r),
 n as (select id, i, unnest(list_filter(regexp_extract_all(code, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda x: lower(x) not in ({KEYWORDS}))) as name from l),
 w as (select distinct id, i, unnest(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z]+')) as w from n),
 v as (select * from w where length(w) >= 3 and w not in ({STOPWORDS})), q as (select distinct id, i, unnest(regexp_extract_all(lower(comment), '[a-z]{{3,}}')) as w from l),
 h as (select q.id, q.i, q.w, bool_or(v.w is not null) as hit from q left join v on v.id = q.id and v.w = q.w and abs(v.i - q.i) <= 2 where q.w not in ({STOPWORDS}) group by all),
 g as (select id, count(*) as words, count(*) filter (hit) as hits from h group by id) select t.id as doc_id, coalesce(words, 0) as words, coalesce(hits, 0) as hits, round(hits / words, 6) as coherence from t left join g using (id)""",
    "win9_walls": f"""with {_replaced_sql(WALLS)}, b as (select id, string_split(string_split(text, '<div class="callout"')[1], chr(10)) as ls from t), r as (select id, ls, unnest(range(1, len(ls) + 1)) as i from b),
 h as (select id, len(ls) as n, i, starts_with(ls[i], '#### ')::int as h from r), s as (select id, n, h, sum(h) over (partition by id order by i) as section from h), c as (select id, n, section, count(*) filter (h = 0) as k from s group by all)
 select id as doc_id, n as lines, max(k) as longest, max(k) > 8 or n > 60 as wall from c group by id, n""",
    "win9_sections": f"""with {PROGRAMS}, l as (select id, string_split(text, chr(10)) as ls from t), r as (select id, unnest(range(1, len(ls) + 1)) as i, ls from l), e as (select id, i, starts_with(ls[i], '#')::int as h from r),
 s as (select id, sum(h) over (partition by id order by i) - min(case when i = 1 then h end) over (partition by id) as section from e) select id as doc_id, section, count(*) as lines from s group by all""",
}
