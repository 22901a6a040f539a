"""Readability, duplication, glossary and sampling queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.stats import spearman
from corpusloom.operators import agreement as A
from corpusloom.operators import glossary as G
from corpusloom.operators import textfeatures as O
from corpusloom.sources import table

METRICS = ["n_chars", "tokens", "entropy", "halstead_per_line"]


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def line_lengths(spark, sf):
    return rounded(O.line_lengths(docs(spark, sf)), "mean", "sd")


def token_features(spark, sf):
    return rounded(O.token_features(docs(spark, sf)), "entropy", "halstead_per_line")


def identifier_stats(spark, sf):
    return rounded(O.identifier_stats(docs(spark, sf)), "avg_length", "short_ratio", "style_share")


def line_ratios(spark, sf):
    return rounded(O.line_ratios(docs(spark, sf)), "blank_ratio", "comment_ratio", "list_ratio", "branches_per_100")


def _features(spark, sf):
    d = docs(spark, sf)
    return O.token_features(d).join(d.select("doc_id", F.col("n_chars").cast("double")), "doc_id").select("doc_id", *METRICS)


def outlier_rows(spark, sf):
    return rounded(O.outliers(_features(spark, sf), METRICS, low=["entropy"]), "value", "z").select("doc_id", "metric", "z")


def top_outliers(spark, sf):
    found = O.outliers(_features(spark, sf), ["n_chars", "tokens"])
    return rounded(O.top_outliers(found, 10), "z").select("doc_id", "metric", "z", "rank")


def composite(spark, sf):
    d = docs(spark, sf)
    features = O.token_features(d).join(O.line_lengths(d).select("doc_id", "mean"), "doc_id").join(O.line_ratios(d).select("doc_id", "comment_ratio"), "doc_id")
    return rounded(O.composite(features, "doc_id", plus=["comment_ratio"], minus=["halstead_per_line", "mean", "entropy"]), "composite", digits=4)


def duplicate_ratio(spark, sf):
    return rounded(O.duplicate_ratio(docs(spark, sf)), "dup_ratio")


def longest_lines(spark, sf):
    return O.longest_lines(docs(spark, sf))


def group_rollup(spark, sf):
    scored = docs(spark, sf).withColumn("measure", F.col("n_chars").cast("double"))
    return rounded(O.group_rollup(scored, "source", "measure", "doc_id", low=300.0), "mean", digits=4)


def tercile_sample(spark, sf):
    return O.tercile_sample(docs(spark, sf), "source", "n_chars", "doc_id", picks=3)


def quota_sample(spark, sf):
    return O.stratified_sample(docs(spark, sf).withColumn("measure", (F.col("n_chars") % 997).cast("double")), "measure", "doc_id", 50)


def _rated(spark, sf):
    """Lines of orders in three groups, with a rating that depends on two measures."""
    rows = table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select((F.col("l_suppkey") % 3).alias("group"), (F.col("l_quantity") % 17).alias("q"), (F.col("l_discount") * 100 + F.col("l_linenumber")).alias("d"))
    return rows.withColumn("y", F.floor((F.col("q") - 2 * F.col("d") + F.col("group") * F.col("d")) / 4).cast("double"))


def fitted_weights(spark, sf):
    found = A.fit_weights(_rated(spark, sf), "group", ["q", "d"], "y")
    return rounded(found.select("group", "n", F.col("weights")[0].alias("w_q"), F.col("weights")[1].alias("w_d"), F.col("others")[0].alias("o_q"), F.col("others")[1].alias("o_d")), "w_q", "w_d", "o_q", "o_d", digits=5)


def held_out_rho(spark, sf):
    rows = _rated(spark, sf)
    return rounded(A.held_out_agreement(rows, A.fit_weights(rows, "group", ["q", "d"], "y"), "group", ["q", "d"], "y", {"equal": [1.0, -1.0]}), "equal", "fitted", "held_out", digits=5)


def _terms(spark, sf):
    """First two words of each benchmark item, in lower case, as a term."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table(spark, sf, "benchmark").select(F.array_join(F.slice(words, 1, 2), " ").alias("term")).distinct().withColumn("alias", F.col("term"))


def glossary_mentions(spark, sf):
    return G.mentions(docs(spark, sf), _terms(spark, sf), longest=2)


def dead_terms(spark, sf):
    terms = _terms(spark, sf)
    return G.dead_terms(terms.union(terms.select(F.concat("term", F.lit(" zzz")), F.concat("alias", F.lit(" zzz")))), G.mentions(docs(spark, sf), terms, longest=2))


def bold_candidates(spark, sf):
    """Capitalised first words of lines stand for bold terms."""
    d = docs(spark, sf).select("doc_id", F.regexp_replace(F.translate("text", "*`", ""), r"(?m)^([A-Z][a-z]+)", "**$1**").alias("text"))
    return G.candidates(d, _terms(spark, sf), least=20)


def ranked_candidates(spark, sf):
    d = docs(spark, sf).select("doc_id", F.regexp_replace(F.translate("text", "*`", ""), r"(?m)^([A-Z][a-z]+)", "**$1**").alias("text"))
    return G.ranked_candidates(d, _terms(spark, sf), least=3).withColumn("firsts", F.array_join("firsts", ","))


def rank_agreement(spark, sf):
    both = docs(spark, sf).select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rounded(spearman(both, "n_chars", "quality"), "rho")


def label_agreement(spark, sf):
    labels = table(spark, sf, "labels")
    return rounded(A.agreement(labels, "quality", "toxic"), "exact", "mae")


def label_accuracy(spark, sf):
    return rounded(A.binary_accuracy(table(spark, sf, "labels"), "quality", "toxic", 1.0), "accuracy")


def least_squares_sums(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("d"), (F.col("l_extendedprice") / 1000).alias("y"))
    sums = A.normal_sums(rows, ["q", "d"], "y")
    return rounded(sums, *sums.columns, digits=3)


def panel_gate(spark, sf):
    scores = table(spark, sf, "labels").join(docs(spark, sf), "doc_id").select("source", F.col("quality").cast("double").alias("score"))
    return A.panel_gate(scores, "source", "score", 1.0, 3)


def bigram_dice(spark, sf):
    bench = table(spark, sf, "benchmark")
    return rounded(A.dice(bench.withColumnRenamed("item_id", "a"), bench.withColumnRenamed("item_id", "b"), "a", "b", 0.6), "dice")


QUERIES = {
    "agg7_line_lengths": line_lengths, "agg9_token_features": token_features, "agg11_identifier_stats": identifier_stats, "agg14_line_ratios": line_ratios,
    "win5_outliers": outlier_rows, "srt2_top_outliers": top_outliers, "mth2_composite": composite, "agg12_duplicate_ratio": duplicate_ratio,
    "srt3_longest_lines": longest_lines, "agg15_group_rollup": group_rollup, "win10_tercile_sample": tercile_sample,
    "joi34_glossary_mentions": glossary_mentions, "joi35_dead_terms": dead_terms, "agg27_bold_candidates": bold_candidates, "srt13_ranked_candidates": ranked_candidates,
    "win4_spearman": rank_agreement, "agg33_agreement": label_agreement, "agg34_binary_accuracy": label_accuracy, "agg35_normal_sums": least_squares_sums,
    "win10_quota_sample": quota_sample, "agg35_fitted_weights": fitted_weights, "agg35_held_out_rho": held_out_rho,
    "agg32_panel_gate": panel_gate, "mth3_bigram_dice": bigram_dice,
}

TOKENS = "tk as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\\.[0-9]+)?|[^\\sA-Za-z0-9_$]+')) as token from documents)"
LINES = "ln as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents)"
FEATURES = f"""{TOKENS}, ct as (select doc_id, token, count(*) as n from tk group by 1, 2), sm as (select doc_id, sum(n) as tokens, count(*) as distinct_tokens, sum(n * log2(n)) as s from ct group by 1),
 cl as (select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as code_lines, n_chars from documents),
 ft as (select cl.doc_id, cl.n_chars::double as n_chars, coalesce(tokens, 0) as tokens, coalesce(distinct_tokens, 0) as distinct_tokens, case when tokens > 0 then log2(tokens) - s / tokens else 0 end as entropy,
  case when code_lines > 0 then coalesce(tokens, 0) * log2(greatest(2, coalesce(distinct_tokens, 0))) / code_lines end as halstead_per_line from cl left join sm using (doc_id))"""
LONG = "lg as (unpivot (select doc_id, n_chars::double as n_chars, tokens::double as tokens, entropy::double as entropy, halstead_per_line::double as halstead_per_line from ft) on n_chars, tokens, entropy, halstead_per_line into name metric value value), nm as (select metric, avg(value) as m, stddev_pop(value) as sd from lg group by 1), zz as (select doc_id, metric, (value - m) / sd as z from lg join nm using (metric) where sd > 0)"
TERMS = "tm as (select distinct array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:2], ' ') as term from benchmark)"
WORDS = "wd as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents), bi as (select doc_id, unnest(range(1, len(w))) as pos, w from wd where len(w) > 1), hit as (select doc_id, pos, w[pos] || ' ' || w[pos + 1] as term from bi)"

RATED = """r as (select l_suppkey % 3 as g, l_quantity % 17 as q, l_discount * 100 + l_linenumber as d from lineitem where l_orderkey % 3 = 0), y as (select g, q, d, floor((q - 2 * d + g * d) / 4)::double as y from r)"""
#: Weights of two standardised measures by Cramer's rule, of a group and of all others.
FITTED = f"""{RATED}, ids as (select distinct g from y), sets as (select i.g as g, y.g = i.g as own, q, d, y from ids i, y),
 m as (select g, own, count(*) as n, corr(q, d) as c, covar_pop(q, y) / stddev_pop(q) as bq, covar_pop(d, y) / stddev_pop(d) as bd from sets group by all),
 w as (select g, own, n, (bq - c * bd) / (1 - c * c) as wq, (bd - c * bq) / (1 - c * c) as wd from m)"""

ORACLE_SQL = {
    "win10_quota_sample": """with s as (select doc_id, (n_chars % 997)::double as measure, row_number() over (order by n_chars % 997, doc_id) - 1 as place, count(*) over () as n from documents where n_chars is not null), t as (select max(n) as n, least(50, max(n)) as target from s),
 c as (select n, target, ceil(n / 3)::bigint as c1, ceil(2 * n / 3)::bigint as c2 from t), b as (select 0 as stratum, 0 as lo, c1 as size, target // 3 + (target % 3 >= 1)::int as quota from c union all select 1, c1, c2 - c1, target // 3 from c union all select 2, c2, n - c2, target // 3 + (target % 3 >= 2)::int from c),
 p as (select stratum, lo, size, quota, unnest(range(0, quota)) as i from b) select s.place, stratum, doc_id, measure from p join s on s.place = lo + case when quota >= size then i when quota = 1 then (size - 1) // 2 else floor(i * (size - 1) / (quota - 1) + 0.5) end""",
    "agg35_fitted_weights": f"""with {FITTED} select a.g as "group", a.n, round(a.wq, 5) as w_q, round(a.wd, 5) as w_d, round(b.wq, 5) as o_q, round(b.wd, 5) as o_d from w a join w b on a.g = b.g where a.own and not b.own""",
    "agg35_held_out_rho": f"""with {FITTED}, z as (select g, y, (q - avg(q) over (partition by g)) / stddev_pop(q) over (partition by g) as q, (d - avg(d) over (partition by g)) / stddev_pop(d) over (partition by g) as d from y),
 p as (select z.g, y, q - d as e, a.wq * q + a.wd * d as f, b.wq * q + b.wd * d as h from z join w a on a.g = z.g and a.own join w b on b.g = z.g and not b.own), k as (select g, round(y, 9) as y, round(e, 9) as e, round(f, 9) as f, round(h, 9) as h from p),
 o as (select g, {', '.join(f"rank() over (partition by g order by {c}) + (count(*) over (partition by g, {c}) - 1) / 2 as {c}" for c in 'yefh')} from k)
 select g as "group", count(*) as n, round(corr(y, e), 5) as equal, round(corr(y, f), 5) as fitted, round(corr(y, h), 5) as held_out from o group by g""",
    "agg7_line_lengths": f"""with {LINES}, v as (select doc_id, length(l) as n from ln where trim(l) <> ''), r as (select *, row_number() over (partition by doc_id order by n) as k, count(*) over (partition by doc_id) as c from v)
 , a as (select doc_id, c as lines, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as sd, min(n) filter (k >= least(c, floor(c * 0.5) + 1)) as p50, min(n) filter (k >= least(c, floor(c * 0.95) + 1)) as p95, max(n) as max from r group by doc_id, c)
 select d.doc_id, coalesce(lines, 0) as lines, coalesce(mean, 0) as mean, coalesce(sd, 0) as sd, coalesce(p50, 0) as p50, coalesce(p95, 0) as p95, coalesce(max, 0) as max from documents d left join a using (doc_id)""",
    "agg9_token_features": f"with {FEATURES} select doc_id, tokens, distinct_tokens, round(entropy, 6) as entropy, round(halstead_per_line, 6) as halstead_per_line from ft",
    "agg11_identifier_stats": """with i as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) as name from documents), s as (select *, trim(name, '_') as core, case when length(core) <= 1 then 'other' when regexp_full_match(core, '[A-Z0-9_]+') then 'upper'
 when contains(core, '_') and regexp_full_match(core, '[a-z0-9_]+') then 'snake' when contains(core, '_') then 'mixed' when regexp_matches(core, '^[a-z0-9]') then 'camel' when regexp_matches(core, '^[A-Z]') and regexp_matches(core, '[a-z]') then 'pascal' else 'other' end as style from i),
 g as (select doc_id, style, count(*) as n, sum(length(name)) as chars, count(*) filter (length(name) <= 2) as short from s group by 1, 2), r as (select *, row_number() over (partition by doc_id order by n desc, style desc) as k from g)
 select doc_id, sum(n) as identifiers, round(sum(chars) / sum(n), 6) as avg_length, round(sum(short) / sum(n), 6) as short_ratio, max(style) filter (k = 1) as style, round(max(n) / sum(n), 6) as style_share from r group by doc_id""",
    "agg14_line_ratios": """with x as (select doc_id, text, string_split(text, chr(10)) as a, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') as f from documents)
 select doc_id, round((len(a) - len(f)) / len(a), 6) as blank_ratio, case when len(f) > 0 then round(len(list_filter(f, lambda s: regexp_matches(s, '^\\s*(?:#|//|/\\*|\\*)'))) / len(f), 6) end as comment_ratio,
 case when len(f) > 0 then round(len(list_filter(f, lambda s: regexp_matches(s, '^\\s*(?:[-*+]|[0-9]+\\.)\\s'))) / len(f), 6) end as list_ratio,
 case when len(f) > 0 then round(100.0 * len(regexp_extract_all(text, '\\b(?:if|elif|else|for|while|case|catch|except|when|guard|match)\\b|&&|\\|\\|')) / len(f), 6) end as branches_per_100 from x""",
    "win5_outliers": f"with {FEATURES}, {LONG} select doc_id, metric, round(z, 6) as z from zz where case when metric = 'entropy' then -z else z end >= 2",
    "srt2_top_outliers": f"with {FEATURES}, {LONG}, r as (select doc_id, metric, z, row_number() over (partition by metric order by -z, doc_id) as rank from zz where metric in ('n_chars', 'tokens') and z >= 2) select doc_id, metric, round(z, 6) as z, rank from r where rank <= 10",
    "mth2_composite": f"""with {FEATURES}, {LINES}, lm as (select doc_id, avg(length(l)) as mean, count(*) filter (regexp_matches(l, '^\\s*(?:#|//|/\\*|\\*)')) / count(*) as comment_ratio from ln where trim(l) <> '' group by doc_id),
 v as (select ft.doc_id, entropy, halstead_per_line, coalesce(mean, 0) as mean, comment_ratio from ft left join lm using (doc_id)),
 n as (select avg(entropy) as em, stddev_pop(entropy) as es, avg(halstead_per_line) as hm, stddev_pop(halstead_per_line) as hs, avg(mean) as lm, stddev_pop(mean) as ls, avg(comment_ratio) as cm, stddev_pop(comment_ratio) as cs from v)
 select doc_id, round(coalesce((comment_ratio - cm) / case when cs > 0 then cs else 1 end, 0) - coalesce((halstead_per_line - hm) / case when hs > 0 then hs else 1 end, 0)
  - coalesce((mean - lm) / case when ls > 0 then ls else 1 end, 0) - coalesce((entropy - em) / case when es > 0 then es else 1 end, 0), 4) as composite from v, n""",
    "agg12_duplicate_ratio": """with x as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 25) as l from documents),
 h as (select doc_id, unnest(list_transform(range(1, len(l) - 2), lambda i: array_to_string(list_slice(l, i::int, (i + 3)::int), chr(10)))) as h from x where len(l) >= 4), g as (select h, doc_id, count(*) as n from h group by 1, 2), t as (select h, sum(n) as total from g group by 1)
 select doc_id, count(*) as shingles, count(*) filter (total > 1) as repeated, case when count(*) >= 8 then round(count(*) filter (total > 1) / count(*), 6) end as dup_ratio from g join t using (h) group by doc_id""",
    "srt3_longest_lines": f"with {LINES}, r as (select doc_id, line, length(l) as length, row_number() over (partition by doc_id order by length(l) desc, line) as k from ln) select doc_id, line, length from r where k <= 3 order by length desc, doc_id, line limit 20",
    "agg15_group_rollup": "select source, count(*) as n, round(avg(n_chars), 4) as mean, count(*) filter (n_chars <= 300) as low, arg_min(doc_id, n_chars * 1000000000 + doc_id) as worst from documents group by source having count(*) >= 5",
    "win10_tercile_sample": """with t as (select source, doc_id, n_chars, ntile(3) over (partition by source order by n_chars, doc_id) as stratum from documents),
 p as (select *, row_number() over (partition by source, stratum order by n_chars, doc_id) - 1 as place, count(*) over (partition by source, stratum) as n from t)
 select source, doc_id, stratum, place from p where place in (floor(0.5 * n / 3), floor(1.5 * n / 3), floor(2.5 * n / 3))""",
    "joi34_glossary_mentions": f"""with {TERMS}, {WORDS}, at_term as (select distinct doc_id, pos, hit.term from hit join tm on tm.term = hit.term), run as (select *, pos - row_number() over (partition by doc_id order by pos) as run from at_term), nth as (select *, row_number() over (partition by doc_id, run order by pos) as nth from run)
 select doc_id, term, count(*) as n from nth where nth % 2 = 1 group by doc_id, term""",
    "joi35_dead_terms": f"with {TERMS}, {WORDS} select term from (select term from tm union select term || ' zzz' from tm) t where term not in (select term from hit)",
    "srt13_ranked_candidates": f"""with {TERMS}, {LINES}, b as (select distinct doc_id, lower(regexp_extract(translate(l, '*`', ''), '^([A-Z][a-z]+)', 1)) as term from ln), c as (select term, count(*) as documents, array_to_string(list_sort(list(doc_id))[1:5], ',') as firsts from b where length(term) >= 2 and term not in (select term from tm) group by term having count(*) >= 3),
 r as (select row_number() over (order by documents desc, term) as rank, * from c) select rank, term, documents, firsts from r where rank <= 40""",
    "agg27_bold_candidates": f"""with {TERMS}, {LINES}, b as (select distinct doc_id, lower(regexp_extract(translate(l, '*`', ''), '^([A-Z][a-z]+)', 1)) as term from ln), c as (select term, count(*) as documents, min(doc_id) as first_doc from b where length(term) >= 2 group by term having count(*) >= 20)
 select * from c where term not in (select term from tm)""",
    "win4_spearman": """with j as (select n_chars, quality from documents join labels using (doc_id) where n_chars is not null and quality is not null), r as (select rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 as a, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2 as b from j)
 select count(*) as n, round(corr(a, b), 6) as rho from r""",
    "agg33_agreement": "select count(*) as n, round(avg((quality = toxic)::int), 6) as exact, round(avg(abs(quality - toxic)), 6) as mae from labels where quality is not null and toxic is not null",
    "agg34_binary_accuracy": "select count(*) as n, round(avg(((quality >= 1) = (toxic >= 1))::int), 6) as accuracy from labels where quality is not null and toxic is not null",
    "agg35_normal_sums": """with r as (select l_quantity / 50 as q, l_discount as d, l_extendedprice / 1000 as y from lineitem) select round(sum(1.0::double), 3) as s_1_1, round(sum(q), 3) as s_1_q, round(sum(d), 3) as s_1_d, round(sum(q * q), 3) as s_q_q, round(sum(q * d), 3) as s_q_d,
 round(sum(d * d), 3) as s_d_d, round(sum(y), 3) as t_1, round(sum(q * y), 3) as t_q, round(sum(d * y), 3) as t_d from r""",
    "agg32_panel_gate": "with s as (select source, quality::double as score from labels join documents using (doc_id)), a as (select source, count(score) as n, median(score) as median, count(*) filter (score < 1) as failed from s group by 1) select *, case when n = 0 then 'no-ratings' when median < 1 then 'median' when failed > 3 then 'failures' else 'pass' end as reason from a",
    "mth3_bigram_dice": """with t as (select item_id, lower(regexp_replace(text, '\\s+', '', 'g')) as s from benchmark), g as (select item_id, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) as g from t), c as (select item_id, g, count(*) as n from g group by 1, 2), s as (select item_id, sum(n) as n from c group by 1),
 p as (select x.item_id as a, y.item_id as b, sum(least(x.n, y.n)) as common from c x join c y using (g) group by 1, 2) select a, b, round(2 * common / (u.n + v.n), 6) as dice from p join s u on u.item_id = a join s v on v.item_id = b where 2 * common / (u.n + v.n) >= 0.6""",
}
