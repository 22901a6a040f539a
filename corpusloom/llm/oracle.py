"""DuckDB SQL of the operators' queries that SQL can express, written from their definitions."""

from corpusloom.llm.secrets import ALLOWED

WORD = r"[^\x20\x09-\x0D]+"

#: CRC-32 (polynomial 0xEDB88320) of each text's UTF-8 bytes: the table by its rule, then a fold over the bytes.
CRC = """
crc_table as (select list(v order by b) as t from (
    select b, list_reduce(range(0, 8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) as v from (select unnest(range(0, 256)) as b))),
texts as (select distinct coalesce(text, '') as text from documents),
crcs as (select text, xor(list_reduce(list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) as text_crc32
    from (select text, hex(encode(text)) as h, t from texts, crc_table))
"""

SHARDING = f"""
with {CRC},
rows as (select doc_id, strlen(coalesce(d.text, '')) + 1 as size, text_crc32 from documents d join crcs c on coalesce(d.text, '') = c.text),
ends as (select *, sum(size) over (order by doc_id nulls last, text_crc32, size rows unbounded preceding) as e, sum(size) over () as total,
    row_number() over (order by doc_id nulls last, text_crc32, size) as r from rows),
placed as (select *, least(15, ((2 * e - size) * 16) // (2 * total))::int as shard from ends)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by r) - 1 as slot, null::int as grown_shard from placed
"""

KINDS = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
]
RUNS = [("alnum", "[0-9A-Za-z]{20,}", 0, 20), ("token", "[0-9A-Za-z+/_-]{24,}", 0, 24)]
#: kind, runs, pattern of a whole run, further patterns it holds, window, least bits
CLASSES = [
    ("entropy_hex", "alnum", "[0-9A-Fa-f]{20,}", [], 20, 3.0),
    ("entropy_lower", "alnum", "[0-9a-z]{24,}", ["[g-z]"], 24, 3.6),
    ("entropy_upper", "alnum", "[0-9A-Z]{24,}", ["[G-Z]"], 24, 3.6),
    ("entropy_letters", "alnum", "[A-Za-z]{24,}", ["[A-Z]", "[a-z]", "[G-Zg-z]"], 24, 3.8),
    ("entropy_token", "token", "[0-9A-Za-z+/_-]{24,}", ["[0-9]", "[A-Z]", "[a-z]"], 24, 3.8),
]


def _found(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of a pattern's matches: the gaps between matches and the matches alternate, so their lengths say where each one is."""
    return f"""
    select id, kind, s, s + length(m) as e, m from (
        select id, '{kind}' as kind, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::bigint as s,
            unnest(ms) as m, unnest(gs) as g
        from (select id, regexp_extract_all(text, '{pattern}') as ms, regexp_extract_all(text, '{pattern}', {group}) as gs, string_split_regex(text, '{pattern}') as gaps from docs where regexp_matches(text, '{pattern}')))
    where length(g) >= {least}"""


def _classed(rank: int, kind: str, runs: str, whole: str, holds: list[str], window: int, bits: float) -> str:
    held = " ".join(f"and regexp_matches(m, '{p}')" for p in holds)
    return f"select id, '{kind}' as kind, {rank} as rank, s, e, m, {window} as w, {bits} as bits from runs where kind = '{runs}' and regexp_full_match(m, '{whole}') {held}"


SECRETS = f"""
with docs as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
base as (select *, case kind when 'assign' then 0 when 'access' then 1 else 2 end as rank from ({' union all '.join(_found(*k) for k in KINDS)})),
runs as ({' union all '.join(_found(*r) for r in RUNS)}),
candidates as ({' union all '.join(_classed(3 + i, *c) for i, c in enumerate(CLASSES))}),
outside as (select c.* from candidates c where not exists (select 1 from base b where b.id = c.id and b.s <= c.s and c.e <= b.e)),
pieces as (select id, kind, rank, s, e, w, bits, unnest(string_split_regex(m, '(?i:{'|'.join(ALLOWED)})')) as p from outside),
windows as (select *, substr(p, i, w) as part from (select *, unnest(range(1, length(p) - w + 2)) as i from pieces where length(p) >= w)),
counts as (select id, kind, rank, s, e, w, bits, p, i, c, count(*) as n from (select *, unnest(string_split(part, '')) as c from windows) where c <> '' group by id, kind, rank, s, e, w, bits, p, i, c),
added as (select distinct id, kind, rank, s, e from (select id, kind, rank, s, e, w, bits, p, i, log2(w) - sum(n * log2(n)) / w as h from counts group by id, kind, rank, s, e, w, bits, p, i) where h >= bits),
of_base as (select id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as listed from base group by id),
of_all as (select id, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans, count(*) filter (rank > 2) as n_added
    from (select id, kind, rank, s, e from base union all select id, kind, rank, s, e from added) group by id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(listed, '')) as base_sha256,
    coalesce(spans, '') as spans, coalesce(n_added, 0) as n_added
from docs left join of_base using (id) left join of_all using (id)
"""

JACCARD = rf"""
with recursive docs as (select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
shingles as (
    select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from docs where len(w) >= 3
    union all select id, array_to_string(w, ' ') from docs where len(w) between 1 and 2),
sizes as (select id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as k from shingles group by id),
nodes as (select k, min(id) as node, min(n) as n from sizes group by k),
of_nodes as (select node, n, g from nodes join shingles on node = id),
common as (select a.node as a, b.node as b, count(*) as n_both from of_nodes a join of_nodes b on a.g = b.g and a.node < b.node and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by all),
links as (select a, b from common c join nodes x on x.node = a join nodes y on y.node = b where 100 * n_both >= 90 * (x.n + y.n - n_both)),
reach as (select node as a, node as b from nodes union select r.a, l.b from reach r join (select a, b from links union all select b, a from links) l on r.b = l.a),
least_ids as (select node, min(doc_id) as low from nodes join sizes using (k) join docs using (id) group by node),
named as (select a as node, min(low) as component_id from reach join least_ids on b = node group by a)
select doc_id, coalesce(s.n, 0) as n_shingles, case when s.n is null then doc_id else component_id end as component_id
from docs left join sizes s using (id) left join nodes using (k) left join named using (node)
"""

URLS = r"""
with parts as (select page_id, case when contains(url, '://') then translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') else '' end as path from pages),
rules(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits as (select page_id, url_row, max_by({'verdict': verdict, 'rule': h || p}, length(h || p)) as best
    from (select *, row_number() over () as url_row from parts) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all),
numbered as (select *, row_number() over () as url_row from parts)
select n.page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from numbered n left join fits using (url_row)
"""

LINE_DEDUP = r"""
with docs as (select row_number() over () as id, doc_id, text from documents),
lines as (select id, struct_pack(none := doc_id is null, doc_id := doc_id, id := id, pos := pos) as place, pos, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') as line
    from (select id, doc_id, unnest(range(0, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from docs where text is not null)),
firsts as (select line, min(place) as place, string_split(line, ' ') as w from lines where line <> '' group by line),
long as (select line, place, w from firsts where len(w) >= 8),
variants as (select line, place, len(w) as n, i, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) as rest from (select *, unnest(range(1, len(w) + 1)) as i from long)),
replaced as (select line from (select line, place, min(place) over (partition by n, i, rest) as low from variants) where low < place),
inserted as (select v.line as a, v.place as pa, l.line as b, l.place as pb from variants v join long l on v.rest = md5(l.line)),
near as (select line from replaced union select a from inserted where pb < pa union select b from inserted where pa < pb),
dropped as (select id, pos from lines l join firsts f using (line) where l.line in (select line from near) or l.place <> f.place),
of_docs as (select id, list(pos) as gone from dropped group by id)
select doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end as n_lines, coalesce(len(gone), 0) as n_dropped,
    sha256(case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i - 1)), chr(10)) end) as text_sha256
from docs left join of_docs using (id)
"""

PHRASES = """
with pieces as (
    select lang, row_number() over () as piece, words from (
        select lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda w: w <> '') as words
        from (select coalesce(lang, 'und') as lang, coalesce(text, '') as text from documents)) where len(words) > 0),
totals as (select lang, sum(len(words))::bigint as n from pieces group by lang),
places as (select lang, words, m, unnest(range(1, len(words) - m + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as m)),
counts as (select lang, array_to_string(words[i:i + m - 1], ' ') as phrase, any_value(m) as m, count(*) as f from places where i + m - 1 <= len(words) group by lang, phrase having count(*) >= 30),
cuts as (select lang, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from counts where m > 1),
scored as (select c.lang, c.phrase, c.a, k, h.f as l, t.f as r, (2000000::hugeint * c.a) // (h.f::hugeint + t.f) as score
    from cuts c join counts h on h.lang = c.lang and h.phrase = array_to_string(w[1:k], ' ') join counts t on t.lang = c.lang and t.phrase = array_to_string(w[k + 1:], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
spans as (select lang, f, string_split(phrase, ' ') as w, m, unnest(range(2, m)) as len from counts where m > 2),
inside as (select lang, f, w, len, unnest(range(1, m - len + 2)) as i from spans),
within as (select lang, array_to_string(w[i:i + len - 1], ' ') as phrase, max(f) as longer from inside group by all),
kept as (select p.* from lowest p left join within q on q.lang = p.lang and q.phrase = p.phrase where q.longer is null or 100::hugeint * q.longer < 80::hugeint * p.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select r.lang, rank, phrase, a, l, r, n, score::bigint as score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""

ORACLE_SQL = {"op3_sharding": SHARDING, "op4_secrets": SECRETS, "op6_jaccard": JACCARD, "op7_urlfilter": URLS, "op8_linededup": LINE_DEDUP, "op11_phrases": PHRASES}
