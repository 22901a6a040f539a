import random

from corpusloom.llm import urlfilter
from corpusloom.llm.registry import URL_RULES
from corpusloom.llm.urlfilter import judge_urls

SCHEMA = "page_id long, url string"


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count(".") + 1, len(p), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    *_, verdict, rule = max(fits) if fits else ("allow", None)
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://EXAMPLE.com/en/7", "http://a.example.com/en/71?x=/en/", "http://example.com/en/8", "http://notexample.com/en/7",
    "http://com/en/", "http://x.net/de/8", "http://example.net/de/8", "http://w.example.net/de/88#f", "http://example.net/de", "https://x.org/es/",
    "https://x.org?/es/", "https://x.org#/es/", "ftp://É.COM/en/a\nb", "x://y://com/en/", "http://x.com./en/", "http://.com/en/", "http:///en/", "://",
]


def test_against_brute_force(spark):
    rng = random.Random(8)
    made = ["http://" + ".".join(rng.choices(["a", "example", "B"], k=rng.randrange(3)) + [rng.choice(["com", "net", "org"])]) + "/" + "/".join(rng.choices(["en", "de", "es", "7", "8", "71", ""], k=3)) for _ in range(300)]
    rows = list(enumerate(URLS + made))
    wanted = {k: brute(u, URL_RULES) for k, u in rows}
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", verdict string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, URL_RULES).collect()} == wanted


def test_large_rule_sets_are_joined(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_TRIE_BYTES", 1)
    rows = list(enumerate(URLS))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, SCHEMA), URL_RULES).collect()}
    assert got == {k: brute(u, URL_RULES) for k, u in rows}


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(None, "http://com/en/"), (None, "http://com/en/")], SCHEMA)
    assert [r.verdict for r in judge_urls(df, URL_RULES).collect()] == ["block", "block"]
    assert judge_urls(df.limit(0), URL_RULES).count() == 0
