import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.secrets import max_window_entropy, scan_secrets, secret_report

SCHEMA = "doc_id long, text string"
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]


def brute(text):
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


def entropy(text, window):
    width = min(window, len(text))
    parts = [text[i : i + width] for i in range(len(text) - width + 1)]
    return max(-sum(n / width * math.log2(n / width) for n in Counter(p).values()) for p in parts)


def texts():
    rng = random.Random(6)
    parts = [
        "password = hunter2xyz", "API_KEY: 'abc.def-123'", "apikey=short", "token\t= x123456", "Secret\" : \"aa/bb+cc==", "AKIA" + "Q7" * 8, "AKIAAKIA" + "Z" * 12,
        "AKIA123", "deadbeef" * 3, "0" * 24, "g" + "a1" * 20, "日本😀", "passwordpassword=secret=abcdef12", "words", "\n", "AKIAshort" + "f" * 30, "kZ8qP2vX9mL4tR7wB3nC6yH1", "0123456789abcdef0123456789abcdef",
    ]
    return [None, "", *parts, *(" ".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(60)), "token=abcdef1 😀 " * 3000]


def test_base_spans_against_plain_matching(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", base string")
    got = {r.doc_id: r for r in secret_report(df).collect()}
    for k, text in rows:
        wanted = brute(text)
        listed = ",".join(f"{kind}:{a}:{b}" for kind, a, b in wanted)
        row = got[k]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[0] == kind for s in wanted) for kind in ("assign", "access", "hex")]
        assert set(listed.split(",")) - {""} <= set(row.spans.split(","))


def test_window_entropy(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choices("abcdefgh0123", k=rng.randrange(1, 60)))) for k in range(80)]
    got = spark.createDataFrame(rows, SCHEMA).select("doc_id", max_window_entropy(F.col("text"), 16).alias("bits")).collect()
    assert {r.doc_id: r.bits for r in got} == pytest.approx({k: entropy(t, 16) for k, t in rows})


def added(spark, rows):
    got = scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.added]) for r in got)


def test_entropy_spans_and_allow_list(spark):
    rows = [
        (1, "see kZ8qP2vX9mL4tR7wB3nC6yH1 here"), (2, "see exampleZ8qP2vX9mL4tR7wB3nC6 here"), (3, "a long Aa1Aa1Aa1Aa1Aa1Aa1Aa1Aa1Aa1 here"), (None, "x"), (None, "x"),
        (4, "x k3v9q0z7m2x8c1w5r4t6y0p2s8d7 y"), (5, "K3V9Q0Z7M2X8C1W5R4T6Y0P2S8D7"), (6, "kZqPvXmLtRwBnCyHfGsJdKuIoE"), (7, "Einungtzheitgeungverlich"),
        (8, "sampleXkZ8qP2vX9mL4tR7wB3nC6yH1"), (9, "token=kZ8qP2vX9mL4tR7wB3nC6yH1"), (10, "qwzvkxjpmfbgtyhnrldcsoaeiu"),
    ]
    assert added(spark, rows) == [
        (0, []), (0, []), (1, [("entropy_token", 4, 28)]), (2, []), (3, []), (4, [("entropy_lower", 2, 30)]), (5, [("entropy_upper", 0, 28)]),
        (6, [("entropy_letters", 0, 26)]), (7, []), (8, [("entropy_token", 0, 31)]), (9, []), (10, [("entropy_lower", 0, 26)]),
    ]
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_candidates_and_many_spans(spark):
    """A megabyte in one candidate, and thousands of candidates beside thousands of base spans, in seconds."""
    rng = random.Random(2)
    blob = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000))
    flat = "aB1" * 300_000
    one = "token=abcdef12 kZ8qP2vX9mL4tR7wB3nC6yH1 "
    began = time.time()
    got = {d: spans for d, spans in added(spark, [(1, f"a {blob} b"), (2, flat), (3, one * 4000)])}
    assert ("entropy_token", 2, 2 + len(blob)) in got[1] and got[2] == []
    assert got[3] == [("entropy_token", k * len(one) + 15, k * len(one) + 39) for k in range(4000)]
    print(f"long candidates: {time.time() - began:.1f} s")
    assert time.time() - began < 120
