"""Canonical texts and the appended log: forms, problems, replays, two writers, lost commits, broken chains."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions.canonical import canonical_text
from corpusloom.operators import ledgerlog as L

EVENTS = "ledger string, at long, body string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"b":1,"a":[1.0,-0,0.1,1e-7,1.5e-7,123e-2,1e2,0.000001]}', '{"a":[1,0,0.1,1e-7,1.5e-7,1.23,100,0.000001],"b":1}'),
        ('"\\u00e9\\u2028\\/\\u007f\\b\\u001f"', '"é /\x7f\\b\\u001f"'),
        ('{"\\ud83d\\ude00":1,"\\uffee":2,"z":3}', '{"z":3,"😀":1,"￮":2}'),
        (" [ ] ", "[]"), ("9007199254740991", "9007199254740991"), ("-1.25E+3", "-1250"), ("5e-324", "5e-324"), ("1.7976931348623157e-300", "1.7976931348623157e-300"),
    ],
)
def test_forms(text, want):
    assert canonical_text(text) == (want, None)


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ("", "no-json"), ("{", "no-json"), ('{"a":1,"a":2}', "repeated-key"), ('{"a":{"b":1,"b":1}}', "repeated-key"), ("NaN", "not-finite"), ("[-Infinity]", "not-finite"), ("1e400", "not-finite"),
        ("9007199254740992", "unsafe-integer"), ("1e20", "unsafe-integer"), ("9" * 5000, "not-finite"), ('"\\ud800"', "lone-surrogate"), ('{"\\udc00":1}', "lone-surrogate"), ('{"constructor":1}', "forbidden-key"),
        ("[" * 300 + "]" * 300, "too-deep"), ("[" * 200_000, "too-deep"),
    ],
)
def test_problems(text, problem):
    assert canonical_text(text) == (None, problem)


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(allow_nan=False, allow_infinity=False, width=64).filter(lambda x: abs(x) < 2**53) | st.text(st.characters(exclude_categories=["Cs"])),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4), inner, max_size=4), max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(values)
def test_equal_values_have_one_text(value):
    def back(x):
        return {k: back(x[k]) for k in sorted(x, reverse=True)} if isinstance(x, dict) else [back(v) for v in x] if isinstance(x, list) else x

    def plain(x):
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else float(x) + 0.0 if isinstance(x, int | float) and not isinstance(x, bool) else x

    text, problem = canonical_text(json.dumps(value))
    assert problem is None and canonical_text(json.dumps(back(value), indent=1)) == (text, None) and canonical_text(text) == (text, None)
    read = json.loads(text)
    assert plain(read) == plain(value) and not any(math.copysign(1, x) < 0 for x in [read] if x == 0 and isinstance(x, float))


def entries(spark, log):
    return sorted((r.ledger, r.place, json.loads(r.content)["n"], r.previous) for r in L.entries(spark, log).collect())


def events(spark, *rows):
    return spark.createDataFrame([(ledger, at, body if isinstance(body, str) else json.dumps({"n": body})) for ledger, at, body in rows], EVENTS)


def test_replays_and_overlaps_append_once(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    first = events(spark, ("a", 2, 1), ("a", 1, 2), ("b", 1, 3), ("b", 9, '{ "n" : 3.0 }'), ("a", 3, "{"), ("a", 4, '{"n":1,"n":1}'))
    assert sorted((r.ledger, r.status) for r in L.append(first, log).collect()) == [("a", "append"), ("a", "append"), ("a", "no-json"), ("a", "repeated-key"), ("b", "append")]
    assert sorted(r.status for r in L.append(first, log).collect()) == ["already-present"] * 3 + ["no-json", "repeated-key"]
    assert [r.status for r in L.append(events(spark, ("a", 0, 7), ("a", 1, 2)), log).orderBy("status").collect()] == ["already-present", "append"]
    found = entries(spark, log)
    assert [e[:3] for e in found] == [("a", 0, 2), ("a", 1, 1), ("a", 2, 7), ("b", 0, 3)]
    assert found[0][3] is None and found[1][3] is not None and L.broken_entries(L.entries(spark, log)).count() == 0
    # One event in two ledgers is two entries.
    assert L.append(events(spark, ("c", 1, 3)), log).first().status == "append"
    assert L.append(events(spark), log).count() == 0


def test_two_writers_leave_one_chain(spark, tmp_path, monkeypatch):
    log, commit, raced = f"file://{tmp_path}/log", L._commit, []
    L.append(events(spark, ("a", 1, 1)), log)

    def late(spark, log, number, table):
        if not raced:
            raced.append(True)
            L.append(events(spark, ("a", 5, 5), ("a", 6, 2)), log)  # another writer comes first
        return commit(spark, log, number, table)

    monkeypatch.setattr(L, "_commit", late)
    status = sorted(r.status for r in L.append(events(spark, ("a", 2, 2), ("a", 3, 3)), log).collect())
    assert status == ["already-present", "append"]
    assert [e[:3] for e in entries(spark, log)] == [("a", 0, 1), ("a", 1, 5), ("a", 2, 2), ("a", 3, 3)]
    assert L.broken_entries(L.entries(spark, log)).count() == 0


def test_what_is_not_committed_does_not_count(spark, tmp_path, monkeypatch):
    log = f"file://{tmp_path}/log"
    L.append(events(spark, ("a", 1, 1)), log)

    def lost(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(L, "_commit", lost)
        L.append(events(spark, ("a", 2, 2)), log)
    assert [e[:3] for e in entries(spark, log)] == [("a", 0, 1)]
    assert L.append(events(spark, ("a", 2, 2)), log).first().status == "append"
    assert [e[:3] for e in entries(spark, log)] == [("a", 0, 1), ("a", 1, 2)]


def test_broken_tails_are_refused(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    L.append(events(spark, ("a", 1, 1), ("a", 2, 2), ("b", 1, 1)), log)
    good = L.entries(spark, log)
    bad = good.selectExpr("ledger", "place", "event", "case when ledger = 'a' and place = 1 then '{\"n\":9}' else content end as content", "previous", "digest")
    bad.write.parquet(f"{log}/forged")
    other = f"file://{tmp_path}/other"
    bad.write.parquet(f"{other}/forged")
    assert L._commit(spark, other, 0, "forged") and not L._commit(spark, other, 0, "forged")
    assert sorted((r.ledger, r.status) for r in L.append(events(spark, ("a", 3, 3), ("b", 3, 3)), other).collect()) == [("a", "broken-chain"), ("b", "append")]
    assert [tuple(r) for r in L.broken_entries(L.entries(spark, other)).collect()] == [("a", 1, "digest")]


def test_bodies_of_one_row_group_are_parsed_by_many_tasks(spark, tmp_path):
    rows = events(spark, *[("a", n, n) for n in range(40)])
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/events")
    own = L.identified(spark.read.parquet(f"file://{tmp_path}/events"))
    assert own.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert {r.content for r in own.collect()} == {f'{{"n":{n}}}' for n in range(40)}


def test_appends_that_overlap_parse_each_body_once(spark, monkeypatch):
    from corpusloom.plans import ledgers

    calls, identified = [], L.identified
    monkeypatch.setattr(L, "identified", lambda events: calls.append(True) or identified(events))
    log, statuses = ledgers._appended(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and len(statuses) == 4
    assert {r.status for r in statuses[-1].collect()} == {"already-present"} and L.broken_entries(L.entries(spark, log)).count() == 0


def test_contents_are_not_sorted_to_find_broken_entries(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    L.append(events(spark, ("a", 1, 1), ("a", 2, 2)), log)
    node = L.broken_entries(L.entries(spark, log))._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    assert "content" not in node.children().head().output().toString()
