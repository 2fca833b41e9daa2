from datetime import datetime as D

from pubscope.operators.orphans import covered_at, orphan_references, orphan_report

REF = "ref_id long, from_slug string, slug string, listed_at timestamp_ntz, title string, covered int"
PUB = "slug string, harvested_at timestamp_ntz, withdrawn_at timestamp_ntz, target string, ref_id long"


def t(day, hour=0):
    return D(2024, 1, day, hour)


def run(spark, refs, pubs, other=()):
    a, b, p = spark.createDataFrame(refs, REF), spark.createDataFrame(list(other), REF), spark.createDataFrame(pubs, PUB)
    return {(r["ref_table"], r["ref_id"]): (r["kind"], r["depth"]) for r in orphan_references({"a": a, "b": b}, p).collect()}


def test_direct_and_inherited(spark):
    pubs = [("x", t(1), t(5), None, 1), ("x", t(8), None, None, 1), ("y", t(1), None, None, 2), ("z", t(1), None, None, 3), ("w", t(1), None, None, 3)]
    refs = [
        (1, "y", "X", t(4), None, 1),  # in the register
        (2, "y", "/pub/x/", t(6), None, 1),  # withdrawn by then: y is orphaned
        (3, "z", "y", t(9), None, 1),  # inherits from y
        (4, "w", "z", t(9), None, 1),  # inherits from z
        (5, "q", "x", t(5), None, 1),  # withdrawn at that very moment
        (6, "z", None, t(9), None, 1),
        (7, "z", "\xa0 ", t(9), None, 1),
        (8, "z", "#x", t(9), None, 1),  # written, but names nothing
        (9, None, "gone", t(9), None, 1),
        (10, "z", "x", None, None, 1),  # no time
        (10, "z", "x", None, None, 1),  # loaded twice
        (11, "z", "x", t(1), None, 1),  # harvested at that moment
    ]
    got = run(spark, refs, pubs)
    direct = {k[1] for k, v in got.items() if v[0] == "direct"}
    assert direct == {2, 5, 8, 9, 10}
    assert got["a", 3] == ("inherited", 1)
    assert got["a", 4] == ("inherited", 1)  # z is orphaned directly, by 8
    assert ("a", 1) not in got and ("a", 11) not in got and ("a", 6) not in got


def test_a_chain_is_followed_to_its_end_and_cycles_end(spark):
    pubs = [(s, t(1), None, None, 0) for s in "abcdef"]
    refs = [(0, "a", "missing", t(2), None, 0)] + [(i, y, x, t(2), None, 0) for i, (x, y) in enumerate(zip("abcde", "bcdef"), 1)] + [(9, "a", "f", t(2), None, 0)]
    got = run(spark, refs, pubs)
    assert [got["a", i] for i in range(1, 6)] == [("inherited", i) for i in range(1, 6)] and got["a", 9] == ("inherited", 6)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [("x", t(1), None, None, 1)]) == {}
    assert run(spark, [(1, "a", "x", t(1), None, 1)], [], [(1, "a", "x", t(1), None, 1)]) == {("a", 1): ("direct", 0), ("b", 1): ("direct", 0)}


def test_report(spark):
    a, p = spark.createDataFrame([(1, "a", "x", t(1), None, 1), (2, "a", "x", None, None, 1)], REF), spark.createDataFrame([], PUB)
    rows = {(r["period"], r["kind"]): r["n"] for r in orphan_report(orphan_references({"a": a}, p)).collect()}
    assert rows == {("2024-01", "direct"): 1, ("undated", "direct"): 1}


def test_coverage_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    day = lambda: D(2024, 1, rnd.randint(1, 9), rnd.randint(0, 3))
    spans = [(rnd.choice(["hot", "hot", "k", None]), day(), day() if rnd.random() < 0.8 else None) for _ in range(60)]
    points = [(i, rnd.choice(["hot", "k", "none", None]), day() if rnd.random() < 0.9 else None) for i in range(200)]
    got = covered_at(spark.createDataFrame(points, "i int, k string, at timestamp_ntz"), spark.createDataFrame(spans, "k string, s timestamp_ntz, e timestamp_ntz"), "k", "at", "s", "e")
    want = {i: k is not None and at is not None and any(k == x and s <= at and (e is None or e > at) for x, s, e in spans) for i, k, at in points}
    assert {r["i"]: r["covered"] for r in got.collect()} == want


def test_a_million_references_to_one_record_on_one_day(spark):
    points = spark.range(1_000_000).selectExpr("id", "'hot' as k", "timestamp'2020-05-01 00:00:00' + make_dt_interval(0, 0, 0, id % 80000) as t")
    spans = spark.createDataFrame([("hot", "2020-05-01 06:00:00", "2020-05-01 12:00:00"), ("hot", "2020-05-01 11:00:00", "2020-05-01 13:00:00")], "k string, a string, b string").selectExpr("k", "cast(a as timestamp) a", "cast(b as timestamp) b")
    got = covered_at(points, spans, "k", "t", "a", "b").where("covered").selectExpr("count(*) n", "min(t) x", "max(t) y").first()
    day = [k for k in range(80000) if 6 * 3600 <= k < 13 * 3600]
    assert got["n"] == sum(len(range(k, 1_000_000, 80000)) for k in day) and str(got["x"]).endswith("06:00:00") and str(got["y"]).endswith("12:59:59")
