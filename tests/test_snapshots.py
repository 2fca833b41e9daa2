from datetime import date

import numpy as np

from pubscope.operators.snapshots import last_of_key, snapshot_changes

SCHEMA = "snapshot_date date, delivery int, row_no long, slug string, title string, d string, k int, change int"
A, B, C = date(2024, 1, 31), date(2024, 3, 1), date(2024, 3, 5)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((r["snapshot_date"], r["slug"], r["change"]) for r in snapshot_changes(df, **kw).collect())


def test_changes(spark):
    rows = [
        (A, 1, 1, "same", "T  x​"), (B, 1, 1, " same\xa0", "T x"),
        (A, 1, 2, "comp", "Kö"), (B, 1, 2, "comp", "Kö"),
        (A, 1, 3, "null", None), (B, 1, 3, "null", " "),
        (A, 1, 4, "gone", "t"), (B, 1, 5, "new", "t"),
        (A, 1, 6, "chg", "t"), (B, 1, 6, "chg", "T"),
        (A, 1, 7, "low", "old"), (A, 2, 1, None, "only this delivery counts"),
    ]
    assert [r for r in run(spark, rows) if r[0] == "2024-03-01" and r[2] == "added"] == [("2024-03-01", s, "added") for s in sorted(["same", "comp", "null", "new", "chg"])]
    got = run(spark, [r for r in rows if r[1] == 1 and r[3] != "low"])
    assert got == [("2024-03-01", "chg", "changed"), ("2024-03-01", "gone", "removed"), ("2024-03-01", "new", "added")]


def test_the_last_row_of_a_slug_counts_and_dates_are_consecutive(spark):
    rows = [(A, 1, 1, "s", "old"), (A, 1, 9, "s", "t"), (B, 1, 1, "other", "t"), (C, 1, 1, "s", "t"), (C, 1, 1, "s", "t"), (C, None, 5, "z", "t"), (None, 1, 1, "s", "q"), (C, 1, 2, "  ", "q")]
    assert run(spark, rows) == [("2024-03-01", "other", "added"), ("2024-03-01", "s", "removed"), ("2024-03-05", "other", "removed"), ("2024-03-05", "s", "added")]


def test_nothing_to_compare(spark):
    assert run(spark, []) == [] and run(spark, [(A, 1, 1, "s", "t")]) == []


def test_against_brute_force_in_many_buckets(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.choice([A, B, C]), rnd.choice([1, 2]), rnd.randint(1, 400), f"s{rnd.randint(1, 60)}", rnd.choice(["a", "b"])) for _ in range(400)]
    rows = list({r[:3]: r for r in rows}.values())
    state = {}
    for day in (A, B, C):
        top = max(r[1] for r in rows if r[0] == day)
        state[day] = {}
        for r in sorted((r for r in rows if r[0] == day and r[1] == top), key=lambda r: r[2]):
            state[day][r[3]] = r[4]
    want = []
    for x, y in ((A, B), (B, C)):
        for s in state[x].keys() | state[y].keys():
            what = "added" if s not in state[x] else "removed" if s not in state[y] else "changed" if state[x][s] != state[y][s] else None
            want += [(str(y), s, what)] if what else []
    assert run(spark, rows, rows_per_bucket=20) == sorted(want)


def test_last_of_key():
    d, k, r, h = (np.array(x) for x in ([0, 0, 1, 0], [5, 5, 5, 4], [1, 3, 0, 9], [0, 0, 0, 0]))
    assert sorted(last_of_key(d, k, r, h).tolist()) == [1, 2, 3]
    assert last_of_key(*(np.empty(0, np.int64) for _ in range(4))).tolist() == []
