from pyspark.sql import functions as F

from pubscope.operators.filters import Filters, haystack, parse_venue_key, select
from pubscope.operators import aggregate as ag

SCHEMA = "slug string, title string, subtitle string, authors array<string>, type string, year int, journal string, publisher string, series string"
ROWS = [
    ("a", "Çetin", None, ["X, Y", "Z"], "T1", 2001, "J:1", None, None),
    ("b", None, "sub", [], None, None, None, "P", None),
    ("c", "100%_plain", None, None, "T2", 0, "J:1", "P", "S"),
    ("d", "d", None, ["Z", "Z"], "T1", 2004, None, None, None),
]


def slugs(df):
    return sorted(r["slug"] for r in df.collect())


def test_predicates(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert slugs(select(df, Filters())) == ["a", "b", "c", "d"]
    assert slugs(select(df, Filters(type=frozenset({""})))) == ["b"]
    assert slugs(select(df, Filters(author=frozenset({"Z"})))) == ["a", "d"]
    assert slugs(select(df, Filters(venue=frozenset({"journal:J:1"})))) == ["a", "c"]
    assert slugs(select(df, Filters(years=(1999, 2002)))) == ["a"]
    assert slugs(select(df, Filters(search=" cetin "))) == ["a"]
    assert slugs(select(df, Filters(search="%_"))) == ["c"]
    assert slugs(select(df, Filters(search="´"))) == ["a", "b", "c", "d"]
    both = Filters(type=frozenset({"T1"}), years=(2004, 2004))
    assert slugs(select(df, both)) == ["d"] and slugs(select(df, both, "years")) == ["a", "d"]
    assert df.select(haystack().alias("h")).first()["h"] == "cetin x, y z j:1 t1 2001"


def test_transitions():
    f = Filters().toggle("type", "A").toggle("type", "B").toggle("type", "A")
    assert f.type == {"B"} and f.toggle_many("type", {"B", "C"}).type == {"B", "C"} and f.toggle_many("type", {"B"}).type == frozenset()
    assert Filters().set_years((2005, 2001)).years == (2001, 2005)
    assert Filters().set_years((None, 2030), (1990, 2020)).years is None and Filters().set_years((2000, None), (1990, 2020)).years == (2000, 2020)
    assert Filters().toggle_year(2000).years == (2000, 2000) and Filters().toggle_year(2000).toggle_year(2000).years is None
    assert Filters(search="ab").accept("journal", "J").venue == {"journal:J"} and Filters(search="ab").accept("author", "A").search == ""
    assert parse_venue_key("journal:J:1") == ("journal", "J:1")
    full = Filters(frozenset({"T"}), frozenset({"A"}), frozenset({"journal:J"}), (1, 2), " s ")
    assert full.count_active() == 5 and len(full.listing()) == 5 and full.clear().is_empty() and not full.is_empty()
    assert full.remove("years").years is None and full.remove("type", "T").type == frozenset()
    assert Filters(type=frozenset({"x", "y"})).legend(["a"], ["x", "y"], "o") == {"o"}


def test_rank_numbers_without_one_window(spark):
    rows = [(f"k{i:03d}", 1 + (i % 7 == 0)) for i in range(200)]
    got = ag.rank(spark.createDataFrame(rows, "key string, count long")).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["key"], r["count"], r["rank"]) for r in got] == [(k, c, i + 1) for i, (k, c) in enumerate(want)]
    assert [r["key"] for r in ag.rank(spark.createDataFrame(rows, "key string, count long"), 3).collect()] == [k for k, _ in want[:3]]


def test_rank_by_collation(spark):
    rows = [(k, 1) for k in ("Zed", "eve", "Ábel", "émile")]
    assert [r["key"] for r in ag.rank(spark.createDataFrame(rows, "key string, count long"), 9, "UNICODE").orderBy("rank").collect()] == ["Ábel", "émile", "eve", "Zed"]


def test_paging_and_empties(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r["slug"] for r in ag.page(df, 9, 3, ag.sorted_list(df)).collect()] == ["c"]
    assert [r["slug"] for r in ag.page(df, 1, 2, ag.sorted_list(df)).collect()] == ["d", "a"]
    empty = df.where(F.lit(False))
    assert ag.year_extent(empty).first()["year_min"] is None and ag.per_year(empty).count() == 0 and ag.page(empty, 1, 5, ag.sorted_list(df)).count() == 0
    assert ag.summary(empty).first()["publications"] == 0
    same = ag.same_keys(ag.rank(ag.count_types(df)), ag.rank(ag.count_types(df))).first()["same"]
    other = ag.same_keys(ag.rank(ag.count_types(df)), ag.rank(ag.count_types(df), 1)).first()["same"]
    assert same is True and other is False
