import pytest
from pyspark.sql import functions as F

from pubscope.operators import graph as gr
from pubscope.operators import refresh as rf
from pubscope.operators import resolve as rs
from pubscope.operators import words as wd
from pubscope.schema import slim_records


def names(spark, *cells):
    return spark.createDataFrame([(f"r{i}", 0, c) for i, c in enumerate(cells)], "slug string, pos int, name string")


def test_names_fold_into_the_only_fuller_one(spark):
    df = names(spark, "Kirmse, Stefan", "Stefan B. Kirmse", "Ahmed, M.", "Ahmed, Mohammed A", "Ahmed, Mahmoud B", "Sinha, N. (Ed.)", "Sinha, Nitin Kumar", "Nobody", None, "")
    out, merges = rs.resolve_names(df, ["slug", "pos"])
    got = {r["slug"]: r["author"] for r in out.collect()}
    assert got["r0"] == got["r1"] == "Kirmse, Stefan B." and got["r2"] == "Ahmed, M." and got["r5"] == "Sinha, Nitin Kumar" and "r8" not in got
    assert {tuple(r) for r in merges.collect()} == {("Kirmse, Stefan", "Kirmse, Stefan B."), ("Sinha, N.", "Sinha, Nitin Kumar")}


def test_chains_are_dropped(spark):
    keys = spark.createDataFrame([("x|a",), ("x|a b",), ("x|a b c",)], "key string")
    assert {tuple(r) for r in rs.fuller_names(keys).collect()} == {("x|a b", "x|a b c")}


def test_shortened_forms_are_those_that_extend(spark):
    import itertools

    from pubscope.functions.names import extends

    given = [" ".join(x) for k in (1, 2, 3) for x in itertools.product(["s", "sam", "b"], repeat=k)] + ["a b c d e f g", "a b c d e f"]
    df = spark.createDataFrame([(f"x|{g}",) for g in given], "key string")
    split = df.select("key", F.split_part("key", F.lit("|"), F.lit(2)).alias("g"), F.split(F.split_part("key", F.lit("|"), F.lit(2)), " ").alias("t"))
    for equal in (False, True):
        pairs = split.alias("a").join(split.alias("b"), extends(F.col("a.g"), F.col("b.g"), equal)).select("a.g", "b.g").collect()
        listed = split.select("g", F.explode(rs.shortened(F.col("t"), equal)).alias("f")).where("f <> g").collect()
        assert {(r[0], r[1]) for r in pairs} == {(r["f"], r["g"]) for r in listed if r["f"] in set(given)}


def test_aliases_apply_before_counting(spark):
    aliases = rs.alias_table(spark.createDataFrame([("authors", "Jones, Bob", "Jones, Robert")], "section string, variant string, target string"), "authors")
    out, merges = rs.resolve_names(names(spark, "Bob Jones", "Jones, Robert"), ["slug", "pos"], aliases=aliases)
    assert {r["author"] for r in out.collect()} == {"Jones, Robert"} and ("Jones, Bob", "Jones, Robert") in {tuple(r) for r in merges.collect()}


def test_venues(spark):
    df = spark.createDataFrame([("I.B.Tauris",), ("I.B. Tauris",), ("I.B. Tauris",), ("Ethnos",), (None,), ("",)], "value string")
    venues, merges = rs.resolve_venues(df)
    assert {(r["canonical"], r["n"]) for r in venues.collect()} == {("I.B. Tauris", 3), ("Ethnos", 1)}
    assert [(r["canonical"], r["variants"]) for r in merges.collect()] == [("I.B. Tauris", ["I.B.Tauris"])]


def test_graph(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["a", "b", "c"],), (["d"],), ([],), (None,)], "authors array<string>")
    nodes, links = gr.coauthor_graph(df)
    assert {tuple(r) for r in links.collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)} and {tuple(r) for r in nodes.collect()} == {("a", 2), ("b", 2), ("c", 1)}
    nodes2, links2 = gr.coauthor_graph(df, 2)
    assert {tuple(r) for r in links2.collect()} == {("a", "b", 2)} and nodes2.count() == 2
    assert {r["id"] for r in gr.solo(spark.createDataFrame([("a",), ("d",)], "id string"), nodes).collect()} == {"d"}
    shown, between = gr.drawn(nodes, links, 1, ["c"])
    assert {r["id"] for r in shown.collect()} == {"a", "b", "c"} and between.count() == 3
    assert {(r["id"], r["role"]) for r in gr.focus(nodes, links2, ["a"]).collect()} == {("a", "selected"), ("b", "neighbour"), ("c", "other")}
    assert gr.signature(nodes, links).first()["ids"] == "a|b|c"


@pytest.mark.parametrize("mode, want", [(wd.WORDS, ["village", "state"]), (wd.LETTERS, ["village", "nation", "state", "state"])])
def test_terms(spark, mode, want):
    df = spark.createDataFrame([("u", 1, "Villages, the nation-state; «state» 42 of aims x"), ("u", 2, None), ("v", 3, "")], "unit string, id int, text string")
    got = wd.terms(df, "unit", "text", mode=mode, position=["id"]).orderBy("position").collect()
    assert [r["term"] for r in got] == want


def test_terms_with_a_dictionary(spark):
    lemmas = spark.createDataFrame([("mice", "mouse", "mice"), ("ran", "ran", "run")], "token string, noun string, verb string")
    df = spark.createDataFrame([("u", "mice ran far")], "unit string, text string")
    assert [r["term"] for r in wd.terms(df, "unit", "text", lemmas=lemmas).orderBy("position").collect()] == ["mouse", "run", "far"]


def test_frequencies_and_ties(spark):
    df = spark.createDataFrame([("u", 1, "zebra apple apple zebra"), ("v", 2, "apple")], "unit string, id int, text string")
    freq = wd.frequencies(wd.terms(df, "unit", "text", position=["id"]), spark.createDataFrame([("u",)], "unit string"))
    rows = [(r["unit"], r["text"], r["size"], r["rank"]) for r in wd.most_common(freq, 1).collect()]
    assert set(rows) == {("u", "zebra", 2, 1), ("v", "apple", 1, 1), (None, "zebra", 2, 1)}


def test_refresh(spark):
    schema = "slug string, fingerprint string"
    listing, cached = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], schema), spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], schema)
    assert {tuple(r) for r in rf.diff(listing, cached).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "new"), ("z", "withdrawn")}
    fresh = rf.stale(listing, cached)
    assert {r["slug"] for r in fresh.collect()} == {"b", "c"} and {tuple(r) for r in rf.merge(listing, cached, fresh).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    with pytest.raises(ValueError, match="not_empty"):
        rf.assert_gates(rf.gates(spark.createDataFrame([], "year int")))
    bad = rf.gates(spark.createDataFrame([(None,), (0,), (2001,)], "year int"), spark.createDataFrame([(i,) for i in range(9)], "y int"))
    assert {(r["gate"], r["ok"]) for r in bad.collect()} == {("not_empty", True), ("years", False), ("no_drop", False)}


def test_slim_records_take_the_latest_harvest(spark):
    schema = "slug string, url string, title string, subtitle string, authors array<string>, document_type string, year int, journal string, publisher string, series string, doi string, harvested_at int, ingested_at int"
    rows = [("a", "u", " t ", "", [None, " ", " x "], "", 0, None, "", None, None, 2, 1), ("a", "u", "old", "", ["y"], "T", 1999, None, "", None, None, 1, 9), (None, "u", "q", "", None, "T", 1, None, "", None, None, 1, 1)]
    got = slim_records(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and (got[0]["title"], got[0]["authors"], got[0]["type"], got[0]["year"], got[0]["publisher"]) == ("t", ["x"], None, None, None)
    assert slim_records(spark.createDataFrame([], schema)).count() == 0


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (" ", 4, "q")], "slug string, n int, v string")
    assert [r["v"] for r in rf.keep_first(df, "slug", ["n"]).collect()] == ["x"] and [r["v"] for r in rf.keep_last(df, "slug", ["n"]).collect()] == ["y"]
    assert df.select(F.count("*")).first()[0] == 4
