import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pubscope.functions import format as fmt
from pubscope.functions import names as nm
from pubscope.functions import parse as ps
from pubscope.functions import text as tx


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("Çetin", "cetin"), ("ﬁn ÉÀ", "fin ea"), ("Ахмед", "ахмед"), ("ʿAlī", "ʿali"), ("", ""), (None, None)])
def test_fold_key(spark, raw, want):
    assert one(spark, tx.fold_key, raw) == want


@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_folds_equal_their_python_form(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    for col, py in ((tx.fold_key, tx.fold_py), (tx.fold_search, tx.fold_search_py)):
        assert [r["x"] for r in df.select("i", col(F.col("v")).alias("x")).orderBy("i").collect()] == [py(v) for v in values]


@pytest.mark.parametrize(
    "a, b, equal",
    [("I.B.Tauris", "I.B. Tauris", True), ("The Journal of African History", "Journal of African History", True), ("al Rasheed", "Rasheed", True), ("Москва", "القاهرة", False), ("!!", "??", False)],
)
def test_merge_key(spark, a, b, equal):
    assert (one(spark, tx.merge_key, a) == one(spark, tx.merge_key, b)) == equal


@pytest.mark.parametrize(
    "raw",
    ["a-b-1", " a-b-1\xa0", "/pub/a-b-1/", "https://x.example/pub/a-b-1?lang=de", "A-B-1", "a%2Db%2D1", "/pub/a-b-1#abstract", "//x.example/a-b-1//"],
)
def test_slug_key(spark, raw):
    assert one(spark, tx.slug_key, raw) == "a-b-1"


def test_slug_key_of_nothing(spark):
    assert one(spark, tx.slug_key, "#x") == "" and one(spark, tx.slug_key, None) is None and one(spark, tx.slug_key, "a%ZZ") == "a%zz"


def test_nfc(spark):
    s = unicodedata.normalize("NFD", "Köln é")
    assert one(spark, tx.nfc, s) == "Köln é"


@pytest.mark.parametrize(
    "cell, want",
    [("Bromber, Katrin, Steiner, Christian", ["Bromber, Katrin", "Steiner, Christian"]), ("A, B; C D ;; ", ["A, B", "C D"]), ("A, B, C", ["A, B, C"]), ("", []), (" ; ", [])],
)
def test_split_authors(spark, cell, want):
    assert one(spark, nm.split_authors, cell) == want


@pytest.mark.parametrize("raw, want", [("Smith, J. (Ed.), et al.", "Smith, J."), ("Khan, Ahmed", "Khan, Ahm"), ("X u. a.", "X"), ("Reeds", "Re")])
def test_strip_noise(spark, raw, want):
    assert one(spark, nm.strip_noise, raw) == want


def test_strip_noise_with_whole_words(spark):
    assert one(spark, lambda c: nm.strip_noise(c, True), "Khan, Ahmed") == "Khan, Ahmed"
    assert one(spark, lambda c: nm.strip_noise(c, True), "Khan, A., eds.") == "Khan, A."


@pytest.mark.parametrize(
    "raw, want",
    [("Ludwig von Beethoven", ("von Beethoven", "Ludwig")), ("Kresse, Kai", ("Kresse", "Kai")), ("Birgitte Holst", ("Holst", "Birgitte")), ("Plato", ("Plato", "")), ("et al.", None), ("", None), (None, None)],
)
def test_canonical_name(spark, raw, want):
    got = one(spark, nm.canonical_name, raw)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("a, b, want", [("stefan", "stefan b", True), ("s", "samuli", False), ("s", "samuli b", True), ("jo", "john", False), ("", "x y", False), ("a b", "a b", False)])
def test_extends(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(nm.extends(F.col("a"), F.col("b"))).first()[0] is want


def test_extends_of_equal_length(spark):
    df = spark.createDataFrame([("s", "samuli"), ("sam", "sam")], "a string, b string")
    assert [r[0] for r in df.select(nm.extends(F.col("a"), F.col("b"), True)).collect()] == [True, False]


def test_short_name(spark):
    assert one(spark, nm.short_name, "Holst, Birgitte Anna") == "B. A. Holst" and one(spark, nm.short_name, "Plato") == "Plato"


@pytest.mark.parametrize(
    "line, want",
    [("04/05/2026", ("2026-05-04", 2026, None, [])), ("2026", (None, 2026, None, [])), ("Berghahn Books, Oxford, New York, 2026", (None, 2026, "Berghahn Books", ["Oxford", "New York"])), ("", (None, None, None, []))],
)
def test_parse_publisher(spark, line, want):
    got = one(spark, lambda c: ps.parse_publisher(F.array(c, F.lit("Series: Studies 3"))), line)
    assert (got["date"], got["year"], got["publisher"], got["places"]) == want and got["series"] == "Studies 3"


@pytest.mark.parametrize("line, want", [("Journal, 12, 3", ("Journal", "12", "3")), ("A, B, 1/2", ("A, B", "1/2", None)), ("J, 1, 2, 3", ("J", "1", "2")), ("12", ("12", None, None)), ("J, online first", ("J, online first", None, None)), (None, (None, None, None))])
def test_parse_periodical(spark, line, want):
    assert tuple(one(spark, ps.parse_periodical, line)) == want


def test_parse_identifiers(spark):
    got = spark.range(1).select(ps.parse_identifiers(F.array(F.lit("ISBN 1234-567X"), F.lit("DOI: https://dx.doi.org/10.1/a:b"))).alias("x")).first()["x"]
    assert (got["isbn"], got["issn"], got["doi"]) == (None, "1234-567X", "10.1/a:b")


def test_addresses(spark):
    assert one(spark, lambda c: ps.slug_of(c, "/en/list"), "/en/list/a-b?x=1") == "a-b"
    assert one(spark, lambda c: ps.slug_of(c, "/en/list"), "/en/list/page-2") is None
    long = "https://x.example/" + "a" * 100
    name = one(spark, ps.cache_name, long)
    from pubscope.sources.crawl import cache_file

    assert name == cache_file(long) and len(name) == 80 + 1 + 12 + 5


def test_formats(spark):
    row = spark.range(1).select(
        fmt.grouped(F.lit(1234567)).alias("en"), fmt.grouped(F.lit(1234567), "de").alias("de"), fmt.clean_word(F.lit("'word’ ")).alias("w"), fmt.extent_label(F.lit(1999), F.lit(1999)).alias("e"),
        fmt.range_label(F.lit(3), 12, F.lit(30)).alias("r"), fmt.translated(F.lit("x"), {"y": "z"}).alias("t"), fmt.tick_step(F.lit(41)).alias("s"), fmt.figure(F.lit(None).cast("int"), F.lit("–")).alias("f"),
        fmt.palette_slot(F.lit(10), F.lit(10), 6).alias("p"), fmt.preview_size(F.lit(5), F.lit(5), F.lit(5)).alias("px"),
    ).first()
    assert tuple(row) == ("1,234,567", "1.234.567", "word", "1999", "25–30 of 30", "x", 10, "–", 5, 22)
