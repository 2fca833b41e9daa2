import pytest
from pyspark.sql import types as T

from pubscope.operators import extract as ex
from pubscope.operators import pipeline as pl

LAY, SITE = ex.REGISTER, "https://s.example"


def listing(slugs, last=None, types=()):
    items = "".join(f"<article class='bb-publication--item'><h2 class='bb-publication--header__subheadline'><a href='{LAY.listing}/{s}'>{t}</a></h2></article>" for s, t in slugs)
    end = f"<div class='bb-pagination--item__end'><a href='{LAY.listing}/page-{last}'>last</a></div>" if last else ""
    options = "".join(f"<option value='{k}'>{t}</option>" for k, t in types)
    return f"{LAY.begin}{items}<select name='{LAY.type_select}'>{options}</select>{end}{LAY.end}"


def detail(title, year="2001"):
    return f"<article class='bb-publication--detail'><h1 class='bb-publication--header__headline'>{title}</h1><p class='bb-publication--publisher'>House, {year}</p></article>"


def page(n):
    return f"{SITE}{LAY.listing}" + (f"/page-{n}" if n > 1 else "")


def run(spark, pages, cached=(), **more):
    asked = []
    landed = pl.from_landed(spark.createDataFrame(list(pages.items()), "url string, html string"))

    def fetch(addresses):
        asked.extend(r["url"] for r in addresses.select("url").collect())
        return landed(addresses)

    empty = ex.details(spark.createDataFrame([], "slug string, html string")).drop("error")
    fields = [f.name for f in empty.schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in empty.schema.fields] + [T.StructField(c, T.StringType()) for c in ("fingerprint", "url", "document_type")])
    old = spark.createDataFrame([tuple({"slug": s, "title": t, "year": 2000, "fingerprint": m, "url": "u", "document_type": "Old"}.get(c) for c in [*fields, "fingerprint", "url", "document_type"]) for s, t, m in cached], schema)
    got = pl.refresh_register(spark, fetch, old, page, f"{SITE}{LAY.listing}/", **more)
    return {r["slug"]: r for r in got.collect()}, asked


def test_a_refresh_follows_pages_and_fetches_only_what_changed(spark):
    types = spark.createDataFrame([(1, "Book", 0), (2, "Paper", 1)], "type_id int, label string, ordinal int")
    both = [(1, "Book"), (2, "Paper")]
    pages = {page(1): listing([("a", "A"), ("b", "B")], 3, both), page(2): listing([("c", "C"), ("a", "again")], 3), page(3): listing([("d", "D")], 3)}
    pages |= {f"{page(1)}?1": listing([("b", "B")]), f"{page(1)}?2": listing([("x", "X")], 2), f"{page(2)}?2": listing([("d", "D")])}
    pages |= {f"{SITE}{LAY.listing}/{s}": detail(s.upper()) for s in "bcd"}
    cached = [("a", "kept", "A |  |  | "), ("b", "old", "before |  |  | "), ("gone", "x", "y"), ("c", "old", None)]
    got, asked = run(spark, pages, cached, types=types, type_address=lambda t, n: f"{page(n)}?{t}")
    assert {s: (r["title"], r["document_type"]) for s, r in got.items()} == {"a": ("kept", "Old"), "b": ("B", "Book"), "c": ("C", None), "d": ("D", "Paper")}
    assert f"{SITE}{LAY.listing}/a" not in asked and got["a"]["fingerprint"] == "A |  |  | "


@pytest.mark.parametrize(
    "pages, match",
    [
        ({page(1): listing([])}, "no entries"),
        ({page(1): listing([("a", "A")], 2)}, "not landed"),
        ({page(1): listing([("a", "A")])}, "not landed"),
        ({page(1): listing([("a", "A")]), f"{SITE}{LAY.listing}/a": "<p>another layout</p>"}, "no detail article"),
        ({page(1): listing([("a", "A")]), f"{SITE}{LAY.listing}/a": detail("A", "no year")}, "years"),
    ],
)
def test_what_cannot_be_trusted_is_refused(spark, pages, match):
    with pytest.raises(ValueError, match=match):
        run(spark, pages)


def test_other_types_are_refused(spark):
    types = spark.createDataFrame([(1, "Book", 0)], "type_id int, label string, ordinal int")
    with pytest.raises(ValueError, match="other types"):
        run(spark, {page(1): listing([("a", "A")], types=[(1, "Books")])}, types=types, type_address=lambda t, n: "x")


def test_no_more_than_the_most_pages(spark):
    pages = {page(n): listing([(f"s{n}", "T")], 9) for n in range(1, 10)}
    fetch = pl.from_landed(spark.createDataFrame(list(pages.items()), "url string, html string"))
    assert pl.crawl_listing(spark, fetch, page, max_pages=4).count() == 4
