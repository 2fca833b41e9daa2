"""The refresh of a register in one piece: listing, what is stale, its pages, types, merge and gates.

Where pages come from is a parameter: a function from addresses (url) to pages (url, html, error), such as the polite
source over the network or a table of landed pages. So a run over landed pages and one over the network are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubscope.operators.extract import REGISTER, Layout, details, listing_entries, read_listing, read_options, seen_in
from pubscope.operators.refresh import assert_gates, gates, merge, stale, tag_types, with_fingerprint
from pubscope.session import cut
from pubscope.sources.crawl import fetch_pages

Fetch = Callable[[DataFrame], DataFrame]
#: Fixed value: no listing has more pages than this; one that says so is read up to here.
MAX_PAGES = 500


def from_landed(pages: DataFrame) -> Fetch:
    """Pages of a landed table (url, html); an address that isn't there is an error of its own."""

    def fetch(addresses: DataFrame) -> DataFrame:
        found = addresses.select("url").distinct().join(pages.select("url", "html"), "url", "left")
        return found.select("url", "html", F.when(F.col("html").isNull(), F.concat(F.col("url"), F.lit(": not landed"))).alias("error"))

    return fetch


def from_network(spark: SparkSession, **options: object) -> Fetch:
    """Pages by the polite source; a crawl's addresses are listed by the driver, as the source asks for them."""
    return lambda addresses: fetch_pages(spark, sorted(r["url"] for r in addresses.select("url").distinct().collect()), **options).select("url", "html", "error")


def _whole(pages: DataFrame) -> DataFrame:
    """The pages, cut; one that couldn't be fetched stops the run, since a listing with holes would withdraw records."""
    pages = cut(pages, "crawled")
    failed = pages.where("error is not null").select("error").first()
    if failed:
        raise ValueError(f"refused: {failed['error']}")
    return pages


def _ask(spark: SparkSession, fetch: Fetch, addresses: list[tuple[int, str]]) -> DataFrame:
    asked = spark.createDataFrame(addresses, "page long, url string")
    return _whole(fetch(asked)).join(F.broadcast(asked), "url").select("page", "url", "html")


def crawl_listing(spark: SparkSession, fetch: Fetch, address: Callable[[int], str], limit: int | None = None, max_pages: int = MAX_PAGES, expected: dict[int, str] | None = None, layout: Layout = REGISTER) -> DataFrame:
    """The entries of a listing, each slug where it is seen first.

    The first page tells how many there are; the others are fetched together. A first page without entries stops the
    run, as the pages have changed, and so does one whose filter offers other types than those ``expected``.
    """
    first = _ask(spark, fetch, [(1, address(1))])
    seen = read_listing(first.first()["html"] or "", layout)
    if not seen["entries"]:
        raise ValueError(f"refused: {address(1)}: no entries")
    if expected is not None:
        offered = {o["type_id"]: o["label"] for o in read_options(first.first()["html"] or "", layout)["options"]}
        if offered != expected:
            raise ValueError(f"refused: {address(1)}: other types: {sorted(offered.items() ^ expected.items())}")
    last = min(seen["last_page"] or 1, max_pages)
    pages = first if last < 2 else first.unionByName(_ask(spark, fetch, [(n, address(n)) for n in range(2, last + 1)]))
    return listing_entries(pages, limit=limit, layout=layout)


def type_sightings(spark: SparkSession, fetch: Fetch, address: Callable[[int, int], str], types: list[int], pending: DataFrame, max_pages: int = MAX_PAGES, layout: Layout = REGISTER) -> DataFrame:
    """slug, type_id of the pending slugs, from the listings of the types.

    All types' first pages come first, then their second ones, and so on (newest entries stand first), until no slug is
    pending or no listing goes on.
    """
    wanted = cut(pending.select("slug").distinct(), "pending")
    left, going, n = wanted, dict.fromkeys(types, 1), 0
    sightings = spark.createDataFrame([], "type_id int, slug string")
    while going and not left.isEmpty():
        n += 1
        asked = spark.createDataFrame([(t, address(t, n)) for t in going], "type_id int, url string")
        pages = _whole(fetch(asked)).join(F.broadcast(asked), "url").select("type_id", "html")
        shown = cut(seen_in(pages, "type_id", layout=layout), "typed")
        if n == 1:  # one row per type
            going = {r["type_id"]: min(r["last"] or 1, max_pages) for r in shown.groupBy("type_id").agg(F.max("last_page").alias("last")).collect()}
        found = shown.where("slug is not null").join(wanted, "slug", "left_semi").select("type_id", "slug")
        sightings = sightings.unionByName(found)
        left = cut(left.join(found, "slug", "left_anti"), "left")
        going = {t: last for t, last in going.items() if last > n}
    return sightings.distinct()


def refresh_register(
    spark: SparkSession, fetch: Fetch, cached: DataFrame, listing_address: Callable[[int], str], detail_address: str, types: DataFrame | None = None, type_address: Callable[[int, int], str] | None = None, limit: int | None = None, layout: Layout = REGISTER
) -> DataFrame:
    """The register after a refresh: one record per listed slug, fresh where the listing has changed, cached elsewhere.

    ``cached``: the register before (slug, fingerprint and the columns of ``details``). ``detail_address``: what a slug
    is put after. ``types``: type_id, label, ordinal, with ``type_address`` for their listings; without them recorded
    types stay. A page of another layout, and a result that fails its gates, stops the run; nothing is written here.
    """
    expected = None if types is None else {r["type_id"]: r["label"] for r in types.select("type_id", "label").collect()}
    listing = cut(with_fingerprint(crawl_listing(spark, fetch, listing_address, limit, expected=expected, layout=layout)), "listing")
    old = cut(cached, "cached")
    ask = cut(stale(listing, old).select("slug", "fingerprint", F.concat(F.lit(detail_address), "slug").alias("url")), "stale")
    pages = _whole(fetch(ask)).join(ask, "url").select("slug", "html")
    fresh = cut(details(pages, layout=layout), "details")
    broken = fresh.where("error is not null").first()
    if broken:
        raise ValueError(f"refused: {broken['slug']}: {broken['error']}")
    fresh = fresh.drop("error").join(ask.select("slug", "fingerprint", "url"), "slug").withColumn("document_type", F.lit(None).cast("string"))
    merged = merge(listing, old.select(*[c for c in fresh.columns]), fresh)
    if types is not None and type_address is not None:
        merged = tag_types(merged, type_sightings(spark, fetch, type_address, sorted(expected or {}), ask, layout=layout), types)
    merged = cut(merged, "register")
    assert_gates(gates(merged, None if limit is not None else old))
    return merged
