"""The queries over the register: views under filters, series, names, graph, words, refresh and extraction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pubscope.functions import format as fmt
from pubscope.functions import names as nm
from pubscope.functions import parse as ps
from pubscope.functions.text import clean_text, fold_search, fold_search_py, merge_key, slug_key
from pubscope.operators import aggregate as ag
from pubscope.operators import extract as ex
from pubscope.operators import graph as gr
from pubscope.operators import refresh as rf
from pubscope.operators import resolve as rs
from pubscope.operators import words as wd
from pubscope.operators.filters import Filters, haystack, select
from pubscope.schema import latest, slim_records, some, some_items
from pubscope.session import cut, table
from pubscope.sources.sinks import unit_document

OTHER = "__other__"
#: The filters under which the views are computed here.
CHOSEN = Filters(type=frozenset({"Article in journal", "Chapter in volume", ""}), author=frozenset({"Hadanuyek, Emre", "Vabrojusol, Günther", "Gusovuzun, Henrike"}), venue=frozenset({"publisher:Robububer Haus Verlag", "journal:Hetahatu Quarterly", "publisher:Zjsiyudil Verlag"}), years=(1996, 2016), search="Über")
WIDE = Filters(type=CHOSEN.type, years=CHOSEN.years, search="The")
SELECTED = ["Gusovuzun, Henrike", "Vabrojusol, Günther", "Nobody, At All"]
TYPES = ["Monograph", "Review of a book", "Chapter in volume", "Volume (edited)", "Article in journal", "Thematic issue", "Working paper"]
ALIASES = [("authors", "Losülonur, Esra", "Losulonur, Esra"), ("authors", "_note", "x"), ("publishers", "Robububer Haus Verlag", "Verlag Robububer Haus"), ("publishers", "Zjsiyudil Verlag", "Zisiyudil Verlag"), ("publishers", "Voyofufo-House of Letters", "Voyofufo House of Letters")]


def rec(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return slim_records(table(spark, d, "publications"), *columns)


def pubs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest harvest of each slug."""
    return latest(table(spark, d, "publications"), "slug", ["harvested_at", "ingested_at"], list(columns))


# Views


def type_counts_rank(spark: SparkSession, d: str) -> DataFrame:
    """Publications by type, untyped ones among them, ranked."""
    return ag.rank(ag.count_types(rec(spark, d, "type")))


def xfilter_type(spark: SparkSession, d: str) -> DataFrame:
    return ag.rank(ag.count_types(select(rec(spark, d), WIDE, "type")))


def xfilter_author(spark: SparkSession, d: str) -> DataFrame:
    """Authors under every filter but the author's."""
    return ag.rank(ag.count_values(select(rec(spark, d), WIDE, "author"), "authors"))


def xfilter_venue(spark: SparkSession, d: str) -> DataFrame:
    """The 50 largest journals and publishers under every filter but the venue's."""
    seen = select(rec(spark, d), WIDE, "venue").select("journal", "publisher")
    parts = [ag.rank(ag.count_values(seen, f), 50).select(F.lit(f).alias("field"), "key", "count", "rank") for f in ("journal", "publisher")]
    return parts[0].unionByName(parts[1])


def _series(cube: DataFrame, whole: DataFrame) -> DataFrame:
    """The stacked series of a cube of counts, over the span and in the series of the whole one."""
    order = ag.top_keys_with_other(ag.count_types(whole), 4, OTHER)
    return ag.stacked_year_series(cube, ag.year_extent(whole), order, OTHER)


def xfilter_years(spark: SparkSession, d: str) -> DataFrame:
    """The year chart under every filter but the years', over the whole span and in the whole dataset's series."""
    marked = rec(spark, d).withColumn("haystack", haystack()).withColumn("seen", WIDE.predicate("years"))
    both = cut(marked.groupBy("year", "type", "seen").agg(F.count("*").alias("n")), "cube")
    return _series(both.where("seen").drop("seen"), both.groupBy("year", "type").agg(F.sum("n").alias("n")))


def xfilter_network(spark: SparkSession, d: str) -> DataFrame:
    return gr.coauthor_graph(select(rec(spark, d), WIDE, "author"), 2)[1]


def xfilter_list_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 20 of the list under all filters."""
    seen = cut(select(rec(spark, d), WIDE).select("slug", "title", "year", "type"), "seen")
    return ag.page(seen, 2, 20, ag.sorted_list(seen))


def xfilter_all(spark: SparkSession, d: str) -> DataFrame:
    """Records under all filters, author and venue among them."""
    return select(rec(spark, d), CHOSEN).select("slug", "year", "type")


def dashboard_views(spark: SparkSession, d: str) -> DataFrame:
    """All views' record counts from one scan: for each dimension, how many records pass the others."""
    flags = CHOSEN.flags()
    base = rec(spark, d).withColumn("haystack", haystack()).select(*[c.alias(k) for k, c in flags.items()])

    def passing(but: str | None) -> Column:
        out = F.lit(True)
        for k in flags:
            if k != but:
                out = out & F.col(k)
        return F.count_if(out)

    counted = base.agg(*[passing(k).alias(f"n_{k}") for k in flags], passing(None).alias("n_all"))
    return counted.select(F.stack(F.lit(6), *[x for k in [*flags, "all"] for x in (F.lit(k), F.col(f"n_{k}"))]).alias("view", "records"))


def dashboard_all(spark: SparkSession, d: str) -> DataFrame:
    """All six views under one filter from one scan: types, authors, venues, years, network, list; each without its own filter."""
    flags = WIDE.flags()
    marked = rec(spark, d).withColumn("haystack", haystack()).select("type", "year", "authors", "journal", "publisher", *[c.alias(f"on_{k}") for k, c in flags.items()])
    base = cut(marked, "views")

    def seen(but: str | None = None) -> DataFrame:
        return base.where(reduce(Column.__and__, [F.col(f"on_{k}") for k in flags if k != but]))

    views = {"type": ag.count_types(seen("type")), "author": ag.rank(ag.count_values(seen("author"), "authors"), 50)}
    views |= {f: ag.rank(ag.count_values(seen("venue"), f), 50) for f in ("journal", "publisher")}
    views["years"] = seen("years").where("year <> 0").groupBy(F.col("year").cast("string").alias("key")).agg(F.count("*").alias("count"))
    views["network"] = gr.coauthor_graph(seen("author"), 2)[1].select(F.concat_ws(" & ", "source", "target").alias("key"), F.col("weight").alias("count"))
    views["list"] = seen().agg(F.count("*").alias("count")).select(F.lit("").alias("key"), "count")
    return reduce(DataFrame.unionByName, [v.select(F.lit(k).alias("view"), "key", "count") for k, v in views.items()])


def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    got = ag.summary(cut(select(rec(spark, d), WIDE), "seen"))
    return got.withColumn("extent", fmt.extent_label(F.col("year_min"), F.col("year_max"))).withColumn("figure", fmt.figure(F.col("publications"), F.lit("–")))


def series_order(spark: SparkSession, d: str) -> DataFrame:
    """Which types keep their own series, and which are folded."""
    return ag.top_keys_with_other(ag.count_types(rec(spark, d, "type")), 4, OTHER)


def stacked_years(spark: SparkSession, d: str) -> DataFrame:
    cube = cut(ag.year_type_counts(rec(spark, d, "year", "type")), "cube")
    return ag.with_shares(_series(cube, cube))


def meta_per_year(spark: SparkSession, d: str) -> DataFrame:
    got = ag.per_year(cut(rec(spark, d, "year").select("year"), "years"))
    return got.withColumn("height", fmt.sparkline_height(F.col("count"), F.max("count").over(W.partitionBy())))


def meta_types(spark: SparkSession, d: str) -> DataFrame:
    return rf.ordered_types(TYPES, rec(spark, d, "type"))


def year_ticks(spark: SparkSession, d: str) -> DataFrame:
    return ag.year_ticks(ag.year_extent(rec(spark, d, "year")))


def year_options(spark: SparkSession, d: str) -> DataFrame:
    """The years of the range menu, last first, with the chosen ones marked."""
    extent = ag.year_extent(rec(spark, d, "year")).where("year_min is not null")
    years = extent.select(F.posexplode(F.sequence("year_max", "year_min", F.lit(-1))).alias("pos", "year"))
    return years.withColumn("chosen", F.coalesce(F.col("year").between(*CHOSEN.years), F.lit(False)))


def search_substring(spark: SparkSession, d: str) -> DataFrame:
    return select(rec(spark, d), Filters(search=" Cemetery ")).select("slug", "title")


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The eight best matches for "ver" among authors, journals and publishers: early match, then count, then value."""
    records = cut(rec(spark, d, "authors", "journal", "publisher").drop("slug"), "records")
    kinds = {"author": "authors", "journal": "journal", "publisher": "publisher"}
    index = [ag.count_values(records, c).select(F.lit(k).alias("kind"), F.col("key").alias("value"), "count") for k, c in kinds.items()]
    found = index[0].unionByName(index[1]).unionByName(index[2]).withColumn("at", F.instr(fold_search(F.col("value")), fold_search_py("Ver")) - 1)
    return found.where("at >= 0").orderBy("at", F.desc("count"), "value", "kind").limit(8)


def list_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each author's place in the ranking, its page of twelve, and its share of the largest."""
    ranked = cut(ag.rank(ag.count_values(rec(spark, d, "authors"), "authors")), "ranking")
    peak = ranked.agg(F.max("count")).scalar()
    return ranked.select("key", "count", "rank", ag.page_of(F.col("rank"), 12).alias("page"), (F.col("count") / peak * 100).alias("share"))


def record_labels(spark: SparkSession, d: str) -> DataFrame:
    """What a list entry shows: title, venue, authors, address of the DOI, short name of the first author."""
    r = rec(spark, d)
    return r.select(
        "slug", fmt.title_label(F.col("title"), F.col("subtitle"), F.col("slug")).alias("label"), fmt.venue_label(F.col("journal"), F.col("publisher"), F.col("series")).alias("venue"),
        F.array_join("authors", "; ").alias("names"), fmt.doi_link(F.col("doi")).alias("link"), nm.short_name(F.get("authors", F.lit(0))).alias("first"),
    )


# Names and venues


def merge_keys(spark: SparkSession, d: str) -> DataFrame:
    """Forms of names with the keys that merge them."""
    return table(spark, d, "name_forms").select("name_id", merge_key(F.col("form")).alias("key"))


def _venues(spark: SparkSession, d: str) -> DataFrame:
    return rec(spark, d, "publisher").select(F.col("publisher").alias("value"))


def venue_canonical(spark: SparkSession, d: str) -> DataFrame:
    return rs.resolve_venues(_venues(spark, d))[0]


def venue_merges(spark: SparkSession, d: str) -> DataFrame:
    return rs.resolve_venues(_venues(spark, d))[1].select("canonical", F.array_join("variants", " | ").alias("variants"))


def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Publishers after the curated aliases."""
    aliases = rs.alias_table(spark.createDataFrame(ALIASES, "section string, variant string, target string"), "publishers")
    return rs.resolve_venues(_venues(spark, d), aliases=aliases)[0]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listing_entries").select("entry_id", "authors")


def author_split(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the listing read by the register's own simple rule, notes stripped."""
    return _cells(spark, d).select("entry_id", F.posexplode(nm.split_authors(F.col("authors"))).alias("pos", "raw")).select("entry_id", F.col("pos").cast("bigint").alias("pos"), "raw", nm.strip_noise(F.col("raw")).alias("name"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return rec(spark, d, "authors").select("slug", F.posexplode("authors").alias("pos", "name"))


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Persons' keys with their counts and fullest display."""
    return rs.name_keys(rs.read_names(_names(spark, d)), ["slug", "pos"])


def prefix_fold(spark: SparkSession, d: str) -> DataFrame:
    """Shortened given names with the only fuller one they can belong to."""
    return rs.fuller_names(cut(rs.name_keys(rs.read_names(_names(spark, d)), ["slug", "pos"]), "keys"))


def name_display(spark: SparkSession, d: str) -> DataFrame:
    """Publications per consolidated author; a name that a merge repeats in one record counts once."""
    named, _ = rs.resolve_names(cut(_names(spark, d), "names"), ["slug", "pos"])
    return named.groupBy("author").agg(F.countDistinct("slug").alias("publications"))


# Graph


def _graph(spark: SparkSession, d: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    nodes, links = gr.coauthor_graph(cut(rec(spark, d, "authors").select("authors"), "authors"), least)
    return nodes, links


def coauthor_links(spark: SparkSession, d: str) -> DataFrame:
    links = _graph(spark, d)[1]
    return links.select("source", "target", "weight", fmt.edge_width(F.col("weight")).alias("width"), fmt.edge_distance(F.col("weight")).alias("distance"))


def coauthor_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _graph(spark, d)[0]
    peak = nodes.agg(F.max("count")).scalar()
    return nodes.select("id", "count", fmt.node_radius(F.col("count"), peak).alias("radius"))


def neighbour_map(spark: SparkSession, d: str) -> DataFrame:
    return gr.neighbours(_graph(spark, d)[1]).select("id", F.array_join("neighbours", " | ").alias("neighbours"), "degree")


def ego_network(spark: SparkSession, d: str) -> DataFrame:
    """The links among the selected authors and their co-authors."""
    links = cut(_graph(spark, d)[1], "links")
    return gr.own_links(gr.induced(links, gr.ego(links, SELECTED)), SELECTED)


def drawn_network(spark: SparkSession, d: str) -> DataFrame:
    """The drawn part: the 60 busiest, the selected ones and their neighbours, with their roles."""
    nodes, links = (cut(x, "graph") for x in _graph(spark, d))
    shown, between = gr.drawn(nodes, links, 60, SELECTED)
    return gr.focus(shown, between, SELECTED)


def network_signature(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = (cut(x, "graph") for x in _graph(spark, d))
    return gr.signature(*gr.drawn(nodes, links, 60))


def solo_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors without a co-author."""
    records = cut(rec(spark, d, "authors").select("authors"), "authors")
    everyone = records.select(F.explode("authors").alias("id")).distinct()
    return gr.solo(everyone, gr.coauthor_graph(records)[0])


# Words


def _terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", "text")
    return wd.term_counts(docs, "source", "text", mode=wd.LETTERS, position=["doc_id"])


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most common terms of each source and of the member sources together."""
    members = spark.createDataFrame([("abstracts",), ("project_pages",), ("book_reviews",)], "unit string")
    return wd.most_common(wd.frequencies(_terms(spark, d), members), 100).withColumn("unit", F.coalesce("unit", F.lit("(combined)")))


def term_totals(spark: SparkSession, d: str) -> DataFrame:
    return wd.token_totals(_terms(spark, d)).select(F.coalesce("unit", F.lit("(all)")).alias("unit"), "tokens")


def _top_words(spark: SparkSession, d: str) -> DataFrame:
    freq = wd.frequencies(_terms(spark, d)).where("unit is not null")
    return cut(wd.most_common(freq, 100), "words")


def merged_groups(spark: SparkSession, d: str) -> DataFrame:
    """The sources' top words merged: sizes summed, the sources listed."""
    return wd.merge_groups(_top_words(spark, d), F.col("unit")).select("text", "size", F.array_join("units", " | ").alias("units"))


def prepared_words(spark: SparkSession, d: str) -> DataFrame:
    """The 75 largest merged words with what a cloud needs of them."""
    merged = wd.merge_groups(_top_words(spark, d), F.col("unit"))
    return wd.layout(wd.prepare(merged, 75, "text"), 960 * 540, least=12.0, most=90.0)


def word_previews(spark: SparkSession, d: str) -> DataFrame:
    """The 30 largest words in the preview's order, with their sizes there."""
    merged = wd.merge_groups(_top_words(spark, d), F.col("unit"))
    top = wd.prepare(merged, 31, "text").select("text", "size", "rank")
    low, high = F.min("size").over(W.partitionBy()), F.max("size").over(W.partitionBy())
    return ag.stride_order(top, 5).select("text", F.col("slot").cast("int").alias("slot"), fmt.preview_size(F.col("size"), low, high).alias("px"))


def word_context(spark: SparkSession, d: str) -> DataFrame:
    return wd.context_figures(wd.merge_groups(_top_words(spark, d), F.col("unit")))


# Refresh


def listing_first(spark: SparkSession, d: str) -> DataFrame:
    """Listing lines, each slug where it is seen first."""
    rows = table(spark, d, "listing_entries").select("slug", "title", "authors", "publisher", "periodical", "page", "pos", "entry_id")
    return rf.keep_first(rows, "slug", ["page", "pos", "entry_id"]).select("slug", "page", "pos", "entry_id")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The last two snapshot dates as listing and cache: the last row of each slug, with fingerprint."""
    rows = table(spark, d, "publication_snapshots").select("snapshot_date", "delivery", "row_no", some(F.col("slug")).alias("slug"), "title", "authors", "publisher", F.lit(None).cast("string").alias("periodical"))
    days = [r[0] for r in rows.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(2).collect()]
    days += [None] * (2 - len(days))
    both = [rf.with_fingerprint(rf.keep_last(rows.where(F.col("snapshot_date") == F.lit(day)), "slug", ["delivery", "row_no", "title"])).drop("snapshot_date") for day in days]
    return both[0], both[1]


def refresh_diff(spark: SparkSession, d: str) -> DataFrame:
    listing, cached = _snapshots(spark, d)
    return rf.diff(listing, cached)


def refresh_merge(spark: SparkSession, d: str) -> DataFrame:
    """The register after a refresh: fresh records for stale entries, cached ones for the rest."""
    listing, cached = (cut(x, "snapshot") for x in _snapshots(spark, d))
    fresh = rf.stale(listing, cached).withColumn("origin", F.lit("fresh"))
    return rf.merge(listing, cached.withColumn("origin", F.lit("cached")), fresh).select("slug", "origin", "fingerprint")


def type_tagging(spark: SparkSession, d: str) -> DataFrame:
    """Listing lines with the type under which their slug is listed."""
    types = spark.createDataFrame([(i, t, i) for i, t in enumerate(TYPES)], "type_id int, label string, ordinal int")
    records = listing_first(spark, d).select("slug", F.lit(None).cast("string").alias("document_type"))
    seen = table(spark, d, "publications").join(F.broadcast(types.select("type_id", F.col("label").alias("document_type"))), "document_type").select("slug", "type_id")
    return rf.tag_types(records, seen, types)


def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """The expected types against those that the register shows."""
    expected = spark.createDataFrame(list(enumerate(TYPES)), "type_id int, label string")
    found = rec(spark, d, "type").where("type is not null").select("type").distinct()
    actual = found.join(F.broadcast(expected.withColumnRenamed("label", "type")), "type", "left").select(F.coalesce("type_id", 100 + F.length("type")).alias("type_id"), F.when(F.col("type_id") == 2, F.upper("type")).otherwise(F.col("type")).alias("label"))
    return rf.schema_drift(expected, actual)


def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    records = rec(spark, d, "year")
    return rf.gates(records, table(spark, d, "publications").select("slug").distinct())


def published_in(spark: SparkSession, d: str) -> DataFrame:
    """Chapters with the volume they point to, where the register has it."""
    refs = table(spark, d, "volume_refs").select("ref_id", "from_slug", slug_key(F.col("slug")).alias("target"), "title")
    volumes = rec(spark, d, "title", "year").select(F.col("slug").alias("target"), F.col("title").alias("volume"), F.col("year").alias("volume_year"))
    return refs.distinct().join(volumes, "target", "left").select("ref_id", "from_slug", "target", "volume", "volume_year")


# Extraction


def imprints(spark: SparkSession, d: str) -> DataFrame:
    """Imprint lines put together and read again."""
    p = pubs(spark, d, "publisher", "places", "iso_date", "year", "series")
    date = F.regexp_replace("iso_date", r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")
    line = F.concat_ws(", ", "publisher", "places", F.coalesce(date, F.nullif(F.col("year"), F.lit(0)).cast("string")))
    x = p.select("slug", ps.parse_publisher(F.array(line, F.concat(F.lit("Series: "), F.coalesce("series", F.lit(""))))).alias("x"))
    return x.select("slug", "x.date", "x.year", "x.publisher", F.array_join("x.places", " | ").alias("places"), "x.series")


def periodicals(spark: SparkSession, d: str) -> DataFrame:
    p = pubs(spark, d, "journal", "volume", "issue")
    return p.select("slug", ps.parse_periodical(F.concat_ws(", ", "journal", "volume", "issue")).alias("x")).select("slug", "x.journal", "x.volume", "x.issue")


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    p = pubs(spark, d, "isbn", "issn", "doi", "pages", "series", "year")
    lines = F.array_compact(F.array(F.concat(F.lit("ISBN "), F.coalesce(some(F.col("isbn")), some(F.col("issn")))), F.concat(F.lit("DOI: https://doi.org/"), some(F.col("doi")))))
    x = p.select("slug", ps.parse_identifiers(lines).alias("x"), ps.pages_line(F.array(F.lit("Open access"), F.coalesce("pages", F.lit("")))).alias("pages"), ps.year_or_guess(F.col("year"), F.col("series"), F.col("pages")).alias("year"))
    return x.select("slug", "x.isbn", "x.issn", "x.doi", "pages", "year")


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of publications: slug, file name of the cache, encoded listing address."""
    p = pubs(spark, d, "url", "document_type")
    path = F.regexp_replace("url", r"^https?://[^/]*", "")
    return p.select("slug", ps.slug_of(path, "/pub").alias("of"), ps.cache_name(F.col("url")).alias("file"), ps.absolute_url("https://register.example", path).alias("url"), ps.listing_url("/list", F.lit(3), "filter[type]", F.coalesce("document_type", F.lit(""))).alias("listing"))


def byline_filter(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of unit pages without blank ones and leading bylines."""
    pages = table(spark, d, "unit_pages").select("page_id", F.transform("paragraphs", clean_text).alias("p"))
    return pages.select("page_id", F.posexplode(ex.without_leading_bylines(F.col("p"))).alias("pos", "text")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


def unit_documents(spark: SparkSession, d: str) -> DataFrame:
    """A page as a text file: title and paragraphs with blank lines between."""
    pages = table(spark, d, "unit_pages")
    body = F.filter(F.transform("paragraphs", clean_text), lambda p: p.isNotNull() & (p != ""))
    none = F.array().cast("array<struct<title:string,paragraphs:array<string>>>")
    return pages.select("page_id", unit_document(some(F.col("title")), body, none).alias("document"))


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _html(*parts: Column | str) -> Column:
    lay = ex.REGISTER
    return F.concat(F.lit(f"<html><nav><a href='/x'>Menu</a></nav>{lay.begin}"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(f"{lay.end}<footer>Imprint</footer></html>"))


def listing_html(spark: SparkSession, d: str) -> DataFrame:
    """Listing lines written as pages and read from them."""
    rows = table(spark, d, "listing_entries").where("slug is not null and slug <> ''")
    item = _html("<article class='bb-publication--item'><h2 class='bb-publication--header__subheadline'><a href='", ex.REGISTER.listing + "/", _escape(F.col("slug")), "?tx=1'>", _escape(F.col("title")), "</a></h2><h3 class='bb-entry--authors'>", _escape(F.col("authors")), "</h3><p class='bb-publication--publisher'>", _escape(F.col("publisher")), "</p><p class='bb-publication--periodical'>", _escape(F.col("periodical")), "</p></article>")
    pages = rows.select((F.col("page").cast("bigint") * 100_000 + F.col("pos")).alias("page"), item.alias("html"))
    return ex.listing_entries(pages).select("slug", "page", "title", "authors", "publisher", "periodical")


def detail_html(spark: SparkSession, d: str) -> DataFrame:
    """Publications written as pages of their own and read from them."""
    p = pubs(spark, d, "title", "subtitle", "authors", "abstract", "doi", "isbn")
    names = F.array_join(some_items(F.col("authors")), "; ")
    html = _html("<article class='bb-publication--detail'><header class='bb-publication--header'><h1 class='bb-publication--header__headline'>", _escape(F.col("title")), "</h1><h2 class='bb-publication--header__subheadline'>", _escape(F.col("subtitle")), "</h2></header><h3 class='bb-publication--authors'>", _escape(names), "</h3><div class='bb-publication--bodytext'><p>", _escape(F.col("abstract")), "</p></div><div class='cell medium-9'><div>ISBN ", _escape(F.coalesce(some(F.col("isbn")), F.lit("none"))), "<br>DOI: https://dx.doi.org/", _escape(F.coalesce(some(F.col("doi")), F.lit("none"))), "</div></div></article>")
    got = ex.details(p.select("slug", html.alias("html")))
    return got.select("slug", "title", "subtitle", F.array_join("authors", "; ").alias("authors"), "abstract", "doi", F.coalesce("isbn", "issn").alias("number"))


def unit_html(spark: SparkSession, d: str) -> DataFrame:
    """Unit pages written as HTML and read from it: the paragraphs of the abstract."""
    pages = table(spark, d, "unit_pages")
    body = F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit("<p>"), _escape(p), F.lit("</p>"))), "")
    html = _html("<h1>", _escape(F.coalesce("title", F.lit(""))), "</h1><div class='ce-bodytext'>", F.coalesce(body, F.lit("")), "</div><h2 class='bb-entry--title'><a href='/one'>One</a></h2><h2 class='bb-section--title'>Umbrella</h2><div class='ce-bodytext'><p>Text of it.</p></div>")
    read = ex.unit_pages(pages.select("page_id", html.alias("html")))
    return read.select("page_id", F.posexplode("abstract").alias("pos", "text")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        type_counts_rank, xfilter_type, xfilter_author, xfilter_venue, xfilter_years, xfilter_network, xfilter_list_page, xfilter_all, dashboard_views, dashboard_all, summary_counts,
        series_order, stacked_years, meta_per_year, meta_types, year_ticks, year_options, search_substring, suggestions, list_pages, record_labels,
        merge_keys, venue_canonical, venue_merges, alias_lookup, author_split, name_keys, prefix_fold, name_display,
        coauthor_links, coauthor_nodes, neighbour_map, ego_network, drawn_network, network_signature, solo_authors,
        term_frequencies, term_totals, merged_groups, prepared_words, word_previews, word_context,
        listing_first, refresh_diff, refresh_merge, type_tagging, schema_drift, quality_gates, published_in,
        imprints, periodicals, identifiers, addresses, byline_filter, unit_documents, listing_html, detail_html, unit_html,
    )
}
