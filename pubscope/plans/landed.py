"""Queries over landed pages and files, filter states and request parameters, with their SQL.

Pages and files are written from the tables and read again by the library's own sources, so that what comes back can be
compared with the tables themselves.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pubscope.functions import format as fmt
from pubscope.functions.parse import block_lines
from pubscope.functions.text import clean_text, fingerprint
from pubscope.operators import aggregate as ag
from pubscope.operators import extract as ex
from pubscope.operators import pipeline as pl
from pubscope.operators import resolve as rs
from pubscope.operators import words as wd
from pubscope.operators.filters import Filters, select
from pubscope.plans.register import CHOSEN, TYPES, WIDE, _escape, _html, pubs, rec
from pubscope.plans.register_sql import _LAST, _READ, _REC, _WS, _clean, _key, _list, _some, _strip, _where
from pubscope.schema import some, some_items
from pubscope.session import cut, scratch, table
from pubscope.sources import crawl, readers, sinks

SITE = "https://register.example"
ENTRIES = 50  # on a listing page, on average


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


# The refresh from landed pages


def _site(spark: SparkSession, d: str) -> DataFrame:
    """url, html of a register's site: listing pages, listings by type, and a page for each publication."""
    lay = ex.REGISTER
    p = cut(pubs(spark, d, "title", "subtitle", "authors", "abstract", "doi", "publisher", "journal", "document_type", "iso_date", "year"), "site")
    names = F.array_join(some_items(F.col("authors")), "; ")
    item = F.concat(
        F.lit(f"<article class='bb-publication--item'><h2 class='bb-publication--header__subheadline'><a href='{lay.listing}/"), "slug", F.lit("'>"), _escape(F.col("title")), F.lit("</a></h2><h3 class='bb-entry--authors'>"), _escape(names),
        F.lit("</h3><p class='bb-publication--publisher'>"), _escape(F.col("publisher")), F.lit("</p><p class='bb-publication--periodical'>"), _escape(F.col("journal")), F.lit("</p></article>"),
    )
    last = max(1, min(pl.MAX_PAGES // 2, -(-p.count() // ENTRIES)))
    options = "".join(f"<option value='{k}'>{t}</option>" for k, t in enumerate(TYPES))
    end = f"<select name='{lay.type_select}'><option value=''>All</option>{options}</select><div class='bb-pagination--item__end'><a href='{lay.listing}/page-{last}'>last</a></div>"

    def listing(rows: DataFrame, pages: int, end: str, start: Column) -> DataFrame:
        """A page's entries are those whose slug hashes to it; every page up to the last one exists."""
        at = rows.select((F.conv(F.left(F.md5("slug"), F.lit(7)), 16, 10).cast("int") % pages).alias("n"), "slug", item.alias("item"))
        body = at.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slug", "item"))), lambda x: x["item"]), "").alias("body"))
        every = spark.range(pages).select(F.col("id").cast("int").alias("n")).join(body, "n", "left")
        path = F.when(F.col("n") == 0, lay.listing).otherwise(F.concat(F.lit(f"{lay.listing}/page-"), (F.col("n") + 1).cast("string")))
        return every.select(F.concat(F.lit(SITE), path, start).alias("url"), _html(F.coalesce("body", F.lit("")), end).alias("html"))

    out = listing(p, last, end, F.lit(""))
    for k, t in enumerate(TYPES):
        out = out.unionByName(listing(p.where(F.col("document_type") == t), 2, f"<div class='bb-pagination--item__end'><a href='{lay.listing}/page-2'>last</a></div>", F.lit(f"?type={k}")))
    date = F.regexp_replace("iso_date", r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")
    house = F.concat_ws(", ", some(F.regexp_replace("publisher", ",", "")), F.coalesce(some(date), F.nullif(F.col("year"), F.lit(0)).cast("string")))
    detail = _html(
        "<article class='bb-publication--detail'><header class='bb-publication--header'><h1 class='bb-publication--header__headline'>", _escape(F.col("title")), "</h1><h2 class='bb-publication--header__subheadline'>", _escape(F.col("subtitle")),
        "</h2></header><h3 class='bb-publication--authors'>", _escape(names), "</h3><p class='bb-publication--publisher'>", _escape(house), "</p><p class='bb-publication--periodical'>", _escape(F.regexp_replace("journal", ",", "")),
        "</p><div class='bb-publication--bodytext'><p>", _escape(F.col("abstract")), "</p></div><div class='cell medium-9'><div>DOI: https://doi.org/", _escape(F.coalesce(some(F.col("doi")), F.lit("none"))), "</div></div></article>",
    )
    return out.unionByName(p.select(F.concat(F.lit(f"{SITE}{lay.listing}/"), "slug").alias("url"), detail.alias("html")))


def _marks(source: str) -> Column:
    c = lambda x: F.coalesce(clean_text(x), F.lit(""))
    return fingerprint(c(F.col(f"{source}title")), c(F.array_join(some_items(F.col(f"{source}authors")), "; ")), c(F.col(f"{source}publisher")), c(F.col(f"{source}journal")))


def refresh_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole refresh over landed pages: the first harvests are the register before, the last ones what the site shows."""
    lay = ex.REGISTER
    site = cut(_site(spark, d), "landed")
    first = table(spark, d, "publications").where("slug is not null").groupBy("slug").agg(F.min_by(F.struct("title", "authors", "publisher", "journal", "document_type", "doi", "year"), F.struct("harvested_at", "ingested_at")).alias("f"))
    empty = ex.details(site.limit(0).select(F.lit("").alias("slug"), "html")).drop("error")
    known = {"title": F.lit("cached"), "document_type": F.col("f.document_type"), "fingerprint": _marks("f."), "slug": F.col("slug"), "url": F.lit("cached"), "year": F.coalesce("f.year", F.lit(1))}
    cached = first.select(*[(known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields], *[known[c].alias(c) for c in ("fingerprint", "url", "document_type")])
    types = spark.createDataFrame([(k, t, k) for k, t in enumerate(TYPES)], "type_id int, label string, ordinal int")
    page = lambda n: f"{SITE}{lay.listing}" + (f"/page-{n}" if n > 1 else "")
    got = pl.refresh_register(spark, pl.from_landed(site), cached, page, f"{SITE}{lay.listing}/", types, lambda t, n: f"{page(n)}?type={t}")
    return got.select("slug", "title", "document_type", "fingerprint", F.array_join("authors", "; ").alias("names"))


def crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 entries of the landed listing, following its pages."""
    lay = ex.REGISTER
    page = lambda n: f"{SITE}{lay.listing}" + (f"/page-{n}" if n > 1 else "")
    return pl.crawl_listing(spark, pl.from_landed(cut(_site(spark, d), "landed")), page, limit=100).select("slug", "page")


# Pages: options, references, contributions, notes, unit pages


def type_options(spark: SparkSession, d: str) -> DataFrame:
    """The types that a page's filter offers, against those expected."""
    options = "".join(f"<option value='{k + 20}'>{t}</option>" for k, t in enumerate(TYPES))
    html = f"{ex.REGISTER.begin}<select name='other'><option value='1'>no</option></select><select name='{ex.REGISTER.type_select}'><option value=''>All</option>{options}</select>{ex.REGISTER.end}"
    return ex.type_options(spark.createDataFrame([(html,)], "html string"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    volumes = table(spark, d, "volume_refs").groupBy("from_slug").agg(F.min("ref_id").alias("v"))
    parts = table(spark, d, "contribution_refs").select("from_slug", "ref_id").distinct().groupBy("from_slug").agg(F.array_sort(F.collect_list("ref_id")).alias("c"))
    lay, at = ex.REGISTER, lambda k: F.col(k).cast("string")
    v = F.when(F.col("v").isNotNull(), F.concat(F.lit("<div>In: <span class='bb-entry--authors__user'>E"), at("v"), F.lit(f", F; G, H</span> (Ed.) <a href='{lay.listing}/v"), at("v"), F.lit("'>V"), at("v"), F.lit("</a>, sub "), at("v"), F.lit("</div>")))
    one = lambda x: F.concat(F.when(x % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<span>A"), x.cast("string"), F.lit(", X; B, Y</span>"))), F.lit(f"<a href='{lay.listing}/c"), x.cast("string"), F.lit("'>T"), x.cast("string"), F.lit("</a>"))
    c = F.concat(F.lit("<strong>Contributions from us</strong><br>"), F.array_join(F.transform("c", one), ""))
    note = F.when(F.coalesce("v", F.element_at("c", 1)) % 2 == 0, F.lit("<strong>Info</strong>")).otherwise("")
    html = _html("<article class='bb-publication--detail'><header class='bb-publication--header'><h1 class='bb-publication--header__headline'>T</h1>", F.coalesce(v, F.lit("")), "</header><div class='bb-publication--bodytext'>", note, "<p>Text.</p></div><div class='cell medium-9'>", F.coalesce(c, F.lit("")), "</div></article>")
    return ex.details(volumes.join(parts, "from_slug", "full").select(F.col("from_slug").alias("slug"), html.alias("html")))


def detail_references(spark: SparkSession, d: str) -> DataFrame:
    """The volume that each record's page names, and its notes and abstracts."""
    got = _references(spark, d)
    v = F.col("published_in")
    return got.select("slug", v["slug"].alias("target"), v["title"].alias("title"), v["subtitle"].alias("subtitle"), F.array_join(v["authors"], " | ").alias("names"), v["role"].alias("role"), "abstract", "note")


def detail_contributions(spark: SparkSession, d: str) -> DataFrame:
    """The contributions that each record's page lists, with the names that stand before them."""
    got = _references(spark, d).select("slug", F.posexplode("contributions").alias("pos", "c"))
    return got.select("slug", "pos", F.col("c.slug").alias("target"), F.col("c.title").alias("title"), F.array_join("c.authors", " | ").alias("names"))


def carried_names(spark: SparkSession, d: str) -> DataFrame:
    """The same over rows: each link with the names that come last before it."""
    refs = table(spark, d, "contribution_refs").select("from_slug", "ref_id").distinct()
    names = refs.where("ref_id % 3 <> 0").select("from_slug", (F.col("ref_id") * 2).alias("pos"), F.array(F.concat(F.lit("A"), F.col("ref_id").cast("string"))).alias("names"), F.lit(None).cast("string").alias("href"))
    links = refs.select("from_slug", (F.col("ref_id") * 2 + 1).alias("pos"), F.lit(None).cast("array<string>").alias("names"), F.col("ref_id").cast("string").alias("href"))
    return ex.carried_names(names.unionByName(links), "from_slug", "pos").where("href is not null").select("from_slug", "href", F.array_join("taken", " | ").alias("taken"))


def unit_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries of unit pages in order, those with a page of their own filled from it."""
    pages = table(spark, d, "unit_pages").select(F.col("page_id").cast("string").alias("stem"))
    n = F.col("stem")
    html = _html(
        "<h1>U", n, "</h1><div class='ce-bodytext'><p>Dr. A. B.</p><p>About ", n, ".</p></div><h2 class='bb-section--title'>Umbrella</h2><div class='ce-bodytext'><p>Under ", n, ".</p></div><div class='ce-bodytext'><p>Not its own.</p></div>",
        "<h2 class='bb-entry--title'><a href='/p/", n, "'>One</a></h2><h2 class='bb-entry--title'><a href='/p/", n, "'>One again</a></h2><h2 class='bb-entry--title'>No link</h2><h2 class='bb-entry--title'><a href='https://x.example/'>Two</a></h2>",
    )
    units = ex.unit_pages(pages.select("stem", html.alias("html")))
    bodies = pages.select(F.concat(F.lit("/p/"), n).alias("url"), F.array(F.concat(F.lit("Body "), n), F.lit("More")).alias("paragraphs"))
    return ex.fill_entries(units, bodies).select("stem", "pos", "title", "url", "inline", F.array_join("paragraphs", " | ").alias("text"))


def imprint_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a block that separates them by breaks."""
    p = pubs(spark, d, "publisher", "series", "pages")
    html = F.concat(F.lit("<b>"), F.coalesce("publisher", F.lit("")), F.lit("</b><br/> <i>"), F.coalesce("series", F.lit("")), F.lit("</i> <BR>"), F.coalesce("pages", F.lit("")))
    return p.select("slug", F.array_join(block_lines(html), " | ").alias("lines"))


# Files: what the sinks write, the sources read


def register_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The register written as one payload and as lines, read as a cache again, and put beside each other."""
    p = pubs(spark, d, "url", "title", "authors", "year", "doi")
    full = p.select(*[(F.col(f.name) if f.name in p.columns else F.lit("f") if f.name == "fingerprint" else F.lit(None)).cast(f.dataType).alias(f.name) for f in readers.PUBLICATION.fields])
    one, many = _folder(spark, "payload"), _folder(spark, "lines")
    sinks.write_payload(full, one, ["slug"], source=SITE, document_types=TYPES)
    sinks.write_json(full, many, ["slug"], single=False)
    a, b = (readers.read_cache(spark, x).select("slug", "title", F.array_join("authors", "|").alias("names"), "year", "doi") for x in (one, many))
    return a.join(b.select("slug", F.struct("title", "names", "year", "doi").alias("b")), "slug").select("slug", "title", "names", "year", "doi", F.struct("title", "names", "year", "doi").eqNullSafe(F.col("b")).alias("alike"))


def rejected_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of a payload that a cache would not reuse, with the reason."""
    path = _folder(spark, "payload")
    found = {"publications": [{"slug": "a", "url": "u"}, {"slug": "b", "title": "no url"}, {"url": "u"}, {"slug": " ", "url": "u"}, None]}
    spark.createDataFrame([(json.dumps(found, indent=1),)], "value string").write.text(path)
    return readers.rejected(readers.read_register(spark, path, require=True))


def dataset_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The slim records written as the shipped dataset and loaded from it."""
    path = _folder(spark, "dataset")
    sinks.write_dataset(rec(spark, d), path)
    return readers.read_dataset(spark, path).withColumn("authors", F.array_join("authors", "|"))


def words_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent sources' names written as a word file, a missing file beside it tolerated."""
    counts = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("key")).agg(F.count("*").alias("count"))
    folder = _folder(spark, "words")
    sinks.write_words(ag.rank(counts, 100).select(F.col("key").alias("text"), F.col("count").alias("size"), "rank"), f"{folder}/all_word_frequencies.json")
    missing, there = readers.whichever(lambda: readers.WordFiles(spark, folder).get("none"), lambda: readers.WordFiles(spark, folder).get("all"))
    return there.select("text", "size", F.lit(missing is None).alias("other_is_missing"))


def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Unit texts and their manifest written, and the member texts read by the manifest."""
    pages = table(spark, d, "unit_pages")
    body = F.filter(F.transform("paragraphs", clean_text), lambda p: p.isNotNull() & (p != ""))
    none = F.array().cast("array<struct<title:string,url:string,inline:boolean,paragraphs:array<string>>>")
    units = pages.where("unit is not null and unit <> ''").groupBy("unit").agg(F.min_by(F.struct("title", "url", body.alias("abstract")), "page_id").alias("u"))
    units = units.select(F.md5("unit").alias("stem"), F.col("unit").alias("title"), F.col("u.url").alias("url"), F.col("u.abstract").alias("abstract"), none.alias("entries"))
    folder = _folder(spark, "units")
    sinks.write_manifest(units, f"{folder}/units", source=SITE)
    back = readers.read_manifest(spark, f"{folder}/units")
    texts = units.select("stem", sinks.unit_document(F.col("title"), F.col("abstract"), F.col("entries")).alias("text"))
    return readers.member_texts(texts, back.where(F.length("label") % 2 == 0)).join(back.select("stem", "label"), "stem").select("label", F.md5("text").alias("text"))


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Unit texts as files, read back by their names, one of them left out."""
    folder = _folder(spark, "texts")
    names = [(f"Unit {k}", f"Text {k}\n\nMore.\n") for k in range(4)]
    for stem, text in names:
        crawl.put_text(f"{folder}/{stem}.txt", text)
    return readers.read_texts(spark, folder, ("Unit 2",))


def alias_file(spark: SparkSession, d: str) -> DataFrame:
    """The curated aliases of a file; keys with "_" are notes."""
    folder = _folder(spark, "aliases")
    crawl.put_text(f"{folder}/aliases.json", json.dumps({"_readme": ["x"], "authors": {"_why": "n", "A, B": "C, D"}, "series": {}, "journals": {"J": "Journal"}}))
    return readers.read_aliases(spark, f"{folder}/aliases.json")


def landed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages read through the cache of landed ones; the one that isn't there and can't be fetched has an error."""
    folder, urls = _folder(spark, "cache"), [f"https://{h}.invalid/p/{k}?x={k}" for h in ("a", "b") for k in range(3)]
    for u in urls[:-1]:
        crawl.Landed(folder).put(u, f"<p>{u}</p>")
    pages = crawl.fetch_pages(spark, urls, cache=folder, delay=0, attempts=1, timeout=1)
    return pages.select("url", "html", "from_cache", F.col("error").isNotNull().alias("failed"))


# Names, rankings, paging


def author_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Publications per author after the curated aliases of authors."""
    top = [("authors", "Losülonur, Esra", "Renamed, Esra"), ("authors", "Hadanuyek, Emre", "Gusovuzun, Henrike"), ("authors", "_note", "x")]
    aliases = rs.alias_table(spark.createDataFrame(top, "section string, variant string, target string"), "authors")
    names = rec(spark, d).select("slug", F.posexplode("authors").alias("pos", "name"))
    return rs.name_keys(rs.read_names(names, aliases=aliases), ["slug", "pos"])


def last_list_page(spark: SparkSession, d: str) -> DataFrame:
    """The page far beyond the end is the last one; with its label."""
    seen = cut(select(rec(spark, d), WIDE).select("slug", "title", "year"), "seen")
    total = seen.count()
    label = fmt.range_label(F.lit(-(-total // 20)), 20, F.lit(total))
    return ag.page(seen, 10**6, 20, ag.sorted_list(seen), total).select("slug", "year", label.alias("label"))


def same_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Do two rankings list the same keys? A ranking and itself, and the rankings of all and of some records."""
    a, b = (cut(ag.rank(ag.count_types(x)), "ranking") for x in (rec(spark, d), rec(spark, d).where("type is not null")))
    return ag.same_keys(a, a).select(F.lit("itself").alias("of"), "same").unionByName(ag.same_keys(a, b).select(F.lit("typed").alias("of"), "same"))


def locale_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 20 commonest publishers, ties in the order of a reader's language."""
    return ag.rank(ag.count_values(rec(spark, d), "publisher"), 20, collation="UNICODE")


def locale_list(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 records of the list, titles in the order of a reader's language."""
    records = rec(spark, d, "title", "year")
    return ag.page(records, 1, 50, ag.sorted_list(records, "UNICODE"))


def sorted_slugs(spark: SparkSession, d: str) -> DataFrame:
    """The order in which a dataset is written, told by each slug's neighbour; within ranges of first letters."""
    r = rec(spark, d).select("slug")
    return r.withColumn("next", F.lead("slug").over(W.partitionBy(F.left("slug", F.lit(3))).orderBy("slug")))


# Filter states, labels and parameters


def _states() -> list[tuple[str, Filters]]:
    f = Filters()
    a = f.toggle("type", "Monograph").toggle("author", "A").toggle("venue", "journal:J: x").set_search(" text ")
    return [
        ("none", f), ("some", a), ("untoggled", a.toggle("type", "Monograph")), ("all on", a.toggle_many("type", {"Monograph", "Series"})), ("all off", a.toggle_many("type", {"Monograph"})),
        ("years turned", a.set_years((2001, 1999))), ("years open", a.set_years((None, 2001), (1990, 2010))), ("whole span", a.set_years((1990, 2010), (1990, 2010))), ("one year", f.toggle_year(2000)), ("same year", f.toggle_year(2000).toggle_year(2000)),
        ("accepted author", a.accept("author", "B")), ("accepted venue", a.accept("publisher", "P")), ("removed one", a.remove("author", "A")), ("removed search", a.remove("search")), ("cleared", a.clear()),
    ]


def filter_states(spark: SparkSession, d: str) -> DataFrame:
    """Each state after a transition: is it empty, how many filters are active, and their listing."""
    rows = [(name, f.is_empty(), f.count_active(), " | ".join(f"{k}={v}" for k, v in f.listing())) for name, f in _states()]
    return spark.createDataFrame(rows, "state string, is_empty boolean, active int, listing string")


def legend_choice(spark: SparkSession, d: str) -> DataFrame:
    """The series shown as chosen for several filters; the folded rest only if all of it is."""
    order, folded = ["Monograph", "Working paper"], ["Series", "Thematic issue"]
    chosen = {"one": {"Monograph"}, "part": {"Monograph", "Series"}, "rest": {"Series", "Thematic issue"}, "none": set()}
    rows = [(k, " | ".join(sorted(Filters(type=frozenset(v)).legend(order, folded, "__other__")))) for k, v in chosen.items()]
    return spark.createDataFrame(rows, "chosen string, legend string")


def parameters(spark: SparkSession, d: str) -> DataFrame:
    """Counts and units from requests: clamped, defaulted, known ones only."""
    asked = spark.createDataFrame([("5", "a"), ("500", "b"), ("x", "zz"), (None, None), ("42", "all"), ("9a", "A"), ("-3", "")], "count string, unit string")
    return asked.select("count", "unit", readers.count_parameter(F.col("count")).alias("n"), readers.unit_parameter(F.col("unit"), readers.known_units(["b", "a"], ["a", "b"]), "all").alias("known"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Types in the reader's language, in a sentence with figures."""
    counts = ag.count_types(rec(spark, d))
    german = {"Monograph": "Monografie", "Article in journal": "Zeitschriftenartikel", "": "ohne Typ"}
    shown = fmt.translated(F.col("key"), german if fmt.locale_of("de-AT", ("en", "de")) == "de" else {})
    return counts.select("key", fmt.filled("{label}: {n} Titel", label=shown, n=fmt.grouped(F.col("count"), "de")).alias("text"))


def word_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a text by the word tokenizer and a dictionary of lemmas."""
    texts = spark.createDataFrame([("u", "The children's well-known houses were built; houses, mice and men!"), ("u", "Running runs ran. 1999 a b2b")], "unit string, text string")
    lemmas = spark.createDataFrame([("houses", "house", "house"), ("mice", "mouse", None), ("men", "man", "man"), ("built", "built", "build"), ("running", "running", "run"), ("runs", "run", "run"), ("ran", None, "run")], "token string, noun string, verb string")
    return wd.terms(texts, "unit", "text", lemmas=lemmas).groupBy("term").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        refresh_run, crawl_pages, type_options, detail_references, detail_contributions, carried_names, unit_entries, imprint_lines,
        register_roundtrip, rejected_records, dataset_roundtrip, words_roundtrip, manifest_roundtrip, text_files, alias_file, landed_pages,
        author_aliases, last_list_page, same_rankings, locale_rank, locale_list, sorted_slugs, filter_states, legend_choice, parameters, labels, word_terms,
    )
}


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


def _line(c: str) -> str:
    return _clean(f"regexp_replace(coalesce({c}, ''), '<[^>]*>', ' ', 'g')")


_NAMES = rf"coalesce(array_to_string(list_filter(list_transform(coalesce(authors, []), lambda x: {_strip('x')}), lambda x: x <> ''), '; '), '')"
_PRINT = f"concat({_clean('coalesce(title, chr(32))')}, ' | ', {_clean(_NAMES)}, ' | ', {_clean('coalesce(publisher, chr(32))')}, ' | ', {_clean('coalesce(journal, chr(32))')})"
_FIRST = "old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY harvested_at, ingested_at) AS rn FROM publications WHERE slug IS NOT NULL) WHERE rn = 1)"
_TYPES = f"t(label) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in TYPES)})"
_SHOWN = _key("trim(" + _strip("surname || ', ' || given") + ", ',')")
_RENAMED = {"Losülonur, Esra": ("Renamed", "Esra"), "Hadanuyek, Emre": ("Gusovuzun", "Henrike")}
_CASES = [" ".join(f"WHEN k = {_key(chr(39) + a + chr(39))} THEN '{t[i]}'" for a, t in _RENAMED.items()) for i in (0, 1)]
_ALIASED = _READ.replace("FROM parts)", f"FROM (SELECT slug, pos, CASE {_CASES[0]} ELSE surname END AS surname, CASE {_CASES[1]} ELSE given END AS given FROM (SELECT *, {_SHOWN} AS k FROM parts)))")
_PARTS = "SELECT DISTINCT from_slug, ref_id FROM contribution_refs"

ORACLES: dict[str, str] = {
    "refresh_run": f"""WITH {_LAST}, {_FIRST}, {_TYPES}, x AS (SELECT last.slug, {_PRINT.replace('title', 'last.title').replace('(authors', '(last.authors').replace('(publisher', '(last.publisher').replace('(journal', '(last.journal')} AS now,
          {_PRINT.replace('title', 'old.title').replace('(authors', '(old.authors').replace('(publisher', '(old.publisher').replace('(journal', '(old.journal')} AS before,
          {_clean("coalesce(last.title, ' ')")} AS title, last.document_type AS type, old.document_type AS old_type,
          array_to_string(list_filter(list_transform(string_split({_NAMES.replace('(authors', '(last.authors')}, ';'), lambda x: {_clean('x')}), lambda x: x <> ''), '; ') AS names FROM last JOIN old USING (slug))
        SELECT slug, CASE WHEN now = before THEN 'cached' ELSE title END AS title, CASE WHEN now = before THEN old_type WHEN type IN (SELECT label FROM t) THEN type END AS document_type, now AS fingerprint, CASE WHEN now <> before THEN coalesce(names, '') END AS names FROM x""",
    "type_options": _values([(k + 20, t) for k, t in enumerate(TYPES)], "type_id, label"),
    "detail_references": f"""WITH v AS (SELECT from_slug, min(ref_id) AS v FROM volume_refs GROUP BY 1), c AS (SELECT from_slug, min(ref_id) AS c FROM contribution_refs GROUP BY 1), x AS (SELECT coalesce(v.from_slug, c.from_slug) AS slug, v, c FROM v FULL JOIN c USING (from_slug))
        SELECT slug, 'v' || v AS target, 'V' || v AS title, 'sub ' || v AS subtitle, 'E' || v || ', F | G, H' AS names, CASE WHEN v IS NOT NULL THEN 'Ed.' END AS role, CASE WHEN coalesce(v, c) % 2 <> 0 THEN 'Text.' END AS abstract, CASE WHEN coalesce(v, c) % 2 = 0 THEN 'Text.' END AS note FROM x""",
    "detail_contributions": f"SELECT from_slug AS slug, (row_number() OVER (PARTITION BY from_slug ORDER BY ref_id) - 1)::INT AS pos, 'c' || ref_id AS target, 'T' || ref_id AS title, CASE WHEN ref_id % 3 = 0 THEN '' ELSE 'A' || ref_id || ', X | B, Y' END AS names FROM ({_PARTS})",
    "carried_names": f"SELECT from_slug, ref_id::VARCHAR AS href, CASE WHEN ref_id % 3 <> 0 THEN 'A' || ref_id END AS taken FROM ({_PARTS})",
    "unit_entries": """SELECT page_id::VARCHAR AS stem, v.pos, v.title, v.url, v.inline, v.text FROM unit_pages, LATERAL (VALUES (0, 'Umbrella', NULL, true, 'Under ' || page_id || '.'), (1, 'One', '/p/' || page_id, false, 'Body ' || page_id || ' | More'), (2, 'Two', 'https://x.example/', false, '')) v(pos, title, url, inline, text)""",
    "imprint_lines": f"WITH {_LAST} SELECT slug, array_to_string(list_filter([{', '.join(_line(c) for c in ('publisher', 'series', 'pages'))}], lambda x: x <> ''), ' | ') AS lines FROM last",
    "register_roundtrip": f"WITH {_LAST} SELECT slug, nullif(title, '') AS title, array_to_string(nullif(authors, []), '|') AS names, year, nullif(doi, '') AS doi, true AS alike FROM last WHERE {_strip('slug')} <> '' AND {_strip('url')} <> ''",
    "rejected_records": _values([(1, "b", "url is missing"), (2, None, "slug is missing"), (3, " ", "slug is missing")], "position, slug, reason"),
    "dataset_roundtrip": f"WITH {_REC} SELECT * REPLACE (coalesce(array_to_string(authors, '|'), '') AS authors) FROM (SELECT slug, url, title, subtitle, authors, type, year, journal, publisher, series, doi FROM rec)",
    "words_roundtrip": "SELECT coalesce(source, 'none') AS text, count(*) AS size, true AS other_is_missing FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "text_files": _values([(f"Unit {k}", f"Text {k}\n\nMore.\n") for k in (0, 1, 3)], "stem, text"),
    "alias_file": _values([("authors", "A, B", "C, D"), ("journals", "J", "Journal")], "section, variant, target"),
    "landed_pages": _values([(f"https://{h}.invalid/p/{k}?x={k}", None if (h, k) == ("b", 2) else f"<p>https://{h}.invalid/p/{k}?x={k}</p>", (h, k) != ("b", 2), (h, k) == ("b", 2)) for h in ("a", "b") for k in range(3)], "url, html, from_cache, failed"),
    "last_list_page": f"""WITH {_REC}, seen AS (SELECT slug, title, year FROM rec WHERE {_where(WIDE)}), n AS (SELECT count(*) AS n, greatest((count(*) - 1) // 20, 0) * 20 AS o FROM seen),
        r AS (SELECT *, row_number() OVER (ORDER BY coalesce(year, 0) DESC, coalesce(title, ''), slug) AS rn FROM seen) SELECT slug, year, (o + 1) || '–' || n || ' of ' || n AS label FROM r, n WHERE rn > o""",
    "same_rankings": f"WITH {_REC} SELECT 'itself' AS of, true AS same UNION ALL SELECT 'typed', count(*) FILTER (type IS NULL) = 0 FROM rec",
    "sorted_slugs": f"WITH {_LAST} SELECT slug, lead(slug) OVER (PARTITION BY left(slug, 3) ORDER BY slug) AS next FROM last",
    "filter_states": _values(
        [
            ("none", True, 0, ""), ("some", False, 4, "type=Monograph | author=A | venue=journal:J: x | search=text"), ("untoggled", False, 3, "author=A | venue=journal:J: x | search=text"),
            ("all on", False, 5, "type=Monograph | type=Series | author=A | venue=journal:J: x | search=text"), ("all off", False, 3, "author=A | venue=journal:J: x | search=text"),
            ("years turned", False, 5, "type=Monograph | author=A | venue=journal:J: x | years=1999–2001 | search=text"), ("years open", False, 5, "type=Monograph | author=A | venue=journal:J: x | years=1990–2001 | search=text"),
            ("whole span", False, 4, "type=Monograph | author=A | venue=journal:J: x | search=text"), ("one year", False, 1, "years=2000"), ("same year", True, 0, ""),
            ("accepted author", False, 4, "type=Monograph | author=A | author=B | venue=journal:J: x"), ("accepted venue", False, 4, "type=Monograph | author=A | venue=journal:J: x | venue=publisher:P"),
            ("removed one", False, 3, "type=Monograph | venue=journal:J: x | search=text"), ("removed search", False, 3, "type=Monograph | author=A | venue=journal:J: x"), ("cleared", True, 0, ""),
        ],
        "state, is_empty, active, listing",
    ),
    "legend_choice": _values([("one", "Monograph"), ("part", "Monograph"), ("rest", "__other__"), ("none", "")], "chosen, legend"),
    "parameters": _values([("5", "a", 10, "a"), ("500", "b", 100, "b"), ("x", "zz", 75, "all"), (None, None, 75, "all"), ("42", "all", 42, "all"), ("9a", "A", 10, "all"), ("-3", "", 10, "all")], '"count", unit, n, known'),
    "labels": f"""WITH {_REC} SELECT coalesce(type, '') AS key, (CASE coalesce(type, '') WHEN 'Monograph' THEN 'Monografie' WHEN 'Article in journal' THEN 'Zeitschriftenartikel' WHEN '' THEN 'ohne Typ' ELSE type END) || ': ' || replace(format('{{:,}}', count(*)), ',', '.') || ' Titel' AS text FROM rec GROUP BY type""",
    "word_terms": _values([("house", 2), ("mouse", 1), ("man", 1), ("build", 1), ("run", 3)], "term, n"),
    "locale_rank": f"""WITH {_REC}, c AS (SELECT publisher AS key, count(*) AS count FROM rec WHERE publisher IS NOT NULL GROUP BY 1) SELECT key, count, row_number() OVER (ORDER BY count DESC, icu_sort_key(key, 'und'), key) AS rank FROM c QUALIFY rank <= 20""",
    "locale_list": f"WITH {_REC} SELECT slug, title, year FROM rec ORDER BY coalesce(year, 0) DESC, icu_sort_key(coalesce(title, ''), 'und'), slug LIMIT 50",
    "author_aliases": f"WITH {_REC}, {_ALIASED} SELECT * FROM keys",
    "manifest_roundtrip": f"""WITH u AS (SELECT unit AS label, arg_min(paragraphs, page_id) AS p FROM (SELECT * REPLACE (coalesce(paragraphs, []) AS paragraphs) FROM unit_pages) WHERE unit <> '' GROUP BY unit)
        SELECT label, md5(array_to_string(list_concat([label], list_filter(list_transform(p, lambda x: {_clean('x')}), lambda x: x <> '')), chr(10) || chr(10)) || chr(10)) AS text FROM u WHERE length(label) % 2 = 0""",
    "crawl_pages": f"""WITH {_LAST}, n AS (SELECT greatest(1, least({pl.MAX_PAGES // 2}, (count(*) + {ENTRIES - 1}) // {ENTRIES})) AS n FROM last), e AS (SELECT slug, ('0x' || left(md5(slug), 7))::INT % n + 1 AS page FROM last, n)
        SELECT slug, page FROM e ORDER BY page, slug LIMIT 100""",
}
