"""Reading the lines of a publication's page: imprint, periodical, identifiers, pages, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubscope.functions.text import clean_text, strip_blank

# Formats of the register's lines.
DATE = r"^(\d{2})/(\d{2})/(\d{4})$"
YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
ISSN = r"^\d{4}-?\d{3}[\dXx]$"
NUMBERED = r"^[\d/–—-]+$"
PAGES = r"(?i)^(p\.|pp\.|\d+\s*p\.)"
DOI_HOST = r"^https?://(dx\.)?doi\.org/"


def _pieces(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), ","), strip_blank), lambda p: p != "")


def block_lines(html: Column) -> Column:
    """The lines of a block that separates them by <br>: tags dropped, blank ones gone."""
    plain = lambda p: clean_text(F.regexp_replace(p, r"<[^>]*>", " "))
    return F.filter(F.transform(F.split(html, r"(?i)<br\s*/?>"), plain), lambda p: p != "")


def parse_publisher(lines: Column) -> Column:
    """struct(date, year, publisher, places, series) of an imprint block.

    The first line ends in a date (dd/mm/yyyy), a year or neither; what is before is publisher and places. A later
    line that starts with "serie" names the series; the last such line counts.
    """
    parts = _pieces(F.get(lines, F.lit(0)))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    dated, bare = last.rlike(DATE), last.rlike(r"^\d{4}$")
    rest = F.when(dated | bare, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    iso = F.concat_ws("-", F.regexp_extract(last, DATE, 3), F.regexp_extract(last, DATE, 2), F.regexp_extract(last, DATE, 1))
    year = F.when(dated, F.regexp_extract(last, DATE, 3)).when(bare, last).cast("int")
    series = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda x: F.lower(x).startswith("serie"))
    name = F.try_element_at(series, F.lit(-1))
    return F.struct(
        F.when(dated, iso).alias("date"), year.alias("year"), F.get(rest, F.lit(0)).alias("publisher"),
        F.slice(rest, F.lit(2), F.greatest(F.size(rest), F.lit(1))).alias("places"), F.nullif(strip_blank(F.regexp_replace(name, "^[^:]*:", "")), F.lit("")).alias("series"),
    )


def parse_periodical(line: Column) -> Column:
    """struct(journal, volume, issue): trailing numbered pieces are peeled off, the first two of them are volume and issue."""
    parts = _pieces(line)
    n = F.size(parts)
    # pieces from i on are all numbered; the first piece always belongs to the name
    tails = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i < n) & F.forall(F.slice(parts, i + 1, F.greatest(n - i, F.lit(0))), lambda p: p.rlike(NUMBERED)))
    cut = F.coalesce(F.get(tails, F.lit(0)), n)
    journal = F.array_join(F.slice(parts, F.lit(1), cut), ", ")
    return F.struct(F.nullif(journal, F.lit("")).alias("journal"), F.get(parts, cut).alias("volume"), F.get(parts, cut + 1).alias("issue"))


def parse_identifiers(lines: Column) -> Column:
    """struct(isbn, issn, doi): an eight-digit "ISBN" is an ISSN; the resolver's host is no part of a DOI."""
    of = lambda prefix: F.try_element_at(F.filter(lines, lambda x: F.lower(x).startswith(prefix)), F.lit(-1))
    value = F.element_at(F.split(of("isbn"), r"(?U)\s+", 2), -1)
    doi = F.regexp_replace(strip_blank(F.regexp_replace(of("doi"), "^[^:]*:", "")), DOI_HOST, "")
    return F.struct(F.when(~value.rlike(ISSN), value).alias("isbn"), F.when(value.rlike(ISSN), value).alias("issn"), doi.alias("doi"))


def pages_line(paragraphs: Column) -> Column:
    """The first paragraph that tells pages."""
    return F.get(F.filter(paragraphs, lambda p: p.rlike(PAGES)), F.lit(0))


def year_or_guess(year: Column, *sources: Column) -> Column:
    """The year, else the first of 1800 to 2099 in the sources, in their order."""
    found = [F.expr("null").cast("int") if s is None else F.nullif(F.regexp_extract(s, YEAR, 1), F.lit("")).cast("int") for s in sources]
    return F.coalesce(F.nullif(year, F.lit(0)), *found)


def slug_of(href: Column, listing: str) -> Column:
    """The slug in a listing link, null for other links and for pages of the listing."""
    slug = F.trim(F.split_part(F.substr(href, F.lit(len(listing) + 2)), F.lit("?"), F.lit(1)))
    slug = F.regexp_replace(slug, "^/+|/+$", "")
    return F.when(href.startswith(listing + "/") & (slug != "") & ~slug.startswith("page-"), slug)


def listing_url(base: str, page: Column, parameter: str | None = None, value: Column | None = None) -> Column:
    """The address of a listing's page, with an optional encoded filter."""
    path = F.when(page > 1, F.concat(F.lit(f"{base}/page-"), page.cast("string"))).otherwise(F.lit(base))
    if parameter is None:
        return path
    return F.concat(path, F.lit("?"), F.url_encode(F.lit(parameter)), F.lit("="), F.url_encode(value.cast("string")))


def absolute_url(base: str, href: Column) -> Column:
    """Site-relative addresses with the site's base; others as they are."""
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def cache_name(url: Column, longest: int = 80) -> Column:
    """The file name under which a page is kept: path and query made safe; long ones keep a head and a digest."""
    tail = F.regexp_replace(F.regexp_replace(url, r"^[a-z][a-z0-9+.\-]*://[^/?#]*", ""), "[?]", "")
    safe = F.regexp_replace(F.regexp_replace(tail, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    name = F.when(safe == "", "index").otherwise(safe)
    return F.concat(F.when(F.length(name) > longest, F.concat(F.left(name, F.lit(longest)), F.lit("_"), F.left(F.sha1(F.encode(url, "UTF-8")), F.lit(12)))).otherwise(name), F.lit(".html"))
