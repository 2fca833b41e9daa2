"""Figures and labels as the views show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_word(c: Column) -> Column:
    """A word without stray quote characters and outer spaces."""
    return F.trim(F.translate(c, "'’‘", ""))


def title_label(title: Column, subtitle: Column, slug: Column) -> Column:
    """ "Title: Subtitle", or the slug where both are missing."""
    return F.coalesce(F.nullif(F.concat_ws(": ", F.nullif(title, F.lit("")), F.nullif(subtitle, F.lit(""))), F.lit("")), slug)


def venue_label(journal: Column, publisher: Column, series: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (journal, publisher, series)])


def doi_link(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit("")))


def grouped(c: Column, locale: str = "en") -> Column:
    """An integer with its thousands grouped: commas in English, points in German."""
    text = F.format_number(c, 0)
    return F.translate(text, ",", ".") if locale == "de" else text


def figure(c: Column, fallback: Column, locale: str = "en") -> Column:
    """The formatted number, or what was there before."""
    return F.coalesce(grouped(c, locale), fallback)


def extent_label(low: Column, high: Column) -> Column:
    """ "a–b", or "a" where both are the same."""
    return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))


def range_label(page: Column, size: int, total: Column) -> Column:
    """ "from–to of total" for a page counted from 1."""
    first = F.least((page - 1) * size + 1, total)
    return F.concat(first.cast("string"), F.lit("–"), F.least(page * size, total).cast("string"), F.lit(" of "), total.cast("string"))


def translated(key: Column, labels: dict[str, str]) -> Column:
    """A key's label; unknown keys fall through."""
    if not labels:
        return key
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def font_size(size: Column, largest: Column, n: Column, area: float, scale: float = 1.5, least: float = 10.0, most: float | None = None) -> Column:
    """Pixels in proportion to the frequency, from the area that a word has on average, clamped."""
    base = F.sqrt(F.lit(float(area)) / (F.greatest(n, F.lit(1)) * scale)) * (F.greatest(size, F.lit(0)) / F.coalesce(F.nullif(largest, F.lit(0)), F.lit(1)))
    clamped = F.greatest(base, F.lit(least))
    return F.least(clamped, F.lit(most)) if most is not None else clamped


def preview_size(size: Column, low: Column, high: Column) -> Column:
    """Preview pixels 13 to 34 in proportion to the span; 22 where all are equal. Halves are rounded up."""
    return F.when(high == low, F.lit(22)).otherwise(13 + F.floor((size - low) / (high - low) * 21 + 0.5)).cast("int")


def node_radius(count: Column, largest: Column) -> Column:
    return 4 + 14 * F.sqrt(count / largest)


def edge_width(weight: Column) -> Column:
    return F.least(1 + weight, F.lit(6))


def edge_distance(weight: Column) -> Column:
    return 60 / F.sqrt(weight)


def sparkline_height(count: Column, peak: Column) -> Column:
    return F.greatest(count / peak * 100, F.lit(1.5))


def tick_step(years: Column) -> Column:
    """Years between labelled ticks, by the length of the span."""
    return F.when(years > 40, F.lit(10)).when(years > 15, F.lit(5)).otherwise(F.lit(1))


def palette_slot(rank: Column, n: Column, slots: int) -> Column:
    """The palette's slot for a rank from 1, spread over the ranking."""
    return F.least(F.floor((rank - 1) / F.greatest(n, F.lit(1)) * slots), F.lit(slots - 1)).cast("int")


def rotation(text: Column, rank: Column | None = None, sixteenths: int = 4, upright: int = 12) -> Column:
    """0 or 90 degrees, by chance but the same for a word on every run: a share of the texts is turned, by their digest.

    The leading ranks stay upright.
    """
    turned = F.when(F.conv(F.left(F.md5(text), F.lit(1)), 16, 10).cast("int") < sixteenths, F.lit(90)).otherwise(F.lit(0))
    return F.when(rank <= upright, F.lit(0)).otherwise(turned) if rank is not None else turned


def locale_of(asked: str | None, known: tuple[str, ...], default: str = "en") -> str:
    """The known locale that a request asks for, by its language alone; else the default."""
    language = (asked or "").replace("_", "-").split("-")[0].lower()
    return language if language in known else default


def filled(template: str, **values: Column) -> Column:
    """A template with its {names} filled in; a null value is shown as nothing, an unknown name stays."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
