"""The filter state of a view, its transitions, and its predicates as columns.

A view that shows a dimension's own choices is computed under every filter but that one: ``predicate(except_=...)``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubscope.functions.text import fold_search, fold_search_py

DIMENSIONS = ("type", "author", "venue", "years", "search")
VENUE_FIELDS = ("journal", "publisher")


def venue_key(field: str, value: str) -> str:
    return f"{field}:{value}"


def parse_venue_key(key: str) -> tuple[str, str]:
    """Field and value of a tagged key; the value may hold colons."""
    field, _, value = key.partition(":")
    return field, value


def haystack(with_type: bool = True) -> Column:
    """The folded text of a slim record that a search looks at; missing fields are skipped."""
    parts = ["title", "subtitle", F.nullif(F.array_join("authors", " "), F.lit("")), "journal", "publisher", "series"]
    parts += [F.col("type"), F.col("year").cast("string")] if with_type else []
    return fold_search(F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) if isinstance(p, str) else p for p in parts]))


@dataclass(frozen=True)
class Filters:
    """Chosen types, authors and venues, a year range, and a search text. '' among the types stands for untyped."""

    type: frozenset[str] = frozenset()
    author: frozenset[str] = frozenset()
    venue: frozenset[str] = frozenset()
    years: tuple[int, int] | None = None
    search: str = ""

    # state

    def is_empty(self) -> bool:
        return not (self.type or self.author or self.venue or self.years or self.search.strip())

    def count_active(self) -> int:
        return len(self.type) + len(self.author) + len(self.venue) + bool(self.years) + bool(self.search.strip())

    def toggle(self, dimension: str, value: str) -> Filters:
        return replace(self, **{dimension: getattr(self, dimension) ^ {value}})

    def toggle_many(self, dimension: str, values: set[str] | frozenset[str]) -> Filters:
        """All of the values off if all are chosen, else all on."""
        chosen = getattr(self, dimension)
        return replace(self, **{dimension: chosen - values if values <= chosen else chosen | values})

    def set_search(self, text: str) -> Filters:
        return replace(self, search=text)

    def set_years(self, years: tuple[int | None, int | None] | None, extent: tuple[int, int] | None = None) -> Filters:
        """A year range with its bounds in order; open bounds reach to the extent, and the whole extent is no filter."""
        if years is None or (years[0] is None and years[1] is None):
            return replace(self, years=None)
        low, high = (b if b is not None else (extent or years)[i] for i, b in enumerate(years))
        low, high = (b if b is not None else low if low is not None else high for b in (low, high))
        bounds = (min(low, high), max(low, high))
        return replace(self, years=None if extent and bounds[0] <= extent[0] and bounds[1] >= extent[1] else bounds)

    def toggle_year(self, year: int) -> Filters:
        return replace(self, years=None if self.years == (year, year) else (year, year))

    def accept(self, kind: str, value: str) -> Filters:
        """A suggestion becomes a filter, and the text typed for it goes."""
        chosen = self.toggle("author", value) if kind == "author" else self.toggle("venue", venue_key(kind, value))
        return replace(chosen, search="")

    def clear(self) -> Filters:
        return Filters()

    def remove(self, dimension: str, value: str | None = None) -> Filters:
        """Without one chosen value, or without a dimension's filter."""
        if value is not None:
            return replace(self, **{dimension: getattr(self, dimension) - {value}})
        return replace(self, **{dimension: getattr(Filters(), dimension)})

    def listing(self) -> list[tuple[str, str]]:
        """One labelled entry for each choice."""
        out = [(d, v) for d in ("type", "author", "venue") for v in sorted(getattr(self, d))]
        if self.years:
            out.append(("years", str(self.years[0]) if self.years[0] == self.years[1] else f"{self.years[0]}–{self.years[1]}"))
        return out + ([("search", self.search.strip())] if self.search.strip() else [])

    def venues_of(self, field: str) -> list[str]:
        """The chosen values of one venue field, without their tag."""
        return sorted(v for f, v in map(parse_venue_key, self.venue) if f == field)

    def legend(self, order: list[str], folded: list[str], other: str) -> set[str]:
        """The series shown as chosen; the bucket of folded ones only if all of them are."""
        return {k for k in order if k in self.type} | ({other} if folded and set(folded) <= self.type else set())

    # predicates; each is true or false, never null

    def _on(self, dimension: str) -> Column | None:
        if dimension == "type" and self.type:
            return F.coalesce(F.col("type"), F.lit("")).isin(*sorted(self.type))
        if dimension == "author" and self.author:
            return F.coalesce(F.arrays_overlap("authors", F.array(*[F.lit(a) for a in sorted(self.author)])), F.lit(False))
        if dimension == "venue" and self.venue:
            tests = [F.coalesce(F.col(f).isin(*self.venues_of(f)), F.lit(False)) for f in VENUE_FIELDS if self.venues_of(f)]
            return reduce(Column.__or__, tests) if tests else F.lit(False)
        if dimension == "years" and self.years:
            return F.coalesce((F.col("year") != 0) & F.col("year").between(*self.years), F.lit(False))
        needle = fold_search_py(self.search.strip()) if dimension == "search" else ""
        return F.contains(F.col("haystack"), F.lit(needle)) if needle else None

    def needs_haystack(self, except_: str | None = None) -> bool:
        return except_ != "search" and bool(fold_search_py(self.search.strip()))

    def predicate(self, except_: str | None = None) -> Column:
        """All filters but one dimension's, cheap ones first."""
        tests = [t for d in ("years", "type", "venue", "author", "search") if d != except_ and (t := self._on(d)) is not None]
        return reduce(Column.__and__, tests) if tests else F.lit(True)

    def flags(self) -> dict[str, Column]:
        """Each dimension's own test, for several views from one scan."""
        return {d: t if (t := self._on(d)) is not None else F.lit(True) for d in DIMENSIONS}


def select(records: DataFrame, filters: Filters, except_: str | None = None) -> DataFrame:
    """The records under all filters but one dimension's. The haystack is built only if a search needs it."""
    if filters.needs_haystack(except_) and "haystack" not in records.columns:
        records = records.withColumn("haystack", haystack())
    return records.where(filters.predicate(except_))
