"""Counts, rankings, year series and paging over slim records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_values(records: DataFrame, column: str) -> DataFrame:
    """key, count of a column, or of an array column's elements (each as often as it stands there). Null and '' don't count."""
    is_array = records.schema[column].dataType.typeName() == "array"
    keys = records.select((F.explode(column) if is_array else F.col(column)).alias("key"))
    return keys.where("key is not null and key <> ''").groupBy("key").agg(F.count("*").alias("count"))


def count_types(records: DataFrame) -> DataFrame:
    """key, count of the types; untyped records count under ''. Takes records or their ``year_type_counts``."""
    n = F.sum("n") if "n" in records.columns else F.count("*")
    return records.groupBy(F.coalesce("type", F.lit("")).alias("key")).agg(n.alias("count"))


def year_type_counts(records: DataFrame) -> DataFrame:
    """year, type, n: the small cube from which extent, types and series come, so that the records are read once."""
    return records.groupBy("year", "type").agg(F.count("*").alias("n"))


def _ranking(collation: str | None) -> list[Column]:
    tie = [F.collate("key", collation)] if collation else []
    return [F.desc("count"), *tie, F.asc("key")]


def rank(counts: DataFrame, limit: int | None = None, collation: str | None = None) -> DataFrame:
    """key, count, rank: largest first, ties by key (by code point, or by a collation and then by code point).

    With a limit this is a top-k, and the numbering runs over at most ``limit`` rows. Without one, keys are numbered in
    groups of equal count and equal first letters, and each group begins after the sum of those before it, so the long
    tail of rare keys is spread over many tasks. (A collation has no such groups and so asks for a limit.)
    """
    if limit is not None:
        return counts.orderBy(*_ranking(collation)).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*_ranking(collation))).cast("bigint"))
    if collation:
        raise ValueError("a ranking by collation needs a limit")
    inside = F.row_number().over(W.partitionBy("count", "p").orderBy("key"))
    numbered = counts.withColumn("p", F.left("key", F.lit(2))).withColumn("i", inside)
    # a group's size is its last number, so sizes and numbers come from one exchange, which is reused
    sizes = numbered.groupBy("count", "p").agg(F.max("i").cast("bigint").alias("n"))
    # one row per distinct count and pair of first letters
    begin = sizes.select("count", "p", F.coalesce(F.sum("n").over(W.orderBy(F.desc("count"), "p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    return numbered.join(begin, ["count", "p"]).select("key", "count", (F.col("begin") + F.col("i")).cast("bigint").alias("rank"))


def top_keys_with_other(counts: DataFrame, limit: int, other: str) -> DataFrame:
    """key, count, series: the key itself for the ``limit`` largest, ``other`` for the folded rest."""
    top = rank(counts, limit).select("key", F.lit(True).alias("kept"))
    return counts.join(F.broadcast(top), "key", "left").select("key", "count", F.when(F.col("kept"), F.col("key")).otherwise(F.lit(other)).alias("series"))


def year_extent(records: DataFrame) -> DataFrame:
    """One row with the first and last year; nulls if nothing is dated. Year 0 is no year."""
    return records.where("year <> 0").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def year_spine(extent: DataFrame) -> DataFrame:
    """Every year of a one-row extent."""
    return extent.where("year_min is not null").select(F.explode(F.sequence("year_min", "year_max")).alias("year"))


def per_year(records: DataFrame) -> DataFrame:
    """year, count for every year of the span, gaps as 0."""
    counts = records.where("year <> 0").groupBy("year").agg(F.count("*").alias("count"))
    return year_spine(year_extent(records)).join(counts, "year", "left").select("year", F.coalesce("count", F.lit(0)).alias("count"))


def stacked_year_series(records: DataFrame, extent: DataFrame, series: DataFrame, other: str) -> DataFrame:
    """year, total, key, count: the counts of each year split into series, for every year of the extent.

    ``series`` maps keys to series (as top_keys_with_other gives it for the whole dataset, so that colours stay); a key
    it lacks goes to ``other``. A year's total counts all its records; a year without any has one row with null key
    and 0. The records (or their ``year_type_counts``) are counted once per (year, key), before anything is joined.
    """
    n = F.sum("n") if "n" in records.columns else F.count("*")
    counts = records.where("year <> 0").groupBy("year", F.coalesce("type", F.lit("")).alias("raw")).agg(n.alias("n"))
    named = counts.join(series.select(F.col("key").alias("raw"), "series"), "raw", "left").groupBy("year", F.coalesce("series", F.lit(other)).alias("key")).agg(F.sum("n").alias("count"))
    spine = year_spine(extent)
    out = spine.join(named, "year", "left").withColumn("total", F.coalesce(F.sum("count").over(W.partitionBy("year")), F.lit(0)))
    return out.select("year", "total", "key", F.coalesce("count", F.lit(0)).alias("count"))


def with_shares(series: DataFrame) -> DataFrame:
    """A stacked series with each segment's share of its year and each year's share of the peak."""
    peak = F.max("total").over(W.partitionBy())
    return series.withColumn("share", F.col("count") / F.nullif("total", F.lit(0)) * 100).withColumn("height", F.col("total") / F.nullif(peak, F.lit(0)) * 100)


def year_ticks(extent: DataFrame, step: Column | None = None) -> DataFrame:
    """year, offset: the labelled ticks of a span: multiples of the step, and both ends. ``offset``: the column's middle in percent."""
    from pubscope.functions.format import tick_step

    span = F.col("year_max") - F.col("year_min") + 1
    years = extent.where("year_min is not null").select("year_min", "year_max", span.alias("span"), F.explode(F.sequence("year_min", "year_max")).alias("year"))
    keep = (F.col("year") % (step if step is not None else tick_step(F.col("span"))) == 0) | F.col("year").isin(F.col("year_min"), F.col("year_max"))
    return years.where(keep).select("year", ((F.col("year") - F.col("year_min") + 0.5) / F.col("span") * 100).alias("offset"))


def summary(records: DataFrame) -> DataFrame:
    """One row: publications, distinct authors, untyped, undated, first and last year."""
    dated = F.nullif(F.col("year"), F.lit(0))
    base = records.agg(F.count("*").alias("publications"), F.count_if(F.coalesce("type", F.lit("")) == "").alias("untyped"), F.count_if(dated.isNull()).alias("without_year"), F.min(dated).alias("year_min"), F.max(dated).alias("year_max"))
    names = records.select(F.explode("authors").alias("a")).agg(F.countDistinct("a").alias("authors"))
    return base.withColumn("authors", F.coalesce(names.scalar(), F.lit(0)))


def sorted_list(records: DataFrame, collation: str | None = None) -> list[Column]:
    """The order of the publication list: newest first, undated last, then title (by a collation, or by code point) and slug."""
    title = F.coalesce("title", F.lit(""))
    return [F.desc(F.coalesce("year", F.lit(0))), F.asc(F.collate(title, collation) if collation else title), F.asc("slug")]


def page(records: DataFrame, number: int, size: int, order: list[Column], total: int | None = None) -> DataFrame:
    """One page of ordered records, counted from 1; a number past the end gives the last page.

    Spark takes the first rows of every partition up to the page's end, so only deep pages sort much.
    """
    total = records.count() if total is None else total
    last = max(1, -(-total // size))
    return records.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def page_of(position: Column, size: int) -> Column:
    """The page on which a position (from 1) lies."""
    return (F.floor((position - 1) / size) + 1).cast("int")


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two rankings (key, rank) list the same keys in the same order?"""
    joined = a.select("rank", F.col("key").alias("ka")).join(b.select("rank", F.col("key").alias("kb")), "rank", "full")
    return joined.agg(F.coalesce(F.bool_and(F.col("ka").eqNullSafe(F.col("kb"))), F.lit(True)).alias("same"))


def stride_order(ranked: DataFrame, stride: int) -> DataFrame:
    """Ranked rows (rank from 1, without gaps) in the order (i * stride) % n; n and stride must have no common factor."""
    n = F.count("*").over(W.partitionBy())  # a ranking's top, so a few rows
    # slot i shows row (i * stride) % n, so a row's slot is its place times the inverse of the stride modulo n: the one
    # (1 + k * n) / stride, for a k below the stride, that is whole
    whole = F.filter(F.sequence(F.lit(0), F.lit(stride - 1)), lambda k: (1 + k * F.col("n")) % stride == 0)
    inverse = F.floor((1 + F.get(whole, F.lit(0)) * F.col("n")) / stride)
    return ranked.withColumn("n", n).withColumn("slot", ((F.col("rank") - 1) * inverse) % F.col("n")).drop("n")
