"""The co-authorship graph: who has published with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coauthor_graph(records: DataFrame, min_publications: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, count; links: source, target, weight) of records with an array ``authors``.

    An author counts once per record; only authors with a co-author are nodes, and both ends of a link have at least
    ``min_publications``. Pairs are made row by row from the record's sorted authors, so no record meets another one,
    and their counts combine before the shuffle.
    """
    authors = records.select(F.array_sort(F.array_distinct("authors")).alias("a")).where("size(a) > 0")
    published = authors.select(F.explode("a").alias("id")).groupBy("id").agg(F.count("*").alias("count"))
    first = authors.where("size(a) > 1").select("a", F.posexplode("a").alias("i", "source"))
    pairs = first.select("source", F.explode(F.slice("a", F.col("i") + 2, F.greatest(F.size("a") - F.col("i") - 1, F.lit(0)))).alias("target"))
    links = pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))
    if min_publications > 1:
        often = published.where(F.col("count") >= min_publications).select("id")
        for end in ("source", "target"):
            links = links.join(often, F.col(end) == F.col("id"), "left_semi")
    connected = links.select(F.col("source").alias("id")).union(links.select(F.col("target").alias("id"))).distinct()
    return published.join(connected, "id", "left_semi"), links


def both_ways(links: DataFrame) -> DataFrame:
    """id, neighbour, weight: each link from both of its ends."""
    return links.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "weight").unionByName(links.select(F.col("target").alias("id"), F.col("source").alias("neighbour"), "weight"))


def neighbours(links: DataFrame) -> DataFrame:
    """id, neighbours (sorted), degree."""
    return both_ways(links).groupBy("id").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"), F.countDistinct("neighbour").alias("degree"))


def ego(links: DataFrame, selected: list[str]) -> DataFrame:
    """The selected authors that have a co-author, and everyone they have published with: id, is_selected."""
    chosen = F.col("id").isin(*selected)
    around = both_ways(links).where(chosen)
    return around.select("id").union(around.select(F.col("neighbour").alias("id"))).distinct().withColumn("is_selected", chosen)


def induced(links: DataFrame, shown: DataFrame) -> DataFrame:
    """The links with both ends among the shown nodes."""
    ids = shown.select("id")
    return links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def drawn(nodes: DataFrame, links: DataFrame, limit: int, selected: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn part: the busiest nodes, the selected ones and their neighbours, and the links between them."""
    top = nodes.orderBy(F.desc("count"), "id").limit(limit).select("id")
    ids = top.union(ego(links, selected).select("id")).distinct() if selected else top
    shown = nodes.join(ids, "id", "left_semi")
    return shown, induced(links, shown)


def solo(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """The selected authors (id) that have no co-author."""
    return selected.join(nodes, "id", "left_anti")


def focus(nodes: DataFrame, links: DataFrame, selected: list[str]) -> DataFrame:
    """id, count, role: selected, neighbour of a selected author, or other."""
    around = ego(links, selected)
    return nodes.join(around, "id", "left").select("id", "count", F.when(F.col("is_selected"), "selected").when(F.col("is_selected").isNotNull(), "neighbour").otherwise("other").alias("role"))


def own_links(links: DataFrame, selected: list[str]) -> DataFrame:
    """The links with a flag: does one end belong to the selection?"""
    return links.withColumn("own", F.col("source").isin(*selected) | F.col("target").isin(*selected))


def signature(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row that tells two drawn graphs apart: the joined ids, the number of links and the sum of their weights. For drawn graphs, which are limited."""
    ids = nodes.agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids"))
    return links.agg(F.count("*").alias("links"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).withColumn("ids", ids.scalar())
