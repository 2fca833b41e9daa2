"""References to records that do not exist, and what hangs on them.

A reference is an edge from a record to another one. It is a *direct* orphan if its target is not in the register at
the time the reference was listed. The record that holds it is then orphaned too, and references to orphaned records
are *inherited* orphans, level by level until nothing new is found.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pubscope.functions.text import present, slug_key
from pubscope.session import BROADCAST_ROWS, cut, scratch, small

FOREVER = "9999-12-31 23:59:59"
#: Seconds of a key's time line that one task sorts.
SLICE = 600


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def covered_at(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """``points`` with a column ``covered``: does some span of the same key start at or before ``at`` and end after it?

    Instead of joining every point with every span of its key, both are put on one time line: the distinct times of the
    points and the starts of the spans, combined before they are shuffled. The latest end among the spans begun so far
    is a running maximum, taken in two levels: within ten minutes of a key, and over the ten minutes of a key. So a hot
    key is spread over its time line, a hot moment is one row, and no task holds more than ten minutes of a key or one
    row per ten minutes. Open spans have a null ``end``; spans without key or start never cover; points without key or
    time are not covered.
    """
    cols = points.columns
    p = points.select(*cols, F.col(key).alias("_k"), _ntz(F.col(at)).alias("_t"))
    usable = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    none = F.lit(None).cast("timestamp_ntz")
    times = p.where(usable).select("_k", "_t", none.alias("_e"), F.lit(True).alias("_p"))
    begun = spans.select(F.col(key).alias("_k"), _ntz(F.col(start)).alias("_t"), F.coalesce(_ntz(F.col(end)), _ntz(F.lit(FOREVER))).alias("_e"), F.lit(False).alias("_p")).where(usable)
    line = times.unionByName(begun).groupBy("_k", "_t").agg(F.max("_e").alias("_e"), F.max("_p").alias("_p"))
    line = cut(line.withColumn("_s", F.floor(F.unix_seconds(F.col("_t").cast("timestamp")) / SLICE)), "line")
    slices = line.groupBy("_k", "_s").agg(F.max("_e").alias("_m"))
    before = slices.select("_k", "_s", F.max("_m").over(W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)).alias("_b"))
    inside = W.partitionBy("_k", "_s").orderBy("_t").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = line.withColumn("_r", F.max("_e").over(inside)).where("_p").join(before, ["_k", "_s"], "left").where(F.greatest("_r", "_b") > F.col("_t")).select("_k", "_t", F.lit(True).alias("covered"))
    return p.join(hit, ["_k", "_t"], "left").select(*cols, F.coalesce("covered", F.lit(False)).alias("covered"))


def _edges(refs: dict[str, DataFrame], register: DataFrame) -> DataFrame:
    """The references once each: ref_table, ref_id, from_slug, target, listed_at, covered (is the target in the register then?)."""
    rows = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("ref_table"), F.col("ref_id").cast("bigint").alias("ref_id"), "from_slug", "slug", "listed_at") for name, df in refs.items()],
    )
    once = (
        rows.where(present(F.col("slug")).isNotNull())
        .groupBy("ref_table", "ref_id")
        .agg(F.min(F.struct("slug", "listed_at", "from_slug")).alias("r"))
        .select("ref_table", "ref_id", F.lower(F.trim("r.from_slug")).alias("from_slug"), slug_key(F.col("r.slug")).alias("target"), "r.listed_at")
    )
    once = cut(once, "references")
    spans = register.select(F.lower(F.trim("slug")).alias("target"), "harvested_at", "withdrawn_at")
    return covered_at(once, spans, "target", "listed_at", "harvested_at", "withdrawn_at")


def direct_orphans(refs: dict[str, DataFrame], register: DataFrame) -> DataFrame:
    """Level 0 of the cascade, ref_table and ref_id alone: the direct orphans of ``orphan_references``."""
    return _edges(refs, register).where(~F.col("covered")).select("ref_table", "ref_id")


def orphan_references(refs: dict[str, DataFrame], register: DataFrame) -> DataFrame:
    """Direct and inherited orphans among the references of several tables.

    ``refs`` maps a table's name to its rows (ref_id, from_slug, slug, listed_at; other columns are ignored whatever
    their names). ``register`` has slug, harvested_at, withdrawn_at. Result: ref_table, ref_id, from_slug, target,
    listed_at, kind ('direct' or 'inherited'), depth (0 for direct).

    Cases: a reference with a null or blank slug names nothing and is no orphan; one whose slug is written but names
    nothing ('#x') is a direct orphan; a null listed_at lies in no period of the register, so the reference is a direct
    orphan; a reference loaded twice comes once (the row with the smallest slug text and time counts); a null from_slug
    orphans no record. Empty tables give an empty result.

    The fixpoint runs semi-joins from the records orphaned last to the references that name them, until no new record
    is orphaned (at the latest after as many levels as there are records). Each level's new records are added to one
    table in the shared folder, by which the next levels know what was seen; a level of few records is broadcast, so the
    references aren't shuffled again.
    """
    spark = register.sparkSession
    edges = cut(_edges(refs, register), "edges")
    cols = ["ref_table", "ref_id", "from_slug", "target", "listed_at"]
    direct, rest = edges.where(~F.col("covered")).select(*cols), edges.where("covered").select(*cols)
    record = F.col("from_slug").alias("rec")
    path, depth = f"{scratch(spark)}/orphaned-{uuid.uuid4().hex}", 0
    schema = "rec string, depth int"
    new = direct.select(record).where("rec is not null").distinct()
    while True:
        depth += 1
        size = Observation()
        new.observe(size, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/depth={depth}")
        if not size.get["n"]:
            break
        seen = spark.read.schema(schema).parquet(path)
        last = seen.where(F.col("depth") == depth).select("rec")
        last = F.broadcast(last) if size.get["n"] <= BROADCAST_ROWS else last
        reached = rest.join(last, rest["target"] == last["rec"], "left_semi").select(record).where("rec is not null").distinct()
        new = reached.join(seen, "rec", "left_anti")
    found = direct.select(*cols, F.lit("direct").alias("kind"), F.lit(0).alias("depth"))
    orphaned = spark.read.schema(schema).parquet(path).select(F.col("rec").alias("target"), "depth")
    return found.unionByName(rest.join(small(orphaned), "target").select(*cols, F.lit("inherited").alias("kind"), "depth"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, calendar month of listed_at and kind (a null listed_at forms the period 'undated')."""
    period = F.coalesce(F.date_format("listed_at", "yyyy-MM"), F.lit("undated"))
    return orphans.groupBy("ref_table", period.alias("period"), "kind").agg(F.count("*").alias("n"), F.countDistinct("target").alias("n_targets"))
