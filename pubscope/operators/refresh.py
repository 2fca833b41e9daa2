"""Refreshing a register from its listing: what changed, what can be reused, and whether the result can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubscope.functions.text import fingerprint, present

LISTING_FIELDS = ("title", "authors", "publisher", "periodical")


def with_fingerprint(listing: DataFrame, fields: tuple[str, ...] = LISTING_FIELDS) -> DataFrame:
    """What the listing knows of an entry as one comparable text."""
    return listing.withColumn("fingerprint", fingerprint(*[F.col(c) for c in fields]))


def keep_last(rows: DataFrame, key: str, position: list[str]) -> DataFrame:
    """One row per key, the last by position; rows without key go."""
    return rows.where(present(F.col(key)).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*position)).alias("r")).select(key, "r.*")


def keep_first(rows: DataFrame, key: str, position: list[str]) -> DataFrame:
    """One row per key, the first by position; rows without key go."""
    return rows.where(present(F.col(key)).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*position)).alias("r")).select(key, "r.*")


def valid_records(records: DataFrame) -> DataFrame:
    """The cached records that can be reused: slug and url are there."""
    return records.where(present(F.col("slug")).isNotNull() & present(F.col("url")).isNotNull())


def diff(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """slug, status of both sides by slug and fingerprint: new, changed, unchanged, withdrawn. One join."""
    now = listing.select("slug", F.col("fingerprint").alias("now"), F.lit(True).alias("listed"))
    old = cached.select("slug", F.col("fingerprint").alias("old"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("listed").isNull(), "withdrawn").when(F.col("now").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return now.join(old, "slug", "full").select("slug", status.alias("status"))


def stale(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """The listing entries whose page must be fetched: unknown, or known under another fingerprint."""
    old = cached.select("slug", "fingerprint")
    return listing.join(old, ["slug", "fingerprint"], "left_anti")


def merge(listing: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """The new register: for every listing entry its fresh record, else its cached one if the fingerprint is the same.

    Records that are no longer listed go. Fresh and cached records have the same columns, slug and fingerprint among them.
    """
    reused = cached.join(listing.select("slug", "fingerprint"), ["slug", "fingerprint"], "left_semi").join(fresh.select("slug"), "slug", "left_anti")
    return fresh.join(listing.select("slug"), "slug", "left_semi").unionByName(reused)


def tag_types(records: DataFrame, sightings: DataFrame, types: DataFrame) -> DataFrame:
    """Records with their document type: from the type listings (slug, type_id), else the one recorded.

    A slug in two listings gets the type that comes last in the order of ``types`` (type_id, label, ordinal).
    """
    label = sightings.join(F.broadcast(types), "type_id").groupBy("slug").agg(F.max(F.struct("ordinal", "label")).alias("t")).select("slug", F.col("t.label").alias("found"))
    return records.join(label, "slug", "left").withColumn("document_type", F.coalesce("found", "document_type")).drop("found")


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """type_id, change, expected, actual: ids that are missing, added or renamed between two maps (type_id, label)."""
    e, a = expected.select("type_id", F.col("label").alias("expected")), actual.select("type_id", F.col("label").alias("actual"))
    change = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "added").otherwise("renamed")
    return e.join(a, "type_id", "full").where(~F.col("expected").eqNullSafe(F.col("actual"))).select("type_id", change.alias("change"), "expected", "actual")


def ordered_types(labels: list[str], records: DataFrame) -> DataFrame:
    """ordinal, label: the types in use, in the filter's order, then those that the filter lacks by name."""
    spark = records.sparkSession
    known = spark.createDataFrame(list(enumerate(labels)), "o int, label string")
    used = records.where("type is not null and type <> ''").select(F.col("type").alias("label")).distinct()
    listed = used.join(F.broadcast(known), "label", "left").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("o", F.lit(len(labels))).alias("o"), "label"))).alias("x"))
    return listed.select(F.posexplode("x").alias("ordinal", "t")).select("ordinal", "t.label")


def gates(records: DataFrame, previous: DataFrame | None = None, most_missing_years: float = 0.25, least_records: float = 0.9) -> DataFrame:
    """gate, ok, detail: is there anything, are years there, and is no large part of the records gone?"""
    year = F.nullif(F.col("year"), F.lit(0))
    now = records.agg(F.count("*").alias("n"), F.count_if(year.isNull()).alias("no_year"))
    base = now.withColumn("m", previous.agg(F.count("*")).scalar() if previous is not None else F.lit(0).cast("bigint"))
    checks = F.array(
        F.struct(F.lit("not_empty").alias("gate"), (F.col("n") > 0).alias("ok"), F.col("n").alias("detail")),
        F.struct(F.lit("years").alias("gate"), (F.col("no_year") <= F.col("n") * most_missing_years).alias("ok"), F.col("no_year").alias("detail")),
        F.struct(F.lit("no_drop").alias("gate"), (F.col("n") >= F.col("m") * least_records).alias("ok"), (F.col("n") - F.col("m")).alias("detail")),
    )
    return base.select(F.inline(checks))


def assert_gates(checked: DataFrame) -> None:
    """Raise if a gate is not passed; reads the three rows of the gates."""
    failed = [f"{r['gate']}: {r['detail']}" for r in checked.where("not ok").collect()]
    if failed:
        raise ValueError("refused: " + ", ".join(failed))
