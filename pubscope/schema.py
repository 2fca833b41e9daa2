"""Schemas of the register, and the records that the views work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubscope.functions.text import strip_blank

REFERENCE = T.StructType(
    [
        T.StructField("slug", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("subtitle", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("role", T.StringType()),
    ]
)
# The fields of a harvested publication in the register's JSON, in its order, with their types.
PUBLICATION_FIELDS = """
slug string, url string, title string, subtitle string, authors array<string>, document_type string, year int, date string,
journal string, volume string, issue string, publisher string, places array<string>, series string, pages string,
isbn string, issn string, doi string, link string, abstract string, note string, cover string
"""
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType())}
_PLAIN = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in PUBLICATION_FIELDS.split(",") if x.strip())])
#: A harvested publication as the register's JSON has it.
PUBLICATION = T.StructType([*_PLAIN.fields, T.StructField("published_in", REFERENCE), T.StructField("contributions", T.ArrayType(REFERENCE)), T.StructField("fingerprint", T.StringType())])
LISTING = T.StructType([T.StructField(c, T.StringType()) for c in ("slug", "title", "authors", "publisher", "periodical")])
WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("size", T.LongType())])

#: The columns of a slim record, in the order of the shipped dataset.
RECORD_FIELDS = ("slug", "url", "title", "subtitle", "authors", "type", "year", "journal", "publisher", "series", "doi")
#: A slim record as the shipped dataset has it.
SLIM = T.StructType([T.StructField(c, T.IntegerType() if c == "year" else T.ArrayType(T.StringType()) if c == "authors" else T.StringType()) for c in RECORD_FIELDS])


def some(c: Column) -> Column:
    """Missing, empty and blank are the same: null. Outer blanks go."""
    return F.nullif(strip_blank(c), F.lit(""))


def some_items(c: Column) -> Column:
    """The elements of an array that are neither null nor blank, without outer blanks; null becomes empty."""
    return F.coalesce(F.filter(F.transform(c, strip_blank), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; an aggregate that combines before the shuffle. Null keys go."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("r")).select(key, "r.*")


def slim_records(publications: DataFrame, *columns: str) -> DataFrame:
    """The slim records of a register of harvests: the latest harvest of each slug, missing values as null, year 0 as null.

    ``columns``: those that a view needs (all without any); the others are not even read, nor carried to the aggregate.
    """
    wanted = [c for c in RECORD_FIELDS if c != "slug" and (not columns or c in columns)]
    last = latest(publications, "slug", ["harvested_at", "ingested_at"], ["document_type" if c == "type" else c for c in wanted])
    special = {"authors": some_items(F.col("authors")), "type": some(F.col("document_type")) if "type" in wanted else None, "year": F.nullif(F.col("year").cast("int"), F.lit(0))}
    return last.select("slug", *[(special[c] if c in special else some(F.col(c))).alias(c) for c in wanted])
