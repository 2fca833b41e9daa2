"""Sinks: sparse JSON, the shipped dataset, word files, unit texts. Each write is totally ordered, so that an unchanged input gives identical bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubscope.schema import RECORD_FIELDS


def _emptied(c: Column, kind: T.DataType) -> Column:
    """The value, null if it is empty."""
    if isinstance(kind, T.StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, c)
    return c


def sparse(df: DataFrame) -> DataFrame:
    """Empty strings, arrays and maps become nulls, which JSON writers leave out."""
    return df.select(*[_emptied(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str, order: list[str], single: bool = True, dry_run: bool = False) -> int:
    """Write rows without their empty fields, in order; gives the number of rows. A dry run only counts.

    ``single`` makes one file, for datasets of a site's size; a large one is written in ordered parts.
    """
    if dry_run:
        return df.count()
    out = sparse(df).orderBy(*order)
    (out.coalesce(1).sortWithinPartitions(*order) if single else out).write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path).count()


def write_dataset(records: DataFrame, path: str, dry_run: bool = False) -> int:
    """The slim records, sorted by slug."""
    return write_json(records.select(*RECORD_FIELDS), path, ["slug"], dry_run=dry_run)


def write_words(words: DataFrame, path: str, dry_run: bool = False) -> int:
    """One JSON array of text and size in their ranking (``rank``), as the cloud reads it; a ranking's top is bounded."""
    if not dry_run:
        ranked = F.array_sort(F.collect_list(F.struct("rank", "text", "size")))
        payload = words.agg(F.to_json(F.transform(ranked, lambda x: F.struct(x["text"].alias("text"), x["size"].alias("size")))).alias("value"))
        payload.coalesce(1).write.mode("overwrite").text(path)
    return words.count()


def unit_document(title: Column, abstract: Column, entries: Column) -> Column:
    """A unit as a text: title, abstract, and each entry's title and paragraphs, with blank lines between."""
    parts = F.flatten(F.transform(entries, lambda e: F.concat(F.array(e["title"]), F.coalesce(e["paragraphs"], F.array().cast("array<string>")))))
    return F.concat(F.array_join(F.concat(F.array(title), F.coalesce(abstract, F.array().cast("array<string>")), parts), "\n\n"), F.lit("\n"))


def write_documents(units: DataFrame, path: str, dry_run: bool = False) -> int:
    """One text per unit (stem, title, abstract, entries), in a folder per stem."""
    docs = units.select("stem", unit_document(F.col("title"), F.col("abstract"), F.col("entries")).alias("value"))
    if not dry_run:
        docs.write.mode("overwrite").partitionBy("stem").text(path)
    return docs.count()


def write_payload(df: DataFrame, path: str, order: list[str], field: str = "publications", dry_run: bool = False, **head: str | list[str]) -> int:
    """One JSON object, as a site ships it: ``head`` (source, document_types ...) and the rows in ``field``, sparse and in order.

    One task writes it line by line and holds one batch; a register beyond a site's size is written by ``write_json``,
    in parallel, and read the same way.
    """
    n = df.count()
    if dry_run:
        return n
    intro = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}, " for k, v in head.items()) + f"{json.dumps(field)}: ["
    rows = sparse(df).select(*order, F.to_json(F.struct(*df.columns)).alias("value")).repartition(1).sortWithinPartitions(*order).select("value")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([intro])], names=["value"])
        held: str | None = None
        for b in batches:
            for value in b.column(0).to_pylist():
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([held + ","])], names=["value"])
                held = value
        yield pa.RecordBatch.from_arrays([pa.array(([held] if held is not None else []) + ["]}"])], names=["value"])

    # without rows there would be no task to write the object
    text = rows.mapInArrow(lines, "value string") if n else df.sparkSession.createDataFrame([(f"{intro}]}}",)], "value string").coalesce(1)
    text.write.mode("overwrite").text(path)
    return n


def write_manifest(units: DataFrame, path: str, only: list[str] | None = None, source: str = "", dry_run: bool = False) -> int:
    """The units' manifest (stem, slug, label, url, projects), on full runs only: a run over chosen units leaves it as it is.

    ``units``: stem, title, entries; slug and url where they are known.
    """
    if only:
        return 0
    kind = F.transform("entries", lambda e: F.struct(e["title"].alias("title"), e["url"].alias("url"), F.when(e["inline"], "umbrella").otherwise("project").alias("kind")))
    known = [F.col(c) if c in units.columns else F.lit(None).cast("string").alias(c) for c in ("slug", "url")]
    return write_payload(units.select("stem", known[0], F.col("title").alias("label"), known[1], kind.alias("projects")), path, ["stem"], "units", dry_run, source=source)
