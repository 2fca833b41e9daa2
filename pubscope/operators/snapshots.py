"""What changed between full snapshots, from compact key and row-hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pubscope.functions.text import INVISIBLE, nfc, squeeze, strip_blank
from pubscope.session import cut, small

CHANGES = ("added", "removed", "changed")
_KERNEL_SCHEMA = "d int, src int, k long, r long, change int"


def same_text(c: Column) -> Column:
    """The text by which two titles are compared: without invisible marks, composed, blanks squeezed, null as empty."""
    return F.coalesce(squeeze(nfc(F.translate(c, INVISIBLE, ""))), F.lit(""))


def last_of_key(d: np.ndarray, k: np.ndarray, r: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the row that counts for each (d, k), sorted by (d, k): highest r, then highest h."""
    order = np.lexsort((h, r, k, d))
    if not len(order):
        return order
    ds, ks = d[order], k[order]
    return order[np.append((ds[1:] != ds[:-1]) | (ks[1:] != ks[:-1]), True)]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side: repeated keys within a batch shrink to one row, so that a hot key doesn't travel row by row."""
    for b in batches:
        d, k, r, h = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("d", "k", "r", "h"))
        keep = last_of_key(d, k, r, h)
        yield b if len(keep) == b.num_rows else b.take(pa.array(np.sort(keep)))


def _diff(t: pa.Table) -> pa.Table:
    """The differences of consecutive dates within one hash bucket."""
    d, k, r, h = (t.column(n).to_numpy() for n in ("d", "k", "r", "h"))
    keep = last_of_key(d, k, r, h)
    d, k, r, h = d[keep], k[keep], r[keep], h[keep]
    out: list[tuple] = []
    dates = np.unique(d)
    span = {int(x): slice(*np.searchsorted(d, [x, x + 1])) for x in dates}
    none = slice(0, 0)
    top = int(t.column("n_dates")[0].as_py()) if t.num_rows else 0
    for later in sorted({int(x) for x in dates} | {int(x) + 1 for x in dates}):
        if later < 1 or later >= top:
            continue
        a, b = span.get(later - 1, none), span.get(later, none)
        ka, kb = k[a], k[b]
        at = np.searchsorted(ka, kb)
        inside = at < len(ka)
        both = np.zeros(len(kb), bool)
        both[inside] = ka[at[inside]] == kb[inside]
        gone = np.ones(len(ka), bool)
        gone[at[both]] = False
        changed = both.copy()
        changed[both] = h[a][at[both]] != h[b][both]
        for mask, side, src, what in ((~both, b, later, 0), (gone, a, later - 1, 1), (changed, b, later, 2)):
            n = int(mask.sum())
            if n:
                out.append((np.full(n, later, np.int32), np.full(n, src, np.int32), k[side][mask], r[side][mask], np.full(n, what, np.int32)))
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(5)]
    return pa.table([pa.array(c, ty) for c, ty in zip(cols, types)], names=["d", "src", "k", "r", "change"])


def snapshot_changes(rows: DataFrame, rows_per_bucket: int = 500_000) -> DataFrame:
    """Records added, removed or changed between consecutive snapshot dates: snapshot_date, slug, change.

    ``rows`` has snapshot_date, delivery, row_no, slug, title; other columns are ignored. Only the highest delivery of
    a date counts (a null delivery is the lowest), within it the row with the highest row_no of a slug (null the
    lowest; among equal row_no the one with the highest title hash). Slugs count without outer blanks; rows without
    slug or date do not count, but a date all of whose rows lack slugs still counts as a date. The first date has no
    rows in the result, and an empty or one-date table gives none.

    Only compact arrays are shuffled: the date's number, a 64-bit slug hash, row_no and a 64-bit title hash, bucketed
    by another hash of the slug, so a collision needs equality of about 80 bits. Each bucket sorts its arrays and finds
    the differences by searchsorted; the number of buckets follows the rows, so a bucket stays at about
    ``rows_per_bucket``. Slugs are read again only for the keys that differ.
    """
    spark = rows.sparkSession
    rows = rows.select("snapshot_date", F.coalesce("delivery", F.lit(-1)).alias("delivery"), F.coalesce("row_no", F.lit(-1)).cast("bigint").alias("r"), strip_blank(F.col("slug")).alias("slug"), "title")
    dates = rows.where("snapshot_date is not null").groupBy("snapshot_date").agg(F.max("delivery").alias("delivery"), F.count("*").alias("n"))
    # one row per date: a window without partitions over it is small
    dates = cut(dates.withColumn("d", (F.row_number().over(W.orderBy("snapshot_date")) - 1).cast("int")), "dates")
    n_dates, n_rows = dates.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // rows_per_bucket))
    counted = rows.where(F.length("slug") > 0).join(small(dates.select("snapshot_date", "delivery", "d")), ["snapshot_date", "delivery"])
    k = F.xxhash64(F.col("slug"))
    compact = counted.select("d", k.alias("k"), "r", F.xxhash64(same_text(F.col("title"))).alias("h"), F.pmod(F.hash("slug"), F.lit(buckets)).alias("b"))
    compact = compact.mapInArrow(_combine, compact.schema)
    found = compact.withColumn("n_dates", F.lit(n_dates)).groupBy("b").applyInArrow(_diff, _KERNEL_SCHEMA)
    found = cut(found, "changes")
    names = counted.select(F.col("d").alias("src"), "r", k.alias("k"), "slug")
    change = F.element_at(F.array(*[F.lit(c) for c in CHANGES]), F.col("change") + 1)
    full = names.join(small(found), ["src", "k", "r"]).select("d", "slug", change.alias("change")).distinct()
    day = dates.select("d", F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"))
    return full.join(small(day), "d").select("snapshot_date", "slug", "change")
