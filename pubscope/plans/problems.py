"""The queries of the core problems: references, snapshots, packed fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubscope.operators.orphans import direct_orphans, orphan_references, orphan_report
from pubscope.operators.snapshots import snapshot_changes
from pubscope.operators.unpack import unpack
from pubscope.session import table


def _references(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return {t: table(spark, d, t) for t in ("volume_refs", "contribution_refs")}, table(spark, d, "publications")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is not in the register when they are listed."""
    return direct_orphans(*_references(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and month."""
    return orphan_report(orphan_references(*_references(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records added, removed or given a new title since the snapshot before."""
    return snapshot_changes(table(spark, d, "publication_snapshots"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every name of a listing line's authors cell with its position."""
    return unpack(table(spark, d, "listing_entries"), "entry_id", "authors", "author")


def p4_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row on p4_found: are positions without gaps, are names no blanks, does every name stand in its cell?

    Blanks, quotes and what notes leave out don't count: the letters and figures of a name stand in its cell in order.
    """
    cells = table(spark, d, "listing_entries").select("entry_id", "authors")
    plain = lambda c: F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", "")
    bare = lambda c: F.regexp_replace(c, r"(?i)[(\[]\s*(?:eds?|hgg?|hrsg|hgs|hgb|dirs?|éds?|coords?|trans|transl|translator|trad|übers|comps?|editors?|herausgeber|herausgeberin|contributor|red)\.?\s*[)\]]", "")
    names = p4_found(spark, d).join(cells, "entry_id")
    held = F.contains(plain(bare(F.col("authors"))), plain(F.col("author")))
    per = names.groupBy("entry_id").agg(F.max("pos").alias("last"), F.countDistinct("pos").alias("n"), F.bool_and(F.length(plain(F.col("author"))) > 0).alias("named"), F.bool_and(held).alias("held"))
    return per.agg(F.bool_and(F.col("last") == F.col("n")).alias("positions_ok"), F.bool_and("named").alias("names_ok"), F.bool_and("held").alias("cells_ok"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_checked": p4_checked,
}

_SLUG = r"""lower(regexp_extract(regexp_replace(url_decode(replace(regexp_replace(regexp_replace(regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), '(?s)[?#].*$', ''), '+', '%2B')), '^[/\s\x{{a0}}]+|[/\s\x{{a0}}]+$', '', 'g'), '[^/]*$'))"""
_BLANK = r"'^[\s\x{a0}]+|[\s\x{a0}]+$'"

_REFS = f"""
refs AS (SELECT 'volume_refs' AS ref_table, ref_id, from_slug, slug, listed_at FROM volume_refs
         UNION SELECT 'contribution_refs', ref_id, from_slug, slug, listed_at FROM contribution_refs),
r AS (SELECT ref_table, ref_id, lower(trim(from_slug)) AS from_slug, listed_at, {_SLUG.format(c="slug")} AS target
      FROM refs WHERE regexp_replace(slug, {_BLANK}, '', 'g') <> ''),
direct AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM publications p WHERE lower(trim(p.slug)) = r.target
           AND p.harvested_at <= r.listed_at AND (p.withdrawn_at IS NULL OR p.withdrawn_at > r.listed_at)))
"""

ORACLES: dict[str, str] = {
    "p4_checked": "SELECT true AS positions_ok, true AS names_ok, true AS cells_ok",
    "p1_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_id FROM direct",
    "p1_report": f"""WITH RECURSIVE {_REFS},
        gone(rec) AS (SELECT from_slug FROM direct UNION SELECT r.from_slug FROM r JOIN gone ON r.target = gone.rec),
        kinds AS (SELECT *, 'direct' AS kind FROM direct UNION ALL
                  SELECT *, 'inherited' FROM (SELECT * FROM r EXCEPT SELECT * FROM direct) e WHERE target IN (SELECT rec FROM gone))
        SELECT ref_table, strftime(listed_at, '%Y-%m') AS period, kind, count(*) AS n, count(DISTINCT target) AS n_targets
        FROM kinds GROUP BY ALL""",
    "p2_found": r"""WITH s AS (SELECT snapshot_date, delivery, row_no, regexp_replace(slug, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS slug,
            trim(regexp_replace(nfc_normalize(regexp_replace(coalesce(title, ''), '[\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g')), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS title FROM publication_snapshots),
        d AS (SELECT snapshot_date, max(delivery) AS delivery, row_number() OVER (ORDER BY snapshot_date) AS n FROM s GROUP BY 1),
        x AS (SELECT d.n, slug, max_by(title, row_no) AS title FROM s JOIN d USING (snapshot_date, delivery) WHERE slug <> '' GROUP BY 1, 2),
        c AS (SELECT coalesce(b.n, a.n + 1) AS n, coalesce(b.slug, a.slug) AS slug,
                CASE WHEN a.slug IS NULL THEN 'added' WHEN b.slug IS NULL THEN 'removed' ELSE 'changed' END AS change
              FROM x a FULL JOIN x b ON a.n + 1 = b.n AND a.slug = b.slug WHERE a.slug IS NULL OR b.slug IS NULL OR a.title <> b.title)
        SELECT strftime(d.snapshot_date, '%Y-%m-%d') AS snapshot_date, slug, change FROM c JOIN d USING (n) WHERE n > 1""",
}
