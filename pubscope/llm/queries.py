"""The queries of the text problems and the SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubscope.functions.text import clean_text
from pubscope.llm.boilerplate import main_blocks
from pubscope.llm.cooccur import co_occurrence, latest_baskets
from pubscope.llm.encode import decode_corpus, encode_corpus
from pubscope.llm.mixture import CLOSE, mixture, sized
from pubscope.llm.pieces import split_oversized
from pubscope.llm.variants import link_variants, variant_pairs
from pubscope.session import cut_large, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return co_occurrence(latest_baskets(table(spark, d, "publications"), "slug", "authors", ["harvested_at", "ingested_at"]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand together at least 4 times and 5 times as often as chance."""
    return _pairs(spark, d).selectExpr("a as author_a", "b as author_b")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts, lift and pointwise mutual information."""
    return _pairs(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each page's main body."""
    return main_blocks(table(spark, d, "unit_pages"))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row on p5_found: are its blocks there and not blank, is each given once, is none the page's own title?"""
    pages = table(spark, d, "unit_pages")
    got = main_blocks(pages).groupBy("page_id", "pos").agg(F.count("*").alias("n")).join(pages.select("page_id", "title", "paragraphs"), "page_id")
    block = clean_text(F.get("paragraphs", F.col("pos") - 1))
    return got.agg(F.bool_and(F.coalesce(F.length(block) > 0, F.lit(False))).alias("blocks_ok"), F.bool_and(F.col("n") == 1).alias("once_ok"), F.bool_and(F.coalesce(block != clean_text(F.col("title")), F.lit(True))).alias("titles_ok"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "publications")
    forms = [records.select(F.lit("author").alias("field"), F.explode(F.array_distinct("authors")).alias("form"))]
    forms += [records.select(F.lit(c).alias("field"), F.col(c).alias("form")) for c in ("journal", "publisher")]
    counts = forms[0].unionByName(forms[1]).unionByName(forms[2]).where("form is not null").groupBy("field", "form").agg(F.count("*").alias("n"))
    return link_variants(table(spark, d, "name_forms"), counts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of forms that denote the same person, journal or publisher."""
    return variant_pairs(_variants(spark, d))


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity of each form."""
    return _variants(spark, d)


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row on p6_found: are pairs in order and of one field, are they all pairs of their entities, are forms that differ in case alone linked?"""
    forms = table(spark, d, "name_forms").select("name_id", "field", "form").hint("merge")
    links = cut_large(_variants(spark, d).select("name_id", "field", "entity"), "links")
    pairs = cut_large(variant_pairs(links), "pairs")
    sides = pairs.join(forms.select(F.col("name_id").alias("name_id_a"), F.col("field").alias("fa")), "name_id_a").join(forms.select(F.col("name_id").alias("name_id_b"), F.col("field").alias("fb")), "name_id_b")
    order = sides.agg(F.bool_and((F.col("name_id_a") < F.col("name_id_b")) & (F.col("fa") == F.col("fb"))).alias("pairs_ok"), F.count("*").alias("n"))
    want = links.groupBy("field", "entity").agg(F.countDistinct("name_id").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).cast("long").alias("want"))
    cased = forms.where("form is not null").join(links.drop("field"), "name_id").groupBy("field", F.lower("form").alias("low")).agg(F.countDistinct("entity").alias("e"))
    case = cased.where("field <> 'author'").agg(F.coalesce(F.max("e"), F.lit(1)).alias("most"))
    return order.withColumn("want", want.scalar()).withColumn("most", case.scalar()).select("pairs_ok", (F.col("n") == F.col("want")).alias("all_ok"), (F.col("most") <= 1).alias("case_ok"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again, by digest and length."""
    text = decode_corpus(encode_corpus(table(spark, d, "documents")))
    return text.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: each chosen text with its copies."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_full_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of a mixture as large as the sources' texts, where small sources reach their cap."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), "available")[1]


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """For each source: are its copies within the cap, is its budget met as far as its texts allow, are its texts its own?"""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    mixed, report = mixture(docs, targets)
    copies = mixed.groupBy("source", "doc_id").agg(F.max("copy").alias("copies"), F.count("*").alias("rows_"))
    texts = sized(docs).select("source", F.col("id").alias("doc_id"), "n")
    plan = report.select("source", "max_repeats", (F.col("budget_tokens") - F.col("actual_tokens")).alias("gap"), F.col("budget_tokens").alias("budget"), F.coalesce(F.floor(F.try_divide("budget_tokens", "available_tokens")), F.lit(0)).alias("epochs"))
    both = copies.join(texts, ["source", "doc_id"], "full").join(F.broadcast(plan), "source").withColumn("copies", F.coalesce("copies", F.lit(0)))
    fits = (F.col("copies") <= F.col("epochs")) & (F.col("n") <= F.col("gap")) & (F.col("gap") > CLOSE * F.col("budget"))
    got = both.groupBy("source").agg(
        F.bool_and((F.col("copies") <= F.col("max_repeats")) & (F.coalesce("rows_", "copies") == F.col("copies"))).alias("repeats_ok"), F.bool_and(~F.coalesce(fits, F.lit(False)) & (F.col("gap") >= 0)).alias("budget_ok"), F.bool_and(F.col("n").isNotNull()).alias("texts_ok")
    )
    return plan.select("source").join(got, "source", "left").select("source", *[F.coalesce(c, F.lit(True)).alias(c) for c in ("repeats_ok", "budget_ok", "texts_ok")])


def p9_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every document put together from its pieces (as it is without any), by digest; are all pieces within the limit and does each go on where the one before ends?"""
    docs, limits = table(spark, d, "documents"), table(spark, d, "piece_limits")
    pieces = split_oversized(docs, limits).join(F.broadcast(limits.select("source", "max_tokens")), "source")
    ordered = F.sort_array(F.collect_list(F.struct("piece_no", "char_start", "char_end", "text")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"), F.lit(True).alias("ok"))

    def add(a: Column, x: Column) -> Column:
        joins = a["ok"] & (x["char_start"] <= a["end"] + 1) & (x["char_end"] > a["end"])
        return F.struct(F.concat(a["text"], F.substr(x["text"], a["end"] - x["char_start"] + 2)).alias("text"), x["char_end"].alias("end"), joins.alias("ok"))

    one = pieces.groupBy("doc_id").agg(F.aggregate(ordered, start, add).alias("a"), F.bool_and((F.col("n_tokens") <= F.col("max_tokens")) | (F.length("text") == 1)).alias("within"))
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(one, "doc_id", "left")
    return whole.select("doc_id", F.md5(F.coalesce("a.text", "text")).alias("digest"), F.coalesce(F.col("within") & F.col("a.ok"), F.lit(True)).alias("ok"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the documents over their source's limit."""
    return split_oversized(table(spark, d, "documents"), table(spark, d, "piece_limits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p5_found": p5_found,
    "p5_checked": p5_checked,
    "p6_found": p6_found,
    "p6_checked": p6_checked,
    "p6_entities": p6_entities,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_full_shares": p8_full_shares,
    "p8_checked": p8_checked,
    "p9_pieces": p9_pieces,
    "p9_rebuilt": p9_rebuilt,
}

_PAIRS = r"""WITH latest AS (SELECT slug, arg_max_null(authors, (harvested_at, ingested_at)) AS authors FROM publications WHERE slug IS NOT NULL GROUP BY slug),
  names AS (SELECT DISTINCT slug, regexp_replace(x, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS name FROM (SELECT slug, unnest(authors) AS x FROM latest) WHERE x IS NOT NULL),
  item AS (SELECT slug, name FROM names WHERE name <> ''),
  marginal AS (SELECT name, count(*) AS n FROM item GROUP BY name),
  pair AS (SELECT x.name AS a, y.name AS b, count(*) AS n_ab FROM item x JOIN item y ON x.slug = y.slug AND x.name < y.name GROUP BY 1, 2 HAVING count(*) >= 4),
  found AS (SELECT a, b, n_ab, p.n AS n_a, q.n AS n_b, (SELECT count(DISTINCT slug) FROM item) AS n_all
            FROM pair JOIN marginal p ON a = p.name JOIN marginal q ON b = q.name)
"""
ORACLES: dict[str, str] = {
    "p5_checked": "SELECT true AS blocks_ok, true AS once_ok, true AS titles_ok",
    "p6_checked": "SELECT true AS pairs_ok, true AS all_ok, true AS case_ok",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM documents",
    "p8_checked": "SELECT source, true AS repeats_ok, true AS budget_ok, true AS texts_ok FROM mix_targets",
    "p9_rebuilt": "SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS ok FROM documents",
    "p3_found": _PAIRS + "SELECT a AS author_a, b AS author_b FROM found WHERE n_ab * n_all >= 5 * n_a * n_b",
    "p3_pairs": _PAIRS + "SELECT *, n_ab / n_a * n_all / n_b AS lift, round(ln(n_ab / n_a * n_all / n_b), 9) AS pmi FROM found WHERE n_ab * n_all >= 5 * n_a * n_b",
}
