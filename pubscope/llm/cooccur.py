"""Items that appear together, with how much more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubscope.functions.text import strip_blank
from pubscope.session import cut

#: Baskets of more items than this lose the items that can be in no result, and are spread, before their pairs are formed.
WIDE = 64

_BIG = "decimal(38,0)"


def latest_baskets(rows: DataFrame, key: str, items: str, order: list[str]) -> DataFrame:
    """One basket of distinct items per key, from the row that is last by ``order`` (ties: the largest list of items).

    Items count without outer blanks; null and blank ones go, and baskets without items with them. Rows without key
    are in no basket. The latest row is an aggregate that combines before the shuffle, so a hot key costs no more.
    """
    last = F.max_by(items, F.struct(*order, items)).alias("items")
    names = F.filter(F.transform("items", strip_blank), lambda x: x.isNotNull() & (x != ""))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(F.array_sort(F.array_distinct(names)).alias("items")).where("size(items) > 0")


def _pairs(baskets: DataFrame) -> DataFrame:
    """Ordered pairs a < b of each (sorted) basket: every item with the ones after it, generated row by row."""
    first = baskets.where("size(items) > 1").select("items", F.posexplode("items").alias("i", "a"))
    return first.select("a", F.explode(F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))).alias("b"))


def _wide_pairs(rows: DataFrame) -> DataFrame:
    """The same for wide baskets (id, item), which are never brought together: the first item of a pair is spread over a
    basket's salts, one per WIDE items, and the second repeated for each, so a task has at most about WIDE * n pairs."""
    salts = rows.groupBy("id").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("salts"))
    sized = rows.join(salts, "id")
    first = sized.select("id", F.col("item").alias("a"), F.pmod(F.xxhash64("item"), F.col("salts")).cast("int").alias("salt"))
    second = sized.select("id", F.col("item").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return first.join(second, ["id", "salt"]).where("a < b").select("a", "b")


def co_occurrence(baskets: DataFrame, min_count: int = 4, min_lift: float = 5) -> DataFrame:
    """Pairs of items with n_ab >= min_count and n_ab * N >= min_lift * n_a * n_b.

    ``baskets`` has one column ``items``, a sorted array of distinct strings. Result: a, b (a before b by code point),
    n_ab, n_a, n_b, n_all, lift, pmi (natural logarithm, 9 decimals). No baskets or no such pair: an empty result.

    Pair counts combine map-side, then meet the marginals; only pairs that reach ``min_count`` are joined. A basket of
    n items has n*(n-1)/2 pairs, so from wide baskets the items are first removed that cannot be in any result: those
    in fewer than ``min_count`` baskets or in more than N / min_lift. This changes no count.
    """
    baskets = cut(baskets, "baskets")
    n_all = baskets.count()
    single = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    useful = cut(single.where(F.col("n") >= min_count).where(F.col("n") * F.lit(min_lift) <= F.lit(n_all)), "items")
    wide = (
        baskets.where(f"size(items) > {WIDE}")
        .withColumn("id", F.monotonically_increasing_id())  # before the explode, which would number the items
        .select("id", F.explode("items").alias("item"))
        .join(useful.select("item"), "item", "left_semi")
    )
    pairs = _pairs(baskets.where(f"size(items) <= {WIDE}")).unionByName(_wide_pairs(cut(wide, "wide")))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    both = (
        counts.join(useful.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a")
        .join(useful.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        .withColumn("n_all", F.lit(n_all).cast("bigint"))
    )
    enough = F.col("n_ab").cast(_BIG) * F.lit(n_all).cast(_BIG) >= F.col("n_a").cast(_BIG) * F.col("n_b").cast(_BIG) * F.lit(min_lift)
    lift = F.col("n_ab") / F.col("n_a") * F.col("n_all") / F.col("n_b")
    return both.where(enough).select("a", "b", "n_ab", "n_a", "n_b", "n_all", lift.alias("lift"), F.round(F.log(lift), 9).alias("pmi"))
