"""Mixing sources to target weights, in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pubscope.llm.encoder import encoder, vocabulary
from pubscope.session import cut, cut_counted, small

#: A source has its budget if it misses no more than this share of it.
CLOSE = 0.001
#: Texts that one task sorts.
ROWS_PER_RANGE = 200_000


def _count_tokens(vocab: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), b.column("same"), n], names=["id", "source", "same", "n"])

    return run


def sized(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Distinct texts of each source with their size: source, id (the smallest doc_id), n (tokens), rows.

    Null and empty texts have no size and are left out, as are rows without source. Equal texts of one source are one,
    since the cap on repeats holds for a text, not for a row. Texts are counted where they are read; what is shuffled
    is a digest and a number.
    """
    rows = docs.where("source is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("id"), "source", F.md5("text").alias("same"), "text")
    counted = rows.mapInArrow(_count_tokens(vocabulary(docs.sparkSession, folder)), "id long, source string, same string, n long")
    return counted.groupBy("source", "same").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count("*").alias("rows"))


@dataclass(frozen=True)
class Budget:
    """What a source is to give: ``epochs`` whole passes and ``rest`` tokens of one more."""

    source: str
    share: float
    repeats: int
    available: int
    budget: int

    @property
    def epochs(self) -> int:
        return self.budget // self.available if self.available else 0

    @property
    def rest(self) -> int:
        return self.budget - self.epochs * self.available if self.available else 0


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> list[Budget]:
    """Token budgets of the sources.

    Sources without text can give nothing; their share falls to the others in proportion. With ``total`` None the
    mixture is as large as it can be while every source that has text keeps its share exactly. A given ``total`` may
    exceed what the caps allow: capped sources then give all they may, and what they lack falls to the others in
    proportion, until the total or every cap is reached.
    """
    cap = {s: available.get(s, 0) * max(0, r or 0) for s, _, r in targets}
    live = {s: w for s, w, _ in targets if cap[s] > 0 and (w or 0) > 0}
    weight = sum(live.values())
    if not live:
        return [Budget(s, w, r, available.get(s, 0), 0) for s, w, r in targets]
    if total is None:
        total = min(cap[s] * weight / w for s, w in live.items())
    got: dict[str, int] = {}
    left = total
    while live:
        weight = sum(live.values())
        full = [s for s, w in live.items() if left * w / weight > cap[s] + 0.5]
        if not full:
            got |= {s: min(cap[s], round(left * w / weight)) for s, w in live.items()}
            break
        for s in full:
            got[s] = cap[s]
            del live[s]
        left = total - sum(got.values())
    return [Budget(s, w, r, available.get(s, 0), got.get(s, 0)) for s, w, r in targets]


def _up_to(rows: DataFrame) -> DataFrame:
    """source, id, n of the texts that, in the order of their keys, stay within their source's ``goal``."""
    per_range = rows.groupBy("source", "range").agg(F.sum("n").alias("s"))
    before = per_range.select("source", "range", F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("n").over(W.partitionBy("source", "range").orderBy("key", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("upto", upto).join(before, ["source", "range"]).where(F.col("before") + F.col("upto") <= F.col("goal")).select("source", "id", "n")


def mixture(docs: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 7, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: source, doc_id, copy (from 1), n_tokens. Report: source, target_share, max_repeats, n_texts,
    available_tokens, budget_tokens, actual_tokens, actual_share, most_copies; a source of ``targets`` without text has
    zeros, and documents of sources not named there are not in the mixture.

    ``total``: the tokens wanted; None for the largest mixture in which every source that has text keeps its share
    exactly; "available" for as many as the named sources have, so that sources too small for their share repeat their
    texts as often as they may and the others fill up. The driver reads one row per source that the targets name.

    Each text gets a random key from a hash of its id; a source's texts are ranged by it. Ranges are equal parts of
    the hash space, so they are balanced however large a source is; prefix sums are taken within ranges and, from the
    ranges' sums, over them. The last pass of a source ends before the text that would exceed its budget; texts after it
    that fit into what is left are then taken in the same order, until the budget is met to the share CLOSE or no text
    fits. So a very long text doesn't keep a source from its share. Equal keys are ordered by doc_id.
    """
    spark = docs.sparkSession
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()
    named = spark.createDataFrame([(g["source"],) for g in goal], "source string")
    texts = cut(sized(docs.join(small(named), "source", "left_semi"), folder), "sizes")
    sums = {r["source"]: r for r in texts.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()}
    if total == "available":
        total = sum(r["n"] for r in sums.values())
    plan = budgets([(g["source"], g["w"], g["r"]) for g in sorted(goal, key=lambda g: g["source"])], {s: r["n"] for s, r in sums.items()}, total)
    ranges = {b.source: max(1, -(-sums[b.source]["c"] // ROWS_PER_RANGE)) if b.source in sums else 1 for b in plan}
    budget_rows = [(b.source, float(b.share or 0), int(b.repeats or 0), b.available, b.budget, b.epochs, b.rest, ranges[b.source]) for b in plan]
    schema = "source string, target_share double, max_repeats int, available_tokens long, budget_tokens long, epochs long, rest long, ranges int"
    budget = small(spark.createDataFrame(budget_rows, schema))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1)
    ranged = texts.join(budget, "source").select("source", "id", "n", "epochs", "rest", key.alias("key"), (F.shiftright(key, 32) * F.col("ranges") / F.lit(2**31)).cast("int").alias("range"))
    taken = cut(_up_to(ranged.withColumn("goal", F.col("rest")).where("goal > 0")), "taken")
    while True:
        sums = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum("n").alias("n")).collect()}
        open_ = [(b.source, b.rest - sums.get(b.source, 0)) for b in plan if b.rest - sums.get(b.source, 0) > CLOSE * b.budget]
        if not open_:
            break
        goal = spark.createDataFrame(open_, "source string, goal long")
        more, n = cut_counted(_up_to(ranged.join(small(goal), "source").where("n <= goal").join(taken.select("source", "id"), ["source", "id"], "left_anti")), "taken")
        if not n:
            break
        taken = taken.unionByName(more)
    last = taken.select("source", "id", F.lit(1).alias("last"))
    copies = F.col("epochs") + F.coalesce("last", F.lit(0))
    chosen = cut(ranged.join(last, ["source", "id"], "left").select("source", "id", "n", copies.cast("int").alias("copies")).where("copies > 0"), "mixture")
    mixed = chosen.select("source", F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), F.col("n").alias("n_tokens"))
    got = chosen.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("actual"), F.max("copies").alias("most"), F.count("*").alias("n_texts"))
    report = budget.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "available_tokens", "budget_tokens",
        F.coalesce("actual", F.lit(0)).alias("actual_tokens"), F.coalesce("most", F.lit(0)).alias("most_copies"),
    )
    # one row per source of the targets
    share = F.coalesce(F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(W.partitionBy()), F.lit(0)), F.lit(0.0))
    return mixed, report.withColumn("actual_share", share)
