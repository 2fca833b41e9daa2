"""The refresh of a register as a stream: every landed batch of listing lines updates the kept register once.

A trigger over what is available makes it an incremental batch job; the checkpoint tells which files were seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pubscope.operators.refresh import diff, keep_last, with_fingerprint
from pubscope.session import cut

STATE = "slug string, fingerprint string, status string, since long, whole boolean, batch long"


def read_landed(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Listing files as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def known(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The register kept so far: the last state of each slug, of the batches before one; empty before the first batch.

    Every batch has a folder of its own. A batch whose number is a power of two keeps the whole state and not its
    changes alone, so that what is read stays within a few times the register, however many batches there were.
    """
    try:
        rows = spark.read.schema(STATE).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "slug string, fingerprint string, status string, batch long")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    newest = rows.where("whole").agg(F.max("batch")).first()[0]
    rows = rows.where((F.col("batch") >= newest) if newest is not None else F.lit(True))
    return keep_last(rows.select("slug", "fingerprint", "status", "since", "batch"), "slug", ["batch"]).select("slug", "fingerprint", "status", F.col("since").alias("batch"))


def apply_batch(batch: DataFrame, number: int, target: str, position: list[str]) -> None:
    """Write the batch's new, changed and withdrawn slugs to the folder of its number.

    A batch that is run again, because it was half written or not yet noted, overwrites its own folder and sees only
    the batches before it, so it ends the same.
    """
    spark = batch.sparkSession
    listing = with_fingerprint(keep_last(batch, "slug", position))
    before = cut(known(spark, target, number), "state")
    changes = diff(listing, before.where("status <> 'withdrawn'")).where("status <> 'unchanged'").join(listing.select("slug", "fingerprint"), "slug", "left")
    rows = changes.select("slug", "fingerprint", "status", F.lit(number).cast("bigint").alias("since"))
    whole = number > 0 and number & (number - 1) == 0
    if whole:
        rows = rows.unionByName(before.join(changes.select("slug"), "slug", "left_anti").select("slug", "fingerprint", "status", F.col("batch").alias("since")))
    rows.withColumn("whole", F.lit(whole)).write.mode("overwrite").parquet(f"{target}/batch={number}")


def refresh_stream(stream: DataFrame, target: str, checkpoint: str, position: list[str]) -> StreamingQuery:
    """Run what is available, batch by batch, each a full listing; the query ends by itself."""
    writer = stream.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, target, position))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_stream(stream: DataFrame, time: str, lateness: str = "30 days", period: str = "1 day") -> DataFrame:
    """Lines per period and type of a stream with late rows: a watermark bounds the state, later rows are dropped."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, period).alias("w"), "document_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "document_type", "n")
