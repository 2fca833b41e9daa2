"""Session helpers: table access, lineage cuts in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes of their values, that a side may have to be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

_OWN_DIRS: dict[str, str] = {}
_SCRATCH: set[str] = set()


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pubscope") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PUBSCOPE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="pubscope-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return _OWN_DIRS[app]


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes with the application."""
    path = f"{checkpoint_root(spark)}/pubscope/{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    """Delete a folder on any file system; what can't be deleted stays."""
    try:
        files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        files.delete_dir(at)
    except (OSError, ValueError, pa.ArrowException):
        pass


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that were cut so far, once the results that read them have been written."""
    _remove(scratch(spark))


def cut_counted(df: DataFrame, label: str = "cut") -> tuple[DataFrame, int]:
    """``cut``, and the number of rows, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the written files, so the loss of an executor costs no recomputation of what came before;
    being parquet, the table is compressed, can be pruned by column, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_large(df: DataFrame, label: str = "cut") -> DataFrame:
    """``cut`` of a table that grows with the input: joins shuffle it, unless it is counted first (``small``).

    The planner takes a table for as large as its files, which are compressed, so what it broadcasts unasked may be many
    times its threshold, all of it in the driver's memory.
    """
    return cut(df, label).hint("merge")


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows and ``most`` bytes, else unchanged (Spark then shuffles).

    ``df`` should be cheap to count: a cut table or a bounded aggregate. Bytes are those of its rows as text.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, width = df.limit(limit + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= limit and width <= most else df
