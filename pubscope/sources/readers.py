"""Sources of the register: JSON payloads, landed pages, texts, manifests, word files and request parameters.

Every reader has its schema; nothing is inferred. An unreadable payload reads as an empty one, a malformed record is
left out by itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubscope.functions.text import present
from pubscope.operators.refresh import keep_last
from pubscope.schema import PUBLICATION, SLIM, WORD

_PROJECT = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "url", "kind")])
_UNIT = T.StructType([T.StructField(c, T.StringType()) for c in ("stem", "slug", "label", "url")] + [T.StructField("projects", T.ArrayType(_PROJECT))])


def _first_line(spark: SparkSession, path: str) -> dict | None:
    """The first line of a file or folder if it is a JSON object by itself."""
    line = spark.read.text(path).where("trim(value) <> ''").first()
    try:
        found = json.loads(line["value"]) if line else None
    except ValueError:
        found = None
    return found if isinstance(found, dict) else None


def _records(spark: SparkSession, path: str, schema: T.StructType, field: str) -> DataFrame:
    """position and the records of either form: an object that has them in ``field``, or one record per line (as the sinks write them, read in parallel)."""
    line = _first_line(spark, path)
    if line is not None and field not in line and line.keys() & set(schema.names):
        rows = spark.read.schema(schema).json(path)
        return rows.where(reduce(Column.__or__, [F.col(c).isNotNull() for c in rows.columns])).select(F.monotonically_increasing_id().alias("position"), "*")
    payload = spark.read.schema(T.StructType([T.StructField(field, T.ArrayType(schema))])).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return payload.select(F.posexplode(field).alias("position", "p")).where("p is not null").select(F.col("position").cast("bigint").alias("position"), "p.*")


def required(rows: DataFrame, what: str) -> DataFrame:
    """The rows, or an error if there are none: an empty dataset is never shown or built upon."""
    if rows.isEmpty():
        raise ValueError(f"{what} has no records")
    return rows


def read_register(spark: SparkSession, path: str, require: bool = False) -> DataFrame:
    """The publications of a register, with their position; missing required fields are not yet judged. ``require``: an empty one is an error."""
    rows = _records(spark, path, PUBLICATION, "publications")
    return required(rows, path) if require else rows


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The slim records of a shipped dataset, absent fields as nulls (no authors: an empty list). An empty dataset is an error."""
    rows = required(_records(spark, path, SLIM, "publications").drop("position"), path)
    return rows.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The reusable records of a register: slug and url are there, and of a repeated slug the last counts. A missing file is an empty cache."""
    try:
        rows = read_register(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], T.StructType([T.StructField("position", T.LongType()), *PUBLICATION.fields]))
    valid = rows.where(present(F.col("slug")).isNotNull() & present(F.col("url")).isNotNull())
    return keep_last(valid, "slug", ["position"]).drop("position")


def rejected(rows: DataFrame) -> DataFrame:
    """position, slug, reason of the records that a cache would not reuse."""
    reason = F.when(present(F.col("slug")).isNull(), "slug is missing").when(present(F.col("url")).isNull(), "url is missing")
    return rows.select("position", "slug", reason.alias("reason")).where("reason is not null")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """section, variant, target of the curated aliases; keys that begin with "_" are notes. A missing file has none."""
    schema = "section string, variant string, target string"
    try:
        text = spark.read.text(path, wholetext=True)
        found = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("section", "body"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = found.where(~F.col("section").startswith("_")).select("section", F.explode(F.from_json("body", "map<string,string>")).alias("variant", "target"))
    return rows.where(~F.col("variant").startswith("_"))


def read_texts(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """stem, text of a folder's text files."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.url_decode(stem).alias("stem"), F.col("value").alias("text"))
    return rows.where(~F.col("stem").isin(*exclude)) if exclude else rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The units of a manifest, or None if there is none (then every text counts)."""
    try:
        return _records(spark, path, _UNIT, "units").drop("position")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def member_texts(texts: DataFrame, units: DataFrame | None) -> DataFrame:
    """The texts of the manifest's units; all without a manifest."""
    return texts if units is None else texts.join(units.select("stem"), "stem", "left_semi")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """text, size and the file's stem of word-frequency files."""
    rows = spark.read.schema(WORD).option("multiLine", True).json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_word_frequencies)?\.json$", 1).alias("unit"), "text", "size")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """name, html of landed pages."""
    return spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.url_decode(F.col("_metadata.file_name")).alias("name"), F.col("value").alias("html"))


class WordFiles:
    """The word files of units in a folder, each read once and kept."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.kept = spark, folder, {}  # type: ignore[var-annotated]

    def get(self, unit: str) -> DataFrame:
        if unit not in self.kept:
            self.kept[unit] = required(read_words(self.spark, f"{self.folder}/{unit}_word_frequencies.json"), unit).cache()
        return self.kept[unit]


def whichever(*reads: Callable[[], DataFrame]) -> list[DataFrame | None]:
    """Independent reads, each None where its file is missing or can't be read, so that one doesn't hide the others.

    Reads are lazy, so each is asked for its first row here; other errors than those of reading are raised.
    """
    out: list[DataFrame | None] = []
    for read in reads:
        try:
            rows = read()
            rows.isEmpty()
            out.append(rows)
        except (PySparkException, Py4JJavaError, OSError):
            out.append(None)
    return out


def count_parameter(value: Column, default: int = 75, low: int = 10, high: int = 100) -> Column:
    """A count from a request: an integer clamped to its range, else the default."""
    number = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([+-]?\d{1,9})", 1)
    return F.when(number != "", F.least(F.greatest(number.cast("int"), F.lit(low)), F.lit(high))).otherwise(F.lit(default))


def unit_parameter(value: Column, known: list[str], default: str) -> Column:
    """A unit from a request, if it is a known one."""
    return F.when(value.isin(*known), value).otherwise(F.lit(default))


def known_units(wanted: list[str], known: list[str]) -> list[str]:
    """The wanted units in the known order; unknown ones raise."""
    if unknown := sorted(set(wanted) - set(known)):
        raise ValueError(f"no such unit: {', '.join(unknown)}; there are {', '.join(known)}")
    return [u for u in known if u in wanted]
