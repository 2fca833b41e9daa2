from datetime import datetime

from pubscope.streaming.refresh import count_stream, known, read_landed, refresh_stream


def test_landed_listings_update_the_register_once(spark, tmp_path):
    import os

    schema = "slug string, title string, authors string, publisher string, periodical string, pos int"
    landed, target, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    first = spark.createDataFrame([("a", "t", "x", None, None, 1), ("a", "later", "x", None, None, 2), ("b", "t", None, None, None, 3)], schema)
    second = spark.createDataFrame([("a", "later", "x", None, None, 1), ("c", "t", None, None, None, 2)], schema)
    for n, df in enumerate((first, second)):
        df.coalesce(1).write.mode("append").parquet(landed)
        newest = max((os.path.join(landed, f) for f in os.listdir(landed) if f.startswith("part")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + n, 1_700_000_000 + n))
        stream = read_landed(spark, landed, first.schema)
        refresh_stream(stream, target, check, ["pos"]).awaitTermination(120)
    state = {r["slug"]: (r["status"], r["fingerprint"], r["batch"]) for r in known(spark, target).collect()}
    assert state["a"] == ("new", "later | x |  | ", 0) and state["b"][0] == "withdrawn" and state["c"] == ("new", "t |  |  | ", 1)
    refresh_stream(read_landed(spark, landed, first.schema), target, check, ["pos"]).awaitTermination(120)
    assert known(spark, target).count() == 3


def test_late_rows_are_counted_within_the_watermark(spark, tmp_path):
    t = lambda d: datetime(2024, 1, d)
    folder = str(tmp_path / "in")
    spark.createDataFrame([(t(1), "A"), (t(1), "A"), (t(2), "B")], "at timestamp, document_type string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("at timestamp, document_type string").parquet(folder)
    query = count_stream(stream, "at").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["start"].day, r["document_type"], r["n"]) for r in spark.sql("select * from counted").collect()} == {(1, "A", 2), (2, "B", 1)}


def test_a_batch_that_was_half_written_is_written_again(spark, tmp_path):
    from pubscope.streaming.refresh import apply_batch

    schema, target = "slug string, title string, authors string, publisher string, periodical string, pos int", str(tmp_path / "out")
    listings = [[("a", 1), ("b", 1)], [("a", 2), ("c", 1)], [("a", 2), ("c", 1), ("d", 1)], [("a", 3), ("d", 1)], [("a", 3), ("e", 1)], [("a", 3), ("e", 1), ("f", 1)]]
    for n, rows in enumerate(listings):
        df = spark.createDataFrame([(s, f"t{v}", None, None, None, k) for k, (s, v) in enumerate(rows)], schema)
        if n in (1, 4):  # a half of it is there when it is run again
            apply_batch(df.limit(1), n, target, ["pos"])
        apply_batch(df, n, target, ["pos"])
    state = {r["slug"]: (r["status"], r["batch"]) for r in known(spark, target).collect()}
    assert state == {"a": ("changed", 3), "b": ("withdrawn", 1), "c": ("withdrawn", 3), "d": ("withdrawn", 4), "e": ("new", 4), "f": ("new", 5)}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    import os

    folder, t = str(tmp_path / "in"), lambda m, d: datetime(2024, m, d)
    files = [[(t(1, 1), "A"), (t(1, 2), "A")], [(t(6, 1), "A")], [(t(6, 3), "A")], [(t(1, 1), "A"), (t(6, 2), "B")], [(t(9, 1), "C")], [(t(9, 2), "C")]]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, "at timestamp, document_type string").coalesce(1).write.mode("append").parquet(folder)
        newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("part")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("at timestamp, document_type string").option("maxFilesPerTrigger", 1).parquet(folder)
    query = count_stream(stream, "at").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r["start"].month, r["start"].day, r["document_type"]): r["n"] for r in spark.sql("select * from late").collect()}
    assert got[1, 1, "A"] == 1 and got[6, 1, "A"] == 1 and got[6, 2, "B"] == 1  # the late row of 1 January isn't counted
