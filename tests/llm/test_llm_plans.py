"""What the plans of the text queries must not have, those of the tables they cut among them."""

import pytest

from pubscope.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p6_found", "p7_ids", "p8_mixture", "p9_pieces"])
def test_no_product_of_two_tables(spark, data, monkeypatch, name):
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    plans.append(QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString())
    assert all("CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "BatchEvalPython" not in p for p in plans)


@pytest.mark.parametrize("name", ["p6_found", "p6_checked"])
def test_no_growing_table_is_broadcast_unasked(spark, data, monkeypatch, name):
    from pyspark.sql import DataFrameWriter
    from pyspark.sql import functions as F

    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(F, "broadcast", lambda df: df)  # what is left is the planner's own choice
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plans.append(QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 20 and not [p for p in plans if "BroadcastExchange" in p]


def test_equal_long_texts_come_as_often_as_they_are_there(spark):
    from pubscope.llm.encode import decode_corpus, encode_corpus

    text = "Some words of a text that is repeated. " * 40
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text + "x")], "doc_id long, text string")
    got = encode_corpus(docs, chunk=400, overlap=50)
    back = sorted(((r["doc_id"] or 0, r["text"]) for r in decode_corpus(got).collect()))
    assert back == [(0, text), (0, text + "x"), (1, text), (1, text), (2, text)]


def test_mixture_passes_over_a_text_that_is_too_long(spark):
    from pubscope.llm.mixture import mixture

    docs = spark.createDataFrame([(k, f"short text {k}", "s") for k in range(200)] + [(1000 + k, "long " * 5000 + str(k), "s") for k in range(3)] + [(2000 + k, f"other text {k}", "t") for k in range(200)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 1)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixture(docs, targets)[1].collect()}
    assert abs(report["s"]["actual_share"] - 0.5) < 0.01
    full = {r["source"]: r for r in mixture(docs, targets, "available")[1].collect()}
    assert full["t"]["most_copies"] == 1 and full["s"]["actual_tokens"] == full["s"]["available_tokens"]
