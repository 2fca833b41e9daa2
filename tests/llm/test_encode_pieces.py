import os
import random

import numpy as np
import pytest

from pubscope.llm import encode as en
from pubscope.llm import encoder as ec
from pubscope.llm import mixture as mx
from pubscope.llm import pieces as pc
from pubscope.session import table

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(ec.TOKENIZERS, ec.BYTE_BPE)), reason="no tokenizer files")
ODD = ["", None, " ", "\n\n\n", "x" * 5000, "a'sn't 'tis", "<|endoftext|> plain", "日本語のテキスト。" * 90, "\U0001f600\U0001f468‍\U0001f469‍\U0001f467" * 60, "a  b \t\r\n c  \n\n\nd" * 60, "é́" * 40, "१२३ 456" * 50, "…—“x”" * 70, " leading", "trailing  ", "word " * 900]


@pytest.fixture(scope="module")
def enc():
    with open(os.path.join(ec.TOKENIZERS, ec.BYTE_BPE), "rb") as f:
        return ec.encoder(f.read())


def whole(enc, t):
    return enc.ids(t).tolist() if t else []


def test_same_ids_as_another_library(enc):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(ec.TOKENIZERS, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for t in filter(None, ODD):
        assert whole(enc, t) == other.encode(t, add_special_tokens=False).ids


def test_ids_decode_to_the_text(enc):
    for t in filter(None, ODD):
        assert b"".join(enc.bpe.decode_single_token_bytes(i) for i in whole(enc, t)).decode() == t


@pytest.mark.parametrize("chunk, overlap", [(16_384, 1_024), (200, 30), (40, 12)])
def test_chunks_give_the_ids_of_the_whole(spark, enc, chunk, overlap):
    rows = [(i, t, "x", [1]) for i, t in enumerate(ODD)] + [(3, ODD[3], "again", [2]), (None, "no id", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, ids array<int>")
    got = sorted(((r["doc_id"], r["ids"]) for r in en.encode_corpus(df, chunk=chunk, overlap=overlap).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = sorted(((i, whole(enc, t)) for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == want


def test_documents(spark, data, enc):
    docs = table(spark, data, "documents")
    got = {r["doc_id"]: r["ids"] for r in en.encode_corpus(docs, chunk=500, overlap=60).collect()}
    assert got == {r["doc_id"]: whole(enc, r["text"]) for r in docs.collect()}
    assert en.encode_corpus(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        en.encode_corpus(docs, chunk=100, overlap=60)


def check_pieces(enc, text, most, overlap):
    got = pc.split(enc, text, most, overlap)
    if len(enc.ids(text)) <= most:
        assert got == []
        return got
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for i, (s, e, n, shared) in enumerate(got):
        assert s < e and n == len(enc.ids(text[s:e]))
        assert n <= most or e - s == 1
        if i:
            assert got[i - 1][0] < s <= got[i - 1][1] < e
            if overlap == 0:
                assert s == got[i - 1][1] and shared == 0
    return got


@pytest.mark.parametrize("most, overlap", [(64, 0), (64, 8), (256, 32), (5, 2), (1, 0), (3, 50)])
def test_pieces_keep_the_limit_and_cover_the_text(enc, most, overlap):
    for t in filter(None, ODD):
        check_pieces(enc, t, most, overlap)


def test_pieces_end_at_sentences_and_edits_stay_local(enc):
    rnd = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit"]
    text = "".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(4, 12))).capitalize() + rnd.choice([". ", ".\n\n"]) for _ in range(900))
    got = check_pieces(enc, text, 200, 16)
    assert all(text[:e].rstrip().endswith(".") for _, e, _, _ in got)
    edited = text[:9000] + "An inserted sentence. " + text[9000:]
    a, b = {text[s:e] for s, e, _, _ in got}, {edited[s:e] for s, e, _, _ in pc.split(enc, edited, 200, 16)}
    assert len(a - b) <= 4
    for s, e, _, shared in got[1:]:
        assert 16 <= shared <= 16 + pc.LONG_UNIT


def test_split_oversized(spark, enc):
    long = "One sentence here. " * 60
    docs = spark.createDataFrame([(1, "a", long, 5), (2, "b", long, 5), (3, None, long, 5), (4, "a", "short", 5), (5, "a", None, 5), (6, "a", "", 5), (7, "z", long, 5)], "doc_id long, source string, text string, piece_no int")
    limits = spark.createDataFrame([("a", 50, 5), ("a", 80, 0), ("b", 0, 5), ("z", 60, None), (None, 9, 1)], "source string, max_tokens int, overlap_tokens int")
    rows = pc.split_oversized(docs, limits).collect()
    assert {r["doc_id"] for r in rows} == {1, 7} and all(r["n_tokens"] <= (50 if r["doc_id"] == 1 else 60) for r in rows)
    for r in rows:
        assert long[r["char_start"] - 1 : r["char_end"]] == r["text"] and 1 <= r["piece_no"] <= r["n_pieces"]
    assert pc.split_oversized(docs.limit(0), limits).count() == 0 and pc.split_oversized(docs, limits.limit(0)).count() == 0


def test_budgets():
    t = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2)]
    free = {b.source: b.budget for b in mx.budgets(t, {"a": 1000, "b": 100})}
    assert free["c"] == 0 and free["b"] == 400 and abs(free["a"] / (free["a"] + free["b"]) - 0.5 / 0.8) < 0.01
    held = {b.source: b.budget for b in mx.budgets(t, {"a": 1000, "b": 100, "c": 50}, 1200)}
    assert held == {"a": 700, "b": 400 - 40 * 1, "c": 100} or sum(held.values()) <= 1200
    assert held["b"] <= 400 and held["c"] <= 100 and held["a"] <= 1000
    assert all(b.budget == 0 for b in mx.budgets(t, {}))


def test_mixture(spark, enc):
    rnd = random.Random(3)
    rows = [(i, "word " * rnd.randint(1, 60) + str(i), "big") for i in range(400)] + [(1000 + i, f"small text {i}", "small") for i in range(5)]
    rows += [(2000, "small text 1", "small"), (2001, None, "big"), (2002, "", "big"), (2003, "x", None), (2004, "other", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 3), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mx.mixture(docs, targets)
    got, rep = mixed.collect(), {r["source"]: r for r in report.collect()}
    text = {i: t for i, t, _ in rows}
    copies = {}
    for r in got:
        assert r["n_tokens"] == len(enc.ids(text[r["doc_id"]]))
        copies.setdefault((r["source"], text[r["doc_id"]]), []).append(r["copy"])
    assert {s for s, _ in copies} == {"big", "small"} and max(map(len, copies.values())) == 3
    assert all(len(c) <= (1 if s == "big" else 3) and sorted(c) == list(range(1, len(c) + 1)) for (s, _), c in copies.items())
    assert abs(rep["big"]["actual_share"] - 0.9) < 0.03 and rep["absent"]["actual_tokens"] == 0
    assert sum(r["n_tokens"] for r in got) == sum(r["actual_tokens"] for r in rep.values())
    assert abs(rep["big"]["actual_tokens"] - rep["big"]["budget_tokens"]) <= 40
    again = {(r["doc_id"], r["copy"]) for r in mx.mixture(docs.repartition(7), targets)[0].collect()}
    assert again == {(r["doc_id"], r["copy"]) for r in got}
    none, empty = mx.mixture(docs.limit(0), targets)
    assert none.count() == 0 and all(r["actual_share"] == 0 for r in empty.collect())


def test_prefixes_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mx, "ROWS_PER_RANGE", 20)
    docs = spark.createDataFrame([(i, f"text number {i} of them", "s") for i in range(300)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    _, report = mx.mixture(docs, targets, total=3000)
    r = report.first()
    assert abs(r["actual_tokens"] - 3000) <= 4 and r["most_copies"] <= 2


def test_stitch_without_a_common_boundary():
    a = (np.arange(5), [], [], [3], [2])
    b = (np.arange(5), [4], [1], [], [])
    assert en.stitch([a, b]) is None
