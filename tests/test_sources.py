import json

import pytest
from pyspark.sql import functions as F

from pubscope.schema import RECORD_FIELDS
from pubscope.sources import crawl, readers, sinks


def test_sparse_round_trip(spark, tmp_path):
    payload = {"source": "s", "document_types": ["A"], "publications": [{"slug": "a", "url": "u", "fingerprint": "f", "extra": 1}, {"slug": "b", "fingerprint": "no url"}, {"slug": "a", "url": "u2", "title": "last"}, {"slug": " ", "url": "u"}]}
    path = tmp_path / "publications.json"
    path.write_text(json.dumps(payload))
    rows = {r["slug"]: r for r in readers.read_cache(spark, str(path)).collect()}
    assert set(rows) == {"a"} and rows["a"]["url"] == "u2" and rows["a"]["title"] == "last" and rows["a"]["authors"] is None
    assert {(r["position"], r["reason"]) for r in readers.rejected(readers.read_register(spark, str(path))).collect()} == {(1, "url is missing"), (3, "slug is missing")}


@pytest.mark.parametrize("text", ["not json", "[1, 2]", '{"publications": 3}', "{}"])
def test_unreadable_caches_are_empty(spark, tmp_path, text):
    path = tmp_path / "p.json"
    path.write_text(text)
    assert readers.read_cache(spark, str(path)).count() == 0


def test_missing_files(spark, tmp_path):
    assert readers.read_cache(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.read_aliases(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.read_manifest(spark, str(tmp_path / "none.json")) is None
    a, b = readers.whichever(lambda: readers.read_words(spark, str(tmp_path / "none.json")), lambda: spark.range(2))
    assert a is None and b.count() == 2


def test_dataset_is_written_in_order_and_without_empties(spark, tmp_path):
    rows = [("b", "u", "", None, [], "T", 2001, None, "P", None, ""), ("a", "u", "t", "s", ["x"], None, None, "J", None, "S", "d")]
    df = spark.createDataFrame(rows, "slug string, url string, title string, subtitle string, authors array<string>, type string, year int, journal string, publisher string, series string, doi string")
    assert sinks.write_dataset(df, str(tmp_path / "dry"), dry_run=True) == 2 and not (tmp_path / "dry").exists()
    texts = []
    for name in ("one", "two"):
        sinks.write_dataset(df, str(tmp_path / name))
        texts.append([p.read_text() for p in sorted((tmp_path / name).glob("part-*.json"))])
    assert texts[0] == texts[1]
    lines = [json.loads(x) for x in texts[0][0].splitlines()]
    assert [x["slug"] for x in lines] == ["a", "b"] and set(lines[1]) == {"slug", "url", "type", "year", "publisher"} <= set(RECORD_FIELDS)


def test_words_texts_and_manifest(spark, tmp_path):
    words = spark.createDataFrame([("b", 2, 2), ("a", 5, 1)], "text string, size long, rank long")
    sinks.write_words(words, str(tmp_path / "w"))
    assert [r["text"] for r in readers.read_words(spark, str(tmp_path / "w")).orderBy(F.desc("size")).collect()] == ["a", "b"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "One.txt").write_text("x\n\ny\n")
    (tmp_path / "t" / "Two.txt").write_text("z")
    assert [r["stem"] for r in readers.read_texts(spark, str(tmp_path / "t"), ("Two",)).collect()] == ["One"]
    (tmp_path / "units.json").write_text(json.dumps({"source": "s", "units": [{"stem": "Two", "projects": [{"title": "p", "kind": "project"}]}]}))
    units = readers.read_manifest(spark, str(tmp_path / "units.json"))
    assert [r["stem"] for r in readers.member_texts(readers.read_texts(spark, str(tmp_path / "t")), units).collect()] == ["Two"]
    unit = spark.createDataFrame([("One", "T", ["a"], [("E", None, True, ["p", "q"])])], "stem string, title string, abstract array<string>, entries array<struct<title:string,url:string,inline:boolean,paragraphs:array<string>>>")
    assert unit.select(sinks.unit_document(F.col("title"), F.col("abstract"), F.col("entries")).alias("d")).first()["d"] == "T\n\na\n\nE\n\np\n\nq\n"
    assert sinks.write_manifest(unit, str(tmp_path / "m"), only=["One"]) == 0 and not (tmp_path / "m").exists()
    assert sinks.write_manifest(unit, str(tmp_path / "m")) == 1 and sinks.write_documents(unit, str(tmp_path / "d")) == 1


def test_aliases(spark, tmp_path):
    path = tmp_path / "aliases.json"
    path.write_text(json.dumps({"_readme": ["x"], "authors": {"_why": "n", "A": "B"}, "series": {}}))
    assert [tuple(r) for r in readers.read_aliases(spark, str(path)).collect()] == [("authors", "A", "B")]


def test_parameters(spark):
    df = spark.createDataFrame([(x,) for x in ("5", "500", "x", None, "42", "9a")], "v string")
    assert [r[0] for r in df.select(readers.count_parameter(F.col("v"))).collect()] == [10, 100, 75, 75, 42, 10]
    assert readers.known_units(["b"], ["a", "b"]) == ["b"]
    with pytest.raises(ValueError, match="no such unit: x"):
        readers.known_units(["x", "a"], ["a", "b"])
    assert spark.range(1).select(readers.unit_parameter(F.lit("q"), ["a"], "all")).first()[0] == "all"


def test_fetcher_retries_waits_and_caches(tmp_path):
    calls, pauses = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return "<p>ok</p>"

    f = crawl.Fetcher(str(tmp_path), delay=0.5, opener=opener, sleep=pauses.append)
    assert f.get("https://x.example/a?b=1") == ("<p>ok</p>", False) and len(calls) == 3
    assert [p for p in pauses if p in (1.0, 2.0)] == [1.0, 2.0]
    assert f.get("https://x.example/a?b=1") == ("<p>ok</p>", True) and len(calls) == 3
    g = crawl.Fetcher(None, attempts=2, opener=lambda u, t: (_ for _ in ()).throw(OSError("no")), sleep=pauses.append)
    with pytest.raises(OSError, match="2 attempts"):
        g.get("https://x.example/")


def test_page_source_reads_landed_pages(spark, tmp_path):
    url = "https://x.example/landed"
    (tmp_path / crawl.cache_file(url)).write_text("<p>kept</p>")
    rows = crawl.fetch_pages(spark, [url], cache=str(tmp_path), delay=0).collect()
    assert [(r["html"], r["from_cache"], r["error"]) for r in rows] == [("<p>kept</p>", True, None)]
    assert readers.read_pages(spark, str(tmp_path)).count() == 1


RECORD = {"slug": "a", "url": "u", "title": "T", "authors": ["X, Y"], "year": 2001, "places": ["P", "Q"], "published_in": {"slug": "v", "title": "V", "authors": ["E"], "role": "Ed."}, "contributions": [{"slug": "c", "title": "C"}], "fingerprint": "f"}


@pytest.mark.parametrize("write", [lambda df, p: sinks.write_json(df, p, ["slug"]), lambda df, p: sinks.write_payload(df, p, ["slug"], source="s", document_types=["A", "B"])])
def test_what_a_sink_writes_its_source_reads(spark, tmp_path, write):
    records = [RECORD, {"slug": "b", "url": "w", "fingerprint": "g"}]
    df = spark.createDataFrame([json.dumps(r) for r in records], "string").select(F.from_json("value", readers.PUBLICATION).alias("r")).select("r.*")
    assert write(df, str(tmp_path / "one")) == 2
    back = readers.read_cache(spark, str(tmp_path / "one")).select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    write(back, str(tmp_path / "two"))
    text = ["".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*"))) for d in ("one", "two")]
    assert text[0] == text[1]  # writing again what was read gives the same bytes


def test_payload_is_one_object(spark, tmp_path):
    df = spark.createDataFrame([json.dumps(RECORD)], "string").select(F.from_json("value", readers.PUBLICATION).alias("r")).select("r.*")
    sinks.write_payload(df, str(tmp_path / "p"), ["slug"], source="s", document_types=["A"])
    found = json.loads("".join(p.read_text() for p in (tmp_path / "p").glob("part-*")))
    assert found == {"source": "s", "document_types": ["A"], "publications": [RECORD]}
    sinks.write_payload(df.limit(0), str(tmp_path / "e"), ["slug"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("part-*"))) == {"publications": []} and readers.read_cache(spark, str(tmp_path / "e")).count() == 0


def test_dataset_and_manifest_round_trip(spark, tmp_path):
    rows = [("a", "u", "t", None, ["x"], None, None, "J", None, "S", "d"), ("b", "u", None, None, [], "T", 2001, None, "P", None, None)]
    df = spark.createDataFrame(rows, readers.SLIM)
    sinks.write_dataset(df, str(tmp_path / "d"))
    assert {tuple(map(str, r)) for r in readers.read_dataset(spark, str(tmp_path / "d")).collect()} == {tuple(map(str, r)) for r in df.collect()}
    assert {r["slug"] for r in readers.read_register(spark, str(tmp_path / "d")).collect()} == {"a", "b"}
    unit = spark.createDataFrame([("One", "one", "T", "https://u", [("E", "/e", False), ("F", None, True)])], "stem string, slug string, title string, url string, entries array<struct<title:string,url:string,inline:boolean>>")
    assert sinks.write_manifest(unit, str(tmp_path / "m"), source="s") == 1
    back = readers.read_manifest(spark, str(tmp_path / "m")).first()
    assert (back["stem"], back["slug"], back["label"], back["url"]) == ("One", "one", "T", "https://u")
    assert [tuple(p) for p in back["projects"]] == [("E", "/e", "project"), ("F", None, "umbrella")]
    with pytest.raises(ValueError, match="no records"):
        readers.read_register(spark, str(tmp_path / "m"), require=True)


def test_word_files_are_read_once(spark, tmp_path):
    (tmp_path / "x_word_frequencies.json").write_text('[{"text": "a", "size": 2}]')
    words = readers.WordFiles(spark, str(tmp_path))
    assert words.get("x").count() == 1 and words.get("x") is words.get("x")


def test_hosts_are_fetched_apart():
    reader = crawl._Reader({"urls": "https://a.x/1\nhttps://b.x/1\nhttps://a.x/2"})
    assert [p.urls for p in reader.partitions()] == [["https://a.x/1", "https://a.x/2"], ["https://b.x/1"]]
