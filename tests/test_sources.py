"""Files, store, web source and streams."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators.entities import merged_vocabulary
from citeloom.sources import papers as P
from citeloom.sources import store as S
from citeloom.sources import web as H
from citeloom.streaming import ingest as N


def test_both_wrappers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"papers": [{"doi": "https://doi.org/10.1/A", "title": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"doi": "10.1/b", "title": "y", "publication_year": 2001}]))
    got = {r.doi: r.year for r in P.read_papers(spark, str(tmp_path)).collect()}
    assert got == {"10.1/A": None, "10.1/b": 2001}
    with pytest.raises(ValueError):
        P.validated(spark.createDataFrame([(None, "t")], "doi string, title string"))
    assert P.optional(spark, str(tmp_path / "none")) is None


def test_store_round_trip(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "store"))
    s.save_layer("L0", spark.createDataFrame([("a", "1"), ("b", "2")], "doi string, data string"))
    s.save_layer("L0", spark.createDataFrame([("b", "3")], "doi string, data string"))
    assert {(r.doi, r.data) for r in s.load_layer("L0").collect()} == {("a", "1"), ("b", "3")}
    s.collect("mine", spark.createDataFrame([("a",)], "doi string"))
    s.collect("mine", spark.createDataFrame([("a",), ("z",)], "doi string"))
    assert [(r.name, r.n) for r in s.collections().collect()] == [("mine", 2)]
    assert [r.doi for r in s.export("mine").collect()] == ["a"]
    s.save_index(spark.createDataFrame([("a", "T", 2000, "gold", "xml")], "doi string, title string, year int, oa_status string, method string"))
    s.save_content(spark.createDataFrame([("a", "pdf", b"%PDF-1")], "doi string, kind string, content binary"))
    row = s.index().first()
    assert row.L0 and not row.L1 and bytes(s.load_content("pdf").first().content) == b"%PDF-1"
    with pytest.raises(ValueError):
        s.save_layer("L9", s.load_layer("L0"))


def test_sinks(spark, tmp_path):
    S.write_json_map(spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, cluster_id string"), "doc_id", "cluster_id", str(tmp_path / "map"))
    assert json.loads(spark.read.text(str(tmp_path / "map")).first().value) == {"a": "1", "b": "2"}
    row = spark.createDataFrame([("a", "b", 0.5, 2, 1, 1, ["x", "y"])], "cluster_a string, cluster_b string, entity_jaccard double, shared_count long, unique_a long, unique_b long, shared_entities array<string>")
    S.write_bridges_csv(row, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().shared_entities == "x;y"


def test_web_source_reads_saved_answers(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(H.sample_answer([{"id": f"W{i}", "doi": f"https://doi.org/10.1/{i}", "title": "t", "abstract_inverted_index": {"b": [1], "a": [0]}}]))
    raw = H.read_web(spark, "openalex_dois", ["10.1/0", "10.1/1"], batch="1", fixture=str(tmp_path))
    got = {r.openalex_id: (r.doi, r.abstract) for r in H.works(raw).collect()}
    assert got == {"W0": ("10.1/0", "a b"), "W1": ("10.1/1", "a b")}


def test_entity_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "Yeast and RNA-seq"), (2, "nothing")], "doc_id long, title string").write.parquet(str(src))
    stream = N.stream_entities(spark.readStream.schema("doc_id long, title string").parquet(str(src)), merged_vocabulary())
    N.upsert_entities(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.doc_id, r.entity) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "yeast"), (1, "rna-seq")}


def test_windows_close_behind_the_watermark(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev.write.parquet(str(tmp_path / "ev"))
    q = N.windowed_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.event_type, r.start): r.n for r in spark.table("w").collect()}
    want = {(r.event_type, r.start): r.n for r in ev.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n").collect()}
    assert got and all(want[k] == n for k, n in got.items())
