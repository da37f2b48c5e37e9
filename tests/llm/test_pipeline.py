"""The pipeline stage by stage against brute force, on the smallest documents with planted cases."""

import corpus_pipeline as pipe
from pyspark.sql import functions as F

from citeloom.llm import decontaminate, entries


def test_stages_take_effect(spark, sf, tmp_path):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    top = base.agg(F.max("doc_id")).first()[0]
    source = base.where("lang = 'en' and n_chars > 1500").orderBy("doc_id").first().text
    near = source.replace(source.split()[40], "changed", 1)
    planted = [(top + 1, "12345 ... !!!", "en", "s", 3), (top + 2, near, "en", "s", len(near)), (top + 3, bench, "en", "s", len(bench)), (top + 4, None, "en", "s", 0)]
    docs = base.unionByName(spark.createDataFrame(planted, base.schema))
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(pipe.STAGES) - 1:
            assert out.columns == base.columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and out.count() == len(kept)
        gone = ids - kept
        if name == "language_id":
            assert gone == {top + 1, top + 4}
        if name == "decontaminate":
            bad = {r.doc_id for r in decontaminate.digest(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
            assert gone == bad
        docs, ids = out, kept
    assert top + 3 not in ids
    rest = docs.where(F.col("doc_id") == top + 2).collect()  # what line dedup left of it, if anything
    assert not rest or len(rest[0].text) < 0.5 * len(near)
    assert docs.where(F.col("n_tokens") != F.size("ids")).count() == 0
    assert len(ids) > 0.5 * base.count()


def test_registry():
    names = set(entries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} and set(entries.oracle_sql()) <= names
    assert 4 <= len(pipe.STAGES) <= 5 and pipe.ORACLE_SQL is None
