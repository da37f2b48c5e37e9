"""The driver's tables as collections of papers, and the same views as SQL for the twins.

parts: a paper is a part, its entities the words of its name, its brand and its type, its references its suppliers.
orders: a paper is an order, its entities those of its parts, its year the order's.
docs: a paper is a document, its title the first line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grown(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that grows: never broadcast, however few bytes its file has (parts compress to 4 bytes a row, and each becomes four entities)."""
    return table(spark, sf_dir, name).hint("merge")


def part_papers(spark, sf) -> DataFrame:
    return _grown(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size") % 20).alias("year"))


def _part_entities(spark, sf) -> DataFrame:
    return _grown(spark, sf, "part").select("p_partkey", F.explode(_names()).alias("entity"))


def _names():
    return F.array_distinct(F.concat(F.coalesce(F.split("p_name", " "), F.array().cast("array<string>")), F.array(F.lower("p_brand"), F.lower("p_type"))))


def part_entities(spark, sf) -> DataFrame:
    return _part_entities(spark, sf).withColumnRenamed("p_partkey", "doc_id")


def part_types(spark, sf) -> DataFrame:
    return _grown(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("cluster_id"))


def part_sizes(spark, sf) -> DataFrame:
    return _grown(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 3).cast("string").alias("cluster_id"))


def part_cells(spark, sf) -> DataFrame:
    """Parts by type and brand: small clusters."""
    return _grown(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws("/", "p_type", "p_brand").alias("cluster_id"))


def part_refs(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("ref")).distinct()


def part_citations(spark, sf) -> DataFrame:
    """A part cites the part whose key is its supplier's."""
    return part_refs(spark, sf).join(part_papers(spark, sf).select(F.col("doc_id").alias("ref")), "ref", "left_semi").select(F.col("doc_id").alias("src"), F.col("ref").alias("dst"))


def order_papers(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))


def order_entities(spark, sf) -> DataFrame:
    """An order's parts meet as one row each; their entities are parted in the order's own group."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p_partkey"))
    both = lines.join(_grown(spark, sf, "part").select("p_partkey", _names().alias("own")), "p_partkey")
    return both.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set("own"))).alias("own")).select("doc_id", F.explode("own").alias("entity"))


def order_segments(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cluster_id"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey").join(c, "o_custkey").select("doc_id", "cluster_id")


def doc_papers(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"), "lang", "source")


def doc_sources(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("cluster_id"))


PE = """pe AS (SELECT DISTINCT doc_id, entity FROM (SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS entity FROM part
  UNION ALL SELECT p_partkey, lower(p_brand) FROM part UNION ALL SELECT p_partkey, lower(p_type) FROM part))"""
PP = "pp AS (SELECT p_partkey AS doc_id, p_name AS title, 1990 + p_size % 20 AS year FROM part)"
PT = "pt AS (SELECT p_partkey AS doc_id, p_type AS cluster_id FROM part)"
PS = "ps AS (SELECT p_partkey AS doc_id, CAST(p_size % 3 AS VARCHAR) AS cluster_id FROM part)"
PC = "pc AS (SELECT p_partkey AS doc_id, p_type || '/' || p_brand AS cluster_id FROM part)"
PR = "pr AS (SELECT DISTINCT l_partkey AS doc_id, l_suppkey AS ref FROM lineitem)"
PX = "px AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part))"
OP = "op AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS year FROM orders)"
OE = PE + ", oe AS (SELECT DISTINCT l_orderkey AS doc_id, entity FROM lineitem JOIN pe ON l_partkey = pe.doc_id)"
OM = "om AS (SELECT o_orderkey AS doc_id, c_mktsegment AS cluster_id FROM orders JOIN customer ON o_custkey = c_custkey)"
DP = "dp AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS abstract, lang, source FROM documents)"
