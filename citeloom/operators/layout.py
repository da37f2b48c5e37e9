"""Layouts of papers: principal components of the entity matrix in place of manifold methods, which no library here offers."""

from __future__ import annotations

from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.scratch import fresh_folder


def embed(papers: DataFrame, doc_entity: DataFrame, k: int = 2, seed: int = 42, columns: int = 2048) -> DataFrame:
    """doc_id, xy array<double>: k principal components of the papers' entity rows; papers without entities lie near the mean.

    Every entity counts: entities are hashed to `columns` columns, so that the covariance matrix has one size whatever the vocabulary's."""
    rows = doc_entity.groupBy("doc_id").agg(F.collect_list("entity").alias("entities"))
    if rows.limit(2).count() < 2:
        raise ValueError("a layout needs two papers with entities")
    x = HashingTF(inputCol="entities", outputCol="v", binary=True, numFeatures=columns).transform(rows)
    xy = PCA(k=k, inputCol="v", outputCol="p").fit(x).transform(x).select("doc_id", vector_to_array("p").alias("xy"))
    mean = xy.agg(F.array(*[F.avg(F.col("xy")[i]) for i in range(k)]).alias("mean"), F.array(*[F.coalesce(F.stddev(F.col("xy")[i]), F.lit(0.0)) for i in range(k)]).alias("sd"))
    # A hash of the paper, not of its partition, so that a layout is the same each time.
    noise = lambda i: (F.pmod(F.xxhash64("doc_id", F.lit(seed + i)), F.lit(20_001)) / 10_000) - 1
    near = F.array(*[F.col("mean")[i] + 0.01 * F.col("sd")[i] * noise(i) for i in range(k)])
    return papers.select("doc_id").join(xy, "doc_id", "left").join(F.broadcast(mean)).select("doc_id", F.coalesce("xy", near).alias("xy"))


def cached(papers: DataFrame, doc_entity: DataFrame, folder: str, k: int = 2, seed: int = 42) -> DataFrame:
    """embed's rows from a table under folder, kept under a digest of the papers, their entities and the parameters; computed where it isn't there."""
    spark = papers.sparkSession
    a = papers.agg(F.count("*"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)"))).first()
    b = doc_entity.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "entity").cast("decimal(38,0)"))).first()
    path = f"{folder.rstrip('/')}/layout-{'-'.join(str(x or 0).replace('-', 'm') for x in (*a, *b, k, seed))}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        embed(papers, doc_entity, k, seed).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_folder(spark) -> str:
    return fresh_folder(spark, "layouts")


def bubbles(xy: DataFrame, membership: DataFrame, papers: DataFrame) -> DataFrame:
    """cluster_id, n, centre, size max(20, 8 sqrt n), year range."""
    rows = xy.join(membership, "doc_id").join(papers.select("doc_id", "year"), "doc_id", "left")
    return rows.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.avg(F.col("xy")[0]).alias("x"), F.avg(F.col("xy")[1]).alias("y"), F.greatest(F.lit(20.0), 8 * F.sqrt(F.count("*"))).alias("size"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
