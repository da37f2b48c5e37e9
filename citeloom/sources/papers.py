"""Paper collections and their companions from files: JSON in either wrapper, vocabularies, partitions, entities, extractions, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.identifiers import normalize_doi
from citeloom.functions.text import EXTRACTION_FIELDS

PAPER = T.StructType([
    T.StructField("doi", T.StringType()), T.StructField("title", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("publication_year", T.IntegerType()),
    T.StructField("citations", T.IntegerType()), T.StructField("category", T.StringType()), T.StructField("abstract", T.StringType()),
    T.StructField("referenced_works", T.ArrayType(T.StringType())), T.StructField("topics", T.ArrayType(T.VariantType())),
])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def papers_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Papers of JSON texts, each an object with `papers` or a bare array: pos is a paper's place, identifiers are normalised, the year falls back."""
    rows = F.from_json(F.col(column), T.ArrayType(PAPER))
    wrapped = F.from_json(F.col(column), T.StructType([T.StructField("papers", T.ArrayType(PAPER))]))["papers"]
    bare = F.trim(F.col(column)).startswith("[")
    p = raw.select(F.posexplode(F.when(bare, rows).otherwise(wrapped)).alias("pos", "p")).select("pos", "p.*")
    return p.select(
        "pos", normalize_doi(F.col("doi")).alias("doi"), "title", F.coalesce(F.nullif("year", F.lit(0)), F.nullif("publication_year", F.lit(0))).alias("year"), "citations", "category", "abstract",
        F.transform(F.coalesce("referenced_works", F.array().cast("array<string>")), normalize_doi).alias("referenced_works"), "topics",
    )


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return papers_from_json(_texts(spark, path))


def validated(papers: DataFrame) -> DataFrame:
    """The papers with an identifier; an error if there are none."""
    kept = require_columns(papers, "doi", "title").where("doi is not null and doi <> ''")
    if kept.isEmpty():
        raise ValueError("no paper has an identifier")
    return kept


def read_vocabulary(path: str) -> dict[str, list[str]]:
    """A domain vocabulary from YAML, by kind. Vocabulary files are configuration: small, read where the job is planned."""
    import yaml

    with open(path) as f:
        found = yaml.safe_load(f) or {}
    keys = {"methods": "METHOD", "organisms": "ORGANISM", "concepts": "CONCEPT", "datasets": "DATASET"}
    return {kind: [str(t) for t in found.get(k) or []] for k, kind in keys.items()}


def clusters_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """doc_id, cluster_id of a `{doi: id}` object; ids become text."""
    return raw.select(F.explode(F.from_json(column, "map<string,string>")).alias("doc_id", "cluster_id")).withColumn("doc_id", normalize_doi(F.col("doc_id")))


def entities_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """doc_id, entity of a `{doi: [entity]}` object, distinct."""
    rows = raw.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("doc_id", "e"))
    return rows.select(normalize_doi(F.col("doc_id")).alias("doc_id"), F.explode("e").alias("entity")).distinct()


def extractions_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Extractions of a list of objects or of an object by identifier; missing fields are empty."""
    kind = "struct<doi:string," + ",".join(f"{f}:string" for f in EXTRACTION_FIELDS) + ">"
    listed = F.trim(F.col(column)).startswith("[")
    rows = F.from_json(F.when(listed, F.col(column)), f"array<{kind}>")
    keyed = F.transform(F.map_entries(F.from_json(F.when(~listed, F.col(column)), f"map<string,{kind}>")), lambda e: F.struct(e["key"].alias("doi"), *[e["value"][f].alias(f) for f in EXTRACTION_FIELDS]))
    flat = raw.select(F.explode(F.coalesce(rows, keyed)).alias("e")).select("e.*").where("doi is not null")
    return flat.select(normalize_doi(F.col("doi")).alias("doi"), *[F.coalesce(f, F.lit("")).alias(f) for f in EXTRACTION_FIELDS])


def list_from_text(raw: DataFrame, column: str = "value") -> DataFrame:
    """doc_id of a JSON list or of one identifier a line."""
    text = F.trim(F.col(column))
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, r"\s*\n\s*"))
    return raw.select(F.explode(items).alias("doc_id")).where("doc_id <> ''").select(normalize_doi(F.col("doc_id")).alias("doc_id")).distinct()


def optional(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """A table that may be missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def unfinished(batches: DataFrame, finished: DataFrame) -> DataFrame:
    """The batches that no checkpoint has: a resumed job goes on with these."""
    return batches.join(finished.select("batch_id").distinct(), "batch_id", "left_anti")
