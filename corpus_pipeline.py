"""The corpus pipeline: documents in, encoded training documents out.

Every stage works on all that the stage before it kept; between stages the documents are written to the
shared folder as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import byte_bpe, decontaminate, language_id, line_dedup, ngram_join
from citeloom.llm.common import discard, materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, by a classifier learned from those that aren't held out."""
    return language_id.keep_identified(docs, language_id.fit(docs.where(~language_id.held_out())))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated windows of lines; those of which nothing is left go."""
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return ngram_join.representatives(docs, 5, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit under a twentieth of the words."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and text, the text being what the ids decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("lang", "source"), decoded_col="decoded")
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]
#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return docs
