"""Failure signals: themes of limitations, cluster roll-ups, removal of templates and near-equal texts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import is_generic, keywords

#: Centroids in a list that vectors meet together.
SHELF = 1000
THEME = "cluster_id string, label string, keywords array<string>, n long, members array<string>, representative string"


def themes(texts: DataFrame, overlap: float = 0.15) -> DataFrame:
    """Themes of a cluster's texts (cluster_id, doc_id, pos, text), taken in order of pos.

    A text that no theme has starts one; each later text whose keywords overlap the theme's growing set enough joins.
    The outcome depends on the order, so a cluster is one task; its rows are what a cluster of papers says, not a corpus."""
    rows = texts.select(F.col("cluster_id").cast("string").alias("cluster_id"), F.col("doc_id").cast("string").alias("doc_id"), "pos", "text", keywords(F.col("text")).alias("words"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pos", "doc_id"])
        rest = [(d, t, set(w)) for d, t, w in zip(frame["doc_id"], frame["text"], frame["words"], strict=True)]
        out = []
        while rest:
            (first, *others), kept = rest, []
            members, grown = [first], set(first[2])
            for x in others:
                union = grown | x[2]
                if union and len(grown & x[2]) / len(union) > overlap:
                    members.append(x)
                    grown = union
                else:
                    kept.append(x)
            rest = kept
            if len(members) > 1:
                counts = Counter(w for m in members for w in m[2])
                top = [w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:4]]
                out.append((frame["cluster_id"].iat[0], " + ".join(top[:3]), top, len(members), [m[0] for m in members], members[0][1]))
        return pd.DataFrame(out, columns=["cluster_id", "label", "keywords", "n", "members", "representative"])

    return rows.groupBy("cluster_id").applyInPandas(run, THEME)


def split_texts(extractions: DataFrame, membership: DataFrame, field: str) -> DataFrame:
    """cluster_id, doc_id, pos, text, generic of the extractions' filled field; of several for one paper the last counts."""
    last = Window.partitionBy(F.lower(F.col("doc_id").cast("string"))).orderBy(F.desc("pos"))
    one = extractions.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    rows = one.join(membership, "doc_id").where(F.trim(F.coalesce(field, F.lit(""))) != "")
    return rows.select("cluster_id", "doc_id", "pos", F.trim(field).alias("text"), is_generic(F.trim(field)).alias("generic"))


def cluster_rates(extractions: DataFrame, membership: DataFrame) -> DataFrame:
    """Per cluster: papers with limits, generic ones, their rate to 3 places, specific open questions."""
    limits = split_texts(extractions, membership, "limits").groupBy("cluster_id").agg(F.count("*").alias("n_with_limits"), F.count_if("generic").alias("n_generic"))
    open_q = split_texts(extractions, membership, "open_questions").groupBy("cluster_id").agg(F.count_if(~F.col("generic")).alias("n_open_questions"))
    papers = extractions.select("doc_id").distinct().join(membership, "doc_id").groupBy("cluster_id").agg(F.count("*").alias("n_papers"))
    rows = papers.join(limits, "cluster_id", "left").join(open_q, "cluster_id", "left").na.fill(0, ["n_with_limits", "n_generic", "n_open_questions"])
    rate = F.when(F.col("n_with_limits") > 0, F.col("n_generic") / F.col("n_with_limits")).otherwise(0.0)
    return rows.select("cluster_id", "n_papers", "n_with_limits", "n_generic", F.round(rate, 3).alias("generic_rate"), "n_open_questions")


def failure_signals(extractions: DataFrame, membership: DataFrame, keep: int = 10, dead: int = 3) -> DataFrame:
    """cluster_rates with the number of limit themes (the first `keep`), question themes, and dead ends: themes of `dead` or more."""
    def of(field: str) -> DataFrame:
        return themes(split_texts(extractions, membership, field).where("not generic").drop("generic"))

    limit = of("limits").groupBy("cluster_id").agg(F.least(F.count("*"), F.lit(keep)).alias("limit_themes"), F.count_if(F.col("n") >= dead).alias("dead_ends"))
    asked = of("open_questions").groupBy("cluster_id").agg(F.least(F.count("*"), F.lit(keep)).alias("question_themes"))
    rates = cluster_rates(extractions, membership).withColumn("cluster_id", F.col("cluster_id").cast("string"))
    return rates.join(limit, "cluster_id", "left").join(asked, "cluster_id", "left").na.fill(0, ["limit_themes", "dead_ends", "question_themes"])


def verdict(signals: DataFrame, focus: list[str]) -> DataFrame:
    """One row of totals and GO, CONDITIONAL or KILL."""
    one = signals.agg(
        F.sum("limit_themes").alias("themes"), F.sum("dead_ends").alias("dead_ends"), F.sum("question_themes").alias("questions"), F.round(F.avg("generic_rate"), 3).alias("generic_rate"),
        F.count_if(F.col("cluster_id").isin(focus) & (F.col("limit_themes") >= 2)).alias("focus_with_themes"),
    )
    return one.withColumn("verdict", F.when(F.col("generic_rate") >= 0.8, "KILL").when((F.col("focus_with_themes") >= 3) & (F.col("questions") >= 5), "GO").otherwise("CONDITIONAL"))


def semantic_dedup(vectors: DataFrame, group: str, threshold: float = 0.85) -> DataFrame:
    """The ids (vec_id) of a group's vectors that stay, taken in order: one goes if it is too alike to one that stayed."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for at in range(0, len(x), 512):  # a block meets all that stayed before it in one product, then its own in turn
            block = x[at : at + 512]
            alike = (block @ x[kept].T >= threshold).any(1) if kept else np.zeros(len(block), bool)
            own = block @ block.T >= threshold
            new: list[int] = []
            for i in np.flatnonzero(~alike).tolist():
                if not own[i, new].any():
                    new.append(i)
            kept += [at + i for i in new]
        return frame.iloc[kept][[group, "vec_id"]]

    return vectors.select(group, "vec_id", "embedding").groupBy(group).applyInPandas(run, vectors.select(group, "vec_id").schema)


def dedup_rates(texts: DataFrame) -> DataFrame:
    """One row: texts, shares that the base and the expanded test leave as specific, and the weighted better of the two."""
    base, more = ~is_generic(F.col("text")), ~is_generic(F.col("text"), expanded=True)
    one = texts.agg(F.count("*").alias("n"), F.avg(base.cast("int")).alias("base_rate"), F.avg(more.cast("int")).alias("expanded_rate"), F.countDistinct(F.when(more, F.lower("text"))).alias("distinct_specific"))
    return one.withColumn("score", 0.6 * F.col("expanded_rate") + 0.4 * F.col("distinct_specific") / F.col("n"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """group, n, centroid: the mean vector."""
    long = vectors.select(group, F.posexplode("embedding").alias("i", "v"))
    mean = long.groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def coherence(vectors: DataFrame, group: str, enough: float = 0.5) -> DataFrame:
    """group, n, the mean cosine of its vectors with its centroid, and whether that is enough."""
    c = centroids(vectors, group)
    rows = vectors.join(c, group).groupBy(group).agg(F.max("n").alias("n"), F.avg(cosine(F.col("embedding"), F.col("centroid"))).alias("mean_cosine"))
    return rows.withColumn("coherent", F.col("mean_cosine") >= enough)


def foreign(vectors: DataFrame, group: str, threshold: float = 0.85) -> DataFrame:
    """Vectors close to the centroid of another group. Centroids lie together in lists of `SHELF`; a vector meets each list, as it must
    meet every centroid, and Spark broadcasts the lists only if they are small."""
    c = centroids(vectors, group)
    shelves = -(-c.count() // SHELF)
    lists = c.groupBy(F.pmod(F.xxhash64(group), F.lit(max(1, shelves))).alias("shelf")).agg(F.collect_list(F.struct(F.col(group).alias("other"), "centroid")).alias("cs"))
    rows = vectors.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, shelves - 1)).cast("long")))).join(lists, "shelf")
    rows = rows.select("vec_id", group, F.explode(F.transform("cs", lambda x: F.struct(x["other"].alias("other"), cosine(F.col("embedding"), x["centroid"]).alias("cos")))).alias("x"))
    return rows.where((F.col("x.other") != F.col(group)) & (F.col("x.cos") >= threshold)).select("vec_id", group, "x.other", "x.cos")


def semantic_themes(vectors: DataFrame, k: int, seed: int = 3) -> DataFrame:
    """vec_id, theme by bisecting k-means: stands in for density clustering of a reduced space, which no library here offers."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("theme"))
