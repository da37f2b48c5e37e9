"""Recommendations: momentum, gap and failure turned into ranks, multiplied, and judged; other score formulas and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.stats import average_rank, correlation, rank_share, rounded


def parent(cluster: Column) -> Column:
    return F.split_part(cluster, F.lit("."), F.lit(1))


def penalties(signals: DataFrame) -> DataFrame:
    """cluster_id, penalty: dead ends against themes, 4 places."""
    return signals.select("cluster_id", F.round(F.col("dead_ends") / (F.col("dead_ends") + F.col("limit_themes") + 1), 4).alias("penalty"))


def _compound(e: Column) -> Column:
    return F.contains(e, F.lit("-")) | F.contains(e, F.lit("/")) | (F.size(F.filter(F.split(e, r"\s+"), lambda w: w != "")) >= 2)


def overused_share(entities: Column, background: list[str] | None = None) -> Column:
    """The share of the first five that are background terms; without a list, that are single plain words."""
    top = F.slice(entities, 1, 5)
    hit = F.filter(top, lambda e: e.isin(background or [""])) if background is not None else F.filter(top, lambda e: ~_compound(e))
    return F.when(F.size(top) == 0, 0.0).otherwise(rounded(F.size(hit) / F.size(top), 3))


def compound_share(entities: Column) -> Column:
    return F.when(F.size(entities) == 0, 0.0).otherwise(rounded(F.size(F.filter(entities, _compound)) / F.size(entities), 3))


def evaluability(otr: Column, ccr: Column) -> Column:
    return F.when((otr <= 0.4) & (ccr >= 0.3), "PASS").when(otr <= 0.6, "CONDITIONAL").otherwise("FAIL")


def bridge_gap(jaccard: Column) -> Column:
    return F.when(jaccard > 0.5, 0.5).when(jaccard < 0.05, 0.3).otherwise(1.0 - F.abs(jaccard - 0.2) * 2)


def _ranked(rows: DataFrame) -> DataFrame:
    """Each of the three raw parts as a share of its rank in the pool, and their product."""
    parts = [("momentum_raw", "r_momentum"), ("gap_raw", "r_gap"), ("inv_failure", "r_inv_failure")]
    rows = rows.withColumn("inv_failure", -F.col("failure_raw"))
    for raw, _ in parts:
        rows = rows.withColumn(raw, rounded(F.col(raw), 12))
    out = rows.select("*", *[rank_share(F.col(raw)).alias(r) for raw, r in parts])
    return out.withColumn("bridge_score", rounded(F.col("r_momentum") * F.col("r_gap") * F.col("r_inv_failure"), 6)).drop("inv_failure")


def _rising(fits: DataFrame) -> DataFrame:
    top = F.row_number().over(Window.partitionBy("cluster_id").orderBy("rank"))
    return fits.where("significant and direction = 'rising'").withColumn("k", top).where("k <= 5").select("cluster_id", "entity")


def intra(gaps: DataFrame, momenta: DataFrame, fits: DataFrame, penalty: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Gaps within the allowed clusters, ranked; rising entities lift the momentum by half."""
    g = gaps.where(F.col("cluster_id").isin(allowed)) if allowed is not None else gaps
    up = _rising(fits).groupBy("cluster_id").agg(F.collect_set("entity").alias("rising"))
    rows = g.join(momenta.select("cluster_id", "momentum"), "cluster_id", "left").join(penalty, "cluster_id", "left").join(up, "cluster_id", "left")
    hit = F.coalesce(F.array_contains("rising", F.col("entity_a")) | F.array_contains("rising", F.col("entity_b")), F.lit(False))
    return _ranked(rows.select(
        "cluster_id", "entity_a", "entity_b", hit.alias("rising_involved"), (F.coalesce("momentum", F.lit(0.0)) * F.when(hit, 1.5).otherwise(1.0)).alias("momentum_raw"),
        F.greatest(F.lit(0.0), 1.0 - F.col("ratio")).alias("gap_raw"), F.coalesce("penalty", F.lit(0.0)).alias("failure_raw"),
    ))


def cross(bridges: DataFrame, momenta: DataFrame, penalty: DataFrame, allowed: list[str] | None = None, background: list[str] | None = None, leaf: bool = False) -> DataFrame:
    """Bridges with a side in an allowed parent cluster, ranked, with their shares of overused and compound entities. leaf keeps pairs of different parents."""
    b = bridges.where(parent(F.col("cluster_a")).isin(allowed) | parent(F.col("cluster_b")).isin(allowed)) if allowed is not None else bridges
    b = b.where(parent(F.col("cluster_a")) != parent(F.col("cluster_b"))) if leaf else b
    for side in ("a", "b"):
        b = b.join(momenta.select(F.col("cluster_id").alias(f"cluster_{side}"), F.col("momentum").alias(f"m_{side}")), f"cluster_{side}", "left")
        b = b.join(penalty.select(F.col("cluster_id").alias(f"cluster_{side}"), F.col("penalty").alias(f"p_{side}")), f"cluster_{side}", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = _ranked(b.select(
        "cluster_a", "cluster_b", "entity_jaccard", "shared_entities", ((zero("m_a") + zero("m_b")) / 2).alias("momentum_raw"), bridge_gap(F.col("entity_jaccard")).alias("gap_raw"), ((zero("p_a") + zero("p_b")) / 2).alias("failure_raw")
    ))
    otr, ccr = overused_share(F.col("shared_entities"), background or None), compound_share(F.col("shared_entities"))
    return rows.select("*", otr.alias("otr"), ccr.alias("ccr"), evaluability(otr, ccr).alias("evaluability"))


def recommendations(within: DataFrame, between: DataFrame, top: int | None = None) -> DataFrame:
    """Both pools in one list, best first."""
    a = within.withColumn("kind", F.lit("intra_cluster")).withColumn("item", F.concat_ws("|", "cluster_id", "entity_a", "entity_b"))
    b = between.withColumn("kind", F.lit("cross_cluster")).withColumn("item", F.concat_ws("|", "cluster_a", "cluster_b"))
    rows = a.unionByName(b, allowMissingColumns=True).orderBy(F.desc("bridge_score"), "kind", "item")
    return rows.limit(top) if top else rows


def product_score(momentum: Column, gap: Column, failure: Column) -> Column:
    return momentum * gap * (1 - failure)


def geometric_score(momentum: Column, gap: Column, failure: Column, weights: tuple[float, float, float]) -> Column:
    """Weighted geometric mean with floors."""
    a, b, c = weights
    return F.round(F.pow(F.greatest(momentum, F.lit(1e-10)), F.lit(a)) * F.pow(F.greatest(gap, F.lit(0.01)), F.lit(b)) * F.pow(F.greatest(1 - failure, F.lit(1e-10)), F.lit(c)), 6)


def weights_from(rhos: list[float]) -> tuple[float, ...]:
    """Inverse rank correlations as weights, 4 places."""
    inverse = [1.0 / max(r, 0.01) for r in rhos]
    return tuple(round(x / sum(inverse), 4) for x in inverse)


def sensitivity(pool: DataFrame) -> DataFrame:
    """One row: rank correlation of the product score with itself when a part is fixed at its median, for each part."""
    med = pool.agg(*[F.median(c).alias(f"med_{c}") for c in ("momentum", "gap", "failure")])
    m, g, f = (F.col(c) for c in ("momentum", "gap", "failure"))
    rows = pool.join(F.broadcast(med)).select(*[F.round(s, 12).alias(n) for n, s in (
        ("full", product_score(m, g, f)), ("momentum", product_score(F.col("med_momentum"), g, f)), ("gap", product_score(m, F.col("med_gap"), f)), ("failure", product_score(m, g, F.col("med_failure")))
    )])
    ranks = rows.select(*[average_rank(F.col(n)).alias(n) for n in rows.columns])
    return ranks.agg(*[F.round(F.coalesce(correlation(F.col("full"), F.col(n)), F.lit(0.0)), 4).alias(f"rho_{n}") for n in ("momentum", "gap", "failure")])


def top_changes(old: DataFrame, new: DataFrame, k: int = 10) -> DataFrame:
    """One row: how many of the first k items (item, score) differ."""
    first = lambda d: d.orderBy(F.desc("score"), "item").limit(k).select("item")
    a, b = first(old), first(new)
    gone = a.join(b, "item", "left_anti").agg(F.count("*").alias("gone"))
    return gone.join(F.broadcast(b.join(a, "item", "left_anti").agg(F.count("*").alias("come")))).select(F.floor((F.col("gone") + F.col("come")) / 2).alias("changed"))


def kendall(rows: DataFrame) -> DataFrame:
    """One row: tau-b of columns x and y of a short list, by its pairs."""
    a, b = rows.alias("a"), rows.alias("b")
    p = a.join(b, F.col("a.item") < F.col("b.item")).select(F.signum(F.col("a.x") - F.col("b.x")).alias("sx"), F.signum(F.col("a.y") - F.col("b.y")).alias("sy"))
    return p.agg((F.sum(F.col("sx") * F.col("sy")) / F.sqrt(F.sum(F.abs("sx")) * F.sum(F.abs("sy")))).alias("tau"))


def variation_gate(values: DataFrame, least: float) -> DataFrame:
    """One row: coefficient of variation and whether it is enough."""
    return values.agg((F.stddev_pop("value") / F.avg("value")).alias("cv")).withColumn("passes", F.col("cv") >= least)


def embedding_gap(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """entity_a, entity_b, gap: the cosine distance of the two entities' vectors."""
    from citeloom.operators.failures import cosine

    a, b = vectors.select(F.col("entity").alias("entity_a"), F.col("embedding").alias("va")), vectors.select(F.col("entity").alias("entity_b"), F.col("embedding").alias("vb"))
    return pairs.join(a, "entity_a").join(b, "entity_b").select("entity_a", "entity_b", (1 - cosine(F.col("va"), F.col("vb"))).alias("gap"))


def prevalence_overuse(bridges: DataFrame, doc_entity: DataFrame, share: float = 0.1) -> DataFrame:
    """cluster_a, cluster_b, otr: the share of the first five shared entities that a tenth of all papers name."""
    n = doc_entity.agg(F.countDistinct("doc_id").alias("n"))
    common = doc_entity.groupBy("entity").agg(F.count("*").alias("df")).join(F.broadcast(n)).where(F.col("df") >= share * F.col("n")).select("entity")
    top = bridges.select("cluster_a", "cluster_b", F.explode(F.slice("shared_entities", 1, 5)).alias("entity")).join(common.withColumn("hit", F.lit(1)), "entity", "left")
    return top.groupBy("cluster_a", "cluster_b").agg(rounded(F.avg(F.coalesce("hit", F.lit(0))), 3).alias("otr"))


def compare_bridges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: pairs in both lists, and the share of each list with an overuse of 0.4 at most."""
    both = old.select("cluster_a", "cluster_b", F.col("otr").alias("otr_old")).join(new.select("cluster_a", "cluster_b", F.col("otr").alias("otr_new")), ["cluster_a", "cluster_b"])
    return both.agg(F.count("*").alias("pairs"), F.avg((F.col("otr_old") <= 0.4).cast("int")).alias("old_pass"), F.avg((F.col("otr_new") <= 0.4).cast("int")).alias("new_pass"))
