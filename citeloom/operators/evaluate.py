"""Comparing partitions and measuring extractions. Pair counts are closed forms over the contingency table, never enumerated pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.stats import average_rank, correlation, pairs_of


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, n over the papers of both memberships."""
    both = a.select("doc_id", F.col("cluster_id").alias("a_id")).join(b.select("doc_id", F.col("cluster_id").alias("b_id")), "doc_id")
    return both.groupBy("a_id", "b_id").agg(F.count("*").alias("n"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: papers, adjusted Rand index and normalised mutual information (arithmetic mean of the entropies)."""
    cells = contingency(a, b)
    rows, cols = cells.groupBy("a_id").agg(F.sum("n").alias("ra")), cells.groupBy("b_id").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0.0)).alias("s"))
    row = rows.agg(F.sum(pairs_of(F.col("ra"))).alias("sa"), F.sum(F.col("ra") * F.ln("ra")).alias("la"), F.count("*").alias("ka"))
    col = cols.agg(F.sum(pairs_of(F.col("cb"))).alias("sb"), F.sum(F.col("cb") * F.ln("cb")).alias("lb"), F.count("*").alias("kb"))
    cell = cells.agg(F.sum(F.col("n") * F.ln("n")).alias("lc"))
    one = total.join(F.broadcast(row)).join(F.broadcast(col)).join(F.broadcast(cell))
    t = F.col("t")
    expected = F.col("sa") * F.col("sb") / pairs_of(t)
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(t < 2, 0.0).when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected))
    ha, hb = F.ln(t) - F.col("la") / t, F.ln(t) - F.col("lb") / t
    mutual = F.ln(t) + (F.col("lc") - F.col("la") - F.col("lb")) / t
    nmi = F.when(t < 1, 0.0).when((F.col("ka") == 1) & (F.col("kb") == 1), 1.0).otherwise(mutual / ((ha + hb) / 2))
    return one.select(t.alias("n_papers"), ari.alias("ari"), nmi.alias("nmi"))


def confidence(membership: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, confidence: the share of the other papers of its cluster that cite it or that it cites; 1 for a cluster of one."""
    sizes = membership.groupBy("cluster_id").agg(F.count("*").alias("size"))
    links = citations.where("src <> dst").select("src", "dst").unionByName(citations.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    m1, m2 = membership.select(F.col("doc_id").alias("src"), F.col("cluster_id").alias("c1")), membership.select(F.col("doc_id").alias("dst"), F.col("cluster_id").alias("c2"))
    inside = links.join(m1, "src").join(m2, "dst").where("c1 = c2").groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("linked"))
    rows = membership.join(sizes, "cluster_id").join(inside, "doc_id", "left")
    return rows.select("doc_id", "cluster_id", F.when(F.col("size") == 1, 1.0).otherwise(F.coalesce("linked", F.lit(0)) / (F.col("size") - 1)).alias("confidence"))


def interpretation(ari: Column) -> Column:
    return F.when(ari > 0.5, "strong").when(ari > 0.2, "moderate").otherwise("weak")


def validation_report(membership: DataFrame, other: DataFrame, citations: DataFrame, least: int = 10) -> DataFrame:
    """One row: agreement with the other partition, its reading, and papers of high, medium and low confidence; under `least` citations `insufficient`."""
    c = confidence(membership, citations).agg(
        F.count_if(F.col("confidence") >= 0.5).alias("high"), F.count_if((F.col("confidence") >= 0.2) & (F.col("confidence") < 0.5)).alias("medium"), F.count_if(F.col("confidence") < 0.2).alias("low")
    )
    known = citations.agg(F.count("*").alias("n_citations"))
    rows = agreement(membership, other).join(F.broadcast(c)).join(F.broadcast(known))
    return rows.select("n_papers", "ari", "nmi", "high", "medium", "low", F.when(F.col("n_citations") < least, "insufficient").otherwise(interpretation(F.col("ari"))).alias("reading"))


def preservation(base: DataFrame, new: DataFrame, least: int = 5, overlap: float = 0.6, jaccard: float = 0.3) -> DataFrame:
    """For each base cluster of some size: the new cluster that holds most of it, the overlap, the Jaccard and whether both suffice."""
    cells = contingency(base, new)
    a, b = base.groupBy(F.col("cluster_id").alias("a_id")).agg(F.count("*").alias("na")), new.groupBy(F.col("cluster_id").alias("b_id")).agg(F.count("*").alias("nb"))
    best = cells.withColumn("rn", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("n"), "b_id"))).where("rn = 1")
    rows = best.join(a.where(F.col("na") >= least), "a_id").join(b, "b_id")
    share, jac = F.col("n") / F.col("na"), F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return rows.select("a_id", "b_id", "na", "n", share.alias("overlap"), jac.alias("jaccard"), ((share >= overlap) & (jac >= jaccard)).alias("preserved"))


def pair_preservation(base: DataFrame, new: DataFrame) -> DataFrame:
    """One row: pairs together in base, those of them together in new, their share."""
    cells = contingency(base, new)
    kept = cells.agg(F.sum(pairs_of(F.col("n"))).alias("kept"))
    all_pairs = cells.groupBy("a_id").agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("pairs"))
    return all_pairs.join(F.broadcast(kept)).select("pairs", "kept", (F.col("kept") / F.col("pairs")).alias("share"))


def same_label(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: common papers, those with the same id in both, their share."""
    return contingency(a, b).agg(F.sum("n").alias("n_papers"), F.sum(F.when(F.col("a_id") == F.col("b_id"), F.col("n")).otherwise(0)).alias("same")).withColumn("share", F.col("same") / F.col("n_papers"))


def migrations(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    return contingency(a, b).where("a_id <> b_id").orderBy(F.desc("n"), "a_id", "b_id").limit(k)


def reassignment(base: DataFrame, new: DataFrame) -> DataFrame:
    """One row: common papers and those outside of their base cluster's majority cluster."""
    cells = contingency(base, new).withColumn("rn", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("n"), "b_id")))
    return cells.agg(F.sum("n").alias("n_papers"), F.sum(F.when(F.col("rn") > 1, F.col("n")).otherwise(0)).alias("moved")).withColumn("moved_share", F.col("moved") / F.col("n_papers"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: total weight and modularity of the partition, from two aggregates."""
    m = membership
    e = edges.join(m.select(F.col("doc_id").alias("src"), F.col("cluster_id").alias("c1")), "src").join(m.select(F.col("doc_id").alias("dst"), F.col("cluster_id").alias("c2")), "dst")
    inside = e.where("c1 = c2").groupBy(F.col("c1").alias("c")).agg(F.sum("weight").alias("l"))
    degree = e.select(F.col("c1").alias("c"), "weight").unionAll(e.select(F.col("c2").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    total = edges.agg(F.sum("weight").alias("m"))
    rows = degree.join(inside, "c", "left").join(F.broadcast(total))
    part = F.coalesce("l", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)
    return rows.agg(F.first("m").alias("m"), F.sum(part).alias("modularity"))


def entity_modularity(doc_entity: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """modularity of the shared-entity graph, without an edge: an entity of df papers, k of them in a cluster, adds df (df - 1) / 2
    to the total weight, k (k - 1) / 2 to the weight inside the cluster, and k (df - 1) to the cluster's degree.

    Every paper with entities must have a cluster."""
    cells = doc_entity.join(membership, "doc_id").groupBy("entity", "cluster_id").agg(F.count("*").alias("k"))
    df = doc_entity.groupBy("entity").agg(F.count("*").alias("df"))
    rows = cells.join(df, "entity").groupBy("cluster_id").agg(F.sum(pairs_of(F.col("k"))).alias("l"), F.sum(F.col("k") * (F.col("df") - 1)).alias("d"))
    total = df.agg(F.sum(pairs_of(F.col("df"))).cast("long").alias("m"))
    part = F.col("l") / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)
    return rows.join(F.broadcast(total)).agg(F.first("m").alias("m"), F.sum(part).alias("modularity"))


def cluster_metrics(membership: DataFrame, major: int = 5) -> DataFrame:
    s = membership.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") >= major).alias("majors"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


def resolution_choice(profile: DataFrame, target: int = 13) -> DataFrame:
    """The resolution whose number of clusters is nearest to the target; the lesser of equals."""
    return profile.orderBy(F.abs(F.col("clusters") - target), "resolution").limit(1)


def plateau(profile: DataFrame, resolution: float) -> DataFrame:
    """Neighbouring points of a resolution profile with one number of clusters, and whether they bracket the choice."""
    w = Window.orderBy("resolution")
    rows = profile.withColumn("upper", F.lead("resolution").over(w)).withColumn("n_upper", F.lead("clusters").over(w)).where("clusters = n_upper")
    return rows.select(F.col("resolution").alias("lower"), "upper", "clusters", F.lit(resolution).between(F.col("resolution"), F.col("upper")).alias("brackets"))


def should_split(size: Column, density: Column, generality: Column) -> Column:
    return (size > 200) & ((density < 0.5) | (generality > 0.7))


def abstract_bias(papers: DataFrame, titles: DataFrame, both: DataFrame) -> DataFrame:
    """One row: mean new entities with and without an abstract, correlation of abstract length and new entities."""
    n = lambda d, k: d.groupBy("doc_id").agg(F.count("*").alias(k))
    rows = papers.join(n(titles, "n_t"), "doc_id", "left").join(n(both, "n_b"), "doc_id", "left")
    new = F.coalesce("n_b", F.lit(0)) - F.coalesce("n_t", F.lit(0))
    size = F.length(F.coalesce("abstract", F.lit("")))
    return rows.agg(F.avg(F.when(size > 0, new)).alias("mean_with"), F.avg(F.when(size == 0, new)).alias("mean_without"), correlation(F.when(size > 0, size.cast("double")), F.when(size > 0, new.cast("double"))).alias("length_corr"))


def fill_rates(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, filled_pct, mean_length (of filled ones)."""
    long = rows.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], fields, "field", "value")
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    return long.groupBy("field").agg((F.avg(filled.cast("int")) * 100).alias("filled_pct"), F.avg(F.when(filled, F.length("value"))).alias("mean_length"))


def coverage(rows: DataFrame, sources: list[str], gate: float = 60.0) -> DataFrame:
    """One row: papers, share of each source, share with any, and whether that reaches the gate."""
    any_of = F.greatest(*[F.coalesce(F.col(s), F.lit(False)) for s in sources])
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int")) * 100
    return rows.agg(F.count("*").alias("n_papers"), *[share(F.col(s)).alias(f"{s}_pct") for s in sources], share(any_of).alias("any_pct")).withColumn("enough", F.col("any_pct") >= gate)


def rho_gate(doc_entity: DataFrame, pairs: DataFrame, least: int = 10) -> DataFrame:
    """One row: papers, pairs, Spearman's rho of entity Jaccard and cosine over the pairs (a, b), and GO if it lies in 0.3 to 0.7."""
    n = doc_entity.groupBy("doc_id").agg(F.count("*").alias("n"))
    a, b = doc_entity.select(F.col("doc_id").alias("a"), "entity"), doc_entity.select(F.col("doc_id").alias("b"), "entity")
    shared = pairs.join(a, "a").join(b, ["b", "entity"]).groupBy("a", "b").agg(F.count("*").alias("s"))
    rows = pairs.join(shared, ["a", "b"], "left").join(n.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
    s = F.coalesce("s", F.lit(0))
    rows = rows.select(F.round(s / (F.col("na") + F.col("nb") - s), 12).alias("jac"), F.round(s / F.sqrt(F.col("na") * F.col("nb")), 12).alias("cos"))
    ranked = rows.select(average_rank(F.col("jac")).alias("x"), average_rank(F.col("cos")).alias("y"))
    one = ranked.agg(F.count("*").alias("n_pairs"), F.coalesce(correlation(F.col("x"), F.col("y")), F.lit(0.0)).alias("rho")).join(F.broadcast(n.agg(F.count("*").alias("n_papers"))))
    verdict = F.when(F.col("n_papers") < least, "SKIP").when(F.col("rho").between(0.3, 0.7), "GO").otherwise("SKIP")
    return one.select("n_papers", "n_pairs", "rho", verdict.alias("verdict"))


def vocabulary_arm(papers: DataFrame, doc_entity: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: coverage of papers by entities, mean entities, clusters, share of singletons."""
    e = papers.select("doc_id").join(doc_entity.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").agg(F.avg(F.col("n").isNotNull().cast("int")).alias("coverage"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_entities"))
    return e.join(F.broadcast(cluster_metrics(membership).select("clusters", (F.col("singletons") / F.col("clusters")).alias("single_share"))))


def go_or_not(measures: DataFrame, criteria: dict[str, float], enough: int) -> DataFrame:
    """measures with the number of criteria met (each a least value of a column) and GO, CONDITIONAL (all but one short) or KILL."""
    met = sum(((F.col(c) >= v).cast("int") for c, v in criteria.items()), F.lit(0))
    return measures.withColumn("met", met).withColumn("verdict", F.when(F.col("met") >= enough, "GO").when(F.col("met") == enough - 1, "CONDITIONAL").otherwise("KILL"))
