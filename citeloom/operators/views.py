"""The tables behind reports and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overview(summary: DataFrame, k: int = 20) -> DataFrame:
    """The k largest clusters and one row `Others` for the rest."""
    rows = summary.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("size"), "cluster_id")))
    return rows.groupBy(F.when(F.col("rn") <= k, F.col("cluster_id")).otherwise("Others").alias("cluster_id")).agg(F.sum("size").alias("size"))


def drilldown(papers: DataFrame, membership: DataFrame, cluster: str) -> DataFrame:
    return papers.join(membership.where(F.col("cluster_id") == cluster).select("doc_id"), "doc_id", "left_semi").orderBy(F.desc("year"), "doc_id")


def bridge_links(bridges: DataFrame) -> DataFrame:
    """Links with a width and an opacity from their Jaccard."""
    most = bridges.agg(F.max("entity_jaccard").alias("most"))
    return bridges.join(F.broadcast(most)).select("cluster_a", "cluster_b", F.greatest(100 * F.col("entity_jaccard"), F.lit(1.0)).alias("width"), (0.3 + 0.5 * F.col("entity_jaccard") / F.col("most")).alias("alpha"))


def timeline(fits: DataFrame, sizes: DataFrame, years: list[int], rising: int = 7, declining: int = 3) -> DataFrame:
    """For the steepest entities a line max(0, n / years + slope (year - middle))."""
    mid, n = sum(years) / len(years), len(years)
    top = lambda d, k, c: fits.where(F.col("direction") == d).orderBy(c, "entity", "cluster_id").limit(k)
    rows = top("rising", rising, F.desc("slope")).unionByName(top("declining", declining, F.asc("slope"))).join(sizes, "cluster_id")
    return rows.select("cluster_id", "entity", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"), "slope", "n_papers").select("cluster_id", "entity", "year", F.greatest(F.lit(0.0), F.col("n_papers") / n + F.col("slope") * (F.col("year") - mid)).alias("value"))


def heatmap(rows: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Counts of row by column values."""
    return rows.groupBy(row).pivot(column, columns).count().na.fill(0)


def flows(rows: DataFrame, a: str, b: str, k: int = 8) -> DataFrame:
    """Counts from the k commonest values of a to values of b."""
    top = rows.groupBy(a).agg(F.count("*").alias("all")).orderBy(F.desc("all"), a).limit(k)
    return rows.join(F.broadcast(top.select(a)), a, "left_semi").groupBy(a, b).agg(F.count("*").alias("n"))


def colours(membership: DataFrame, palette: int = 20) -> DataFrame:
    """cluster_id, colour number: place in the sorted ids modulo the palette."""
    return membership.select("cluster_id").distinct().select("cluster_id", F.pmod(F.dense_rank().over(Window.orderBy("cluster_id")) - 1, F.lit(palette)).alias("colour"))


def strong_edges(edges: DataFrame, least: int = 2) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def first_rows(rows: DataFrame, order: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(order), *[c for c in rows.columns if c != order]).limit(k)


def briefing(extractions: DataFrame, membership: DataFrame, field: str, k: int = 5) -> DataFrame:
    """cluster_id, value, n: a field's commonest values in each cluster."""
    rows = extractions.join(membership, "doc_id").where(F.trim(F.coalesce(field, F.lit(""))) != "").groupBy("cluster_id", F.col(field).alias("value")).agg(F.count("*").alias("n"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "value"))).where(F.col("rn") <= k).drop("rn")


def shared_methods(extractions: DataFrame, membership: DataFrame, field: str, least: int = 2) -> DataFrame:
    """value, clusters: values that several clusters use."""
    return extractions.join(membership, "doc_id").groupBy(F.col(field).alias("value")).agg(F.countDistinct("cluster_id").alias("clusters")).where(F.col("clusters") >= least)


def report_lines(summary: DataFrame, labels: DataFrame) -> DataFrame:
    """One sentence for each cluster."""
    return summary.join(labels, "cluster_id").select("cluster_id", F.format_string("%s: %d papers; %s", "label", F.col("size"), F.coalesce("top_entities", F.lit("no entities"))).alias("line"))


def landscape(xy: DataFrame, membership: DataFrame) -> DataFrame:
    """doc_id, cluster_id, x, y of every paper, and whether it is the nearest of its cluster to the centre."""
    rows = xy.join(membership, "doc_id").select("doc_id", "cluster_id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
    centre = rows.groupBy("cluster_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    near = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), "doc_id"))
    return rows.join(centre, "cluster_id").withColumn("central", near == 1).drop("cx", "cy")


def decision(summary: DataFrame, bridges: DataFrame) -> DataFrame:
    """Each cluster with its size, its number of bridges and its best one."""
    sides = bridges.select(F.col("cluster_a").alias("cluster_id"), "entity_jaccard").unionAll(bridges.select("cluster_b", "entity_jaccard"))
    links = sides.groupBy("cluster_id").agg(F.count("*").alias("bridges"), F.max("entity_jaccard").alias("best"))
    return summary.select("cluster_id", "size").join(links, "cluster_id", "left").na.fill(0, ["bridges"])


def directory(papers: DataFrame, membership: DataFrame, labels: DataFrame, palette: int = 20) -> DataFrame:
    """The searchable directory: a card for each paper, newest first by `place`, with its cluster's label, colour number, address and key of search.

    A paper without a cluster is `Unassigned`; a cluster without a label is `Cluster id`."""
    ids = colours(membership, palette)
    rows = papers.join(membership, "doc_id", "left").join(labels, "cluster_id", "left").join(ids, "cluster_id", "left")
    label = F.when(F.col("cluster_id").isNull(), "Unassigned").otherwise(F.coalesce("label", F.concat(F.lit("Cluster "), "cluster_id")))
    title = F.coalesce("title", F.lit("Unknown title"))
    return rows.select(
        "doc_id", title.alias("title"), "year", label.alias("cluster_label"), "colour", F.concat(F.lit("https://doi.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.lower(F.concat_ws(" ", title, F.col("doc_id").cast("string"), label)).alias("search_key"),
    )


def searched(cards: DataFrame, words: str, cluster_label: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    """A page of the directory's cards that hold all the words, of one cluster if given, newest first."""
    hits = cards
    for w in words.lower().split():
        hits = hits.where(F.col("search_key").contains(w))
    if cluster_label:
        hits = hits.where(F.col("cluster_label") == cluster_label)
    return hits.orderBy(F.desc_nulls_last("year"), "doc_id").offset(page * size).limit(size)


def novelty_points(gaps: DataFrame, k: int = 10) -> DataFrame:
    """Points of the k least z scores: x is 1 - ratio, y is z, the label names the pair."""
    rows = gaps.orderBy("z", "entity_a", "entity_b", "cluster_id").limit(k)
    return rows.select(F.format_string("%s × %s", "entity_a", "entity_b").alias("label"), "cluster_id", (1 - F.col("ratio")).alias("x"), F.col("z").alias("y"))


def theme_rows(themes: DataFrame) -> DataFrame:
    """Rows of the themes' table: id, up to three keywords, size, coherence to three places, whether it is coherent."""
    words = F.when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, 3), ", ")).otherwise("N/A")
    return themes.select("theme_id", words.alias("label"), "size", F.round("mean_cosine", 3).alias("coherence"), F.when(F.col("coherent"), "Yes").otherwise("No").alias("coherent"))


def bridge_rows(bridges: DataFrame, k: int = 20) -> DataFrame:
    """Rows of the bridges' table: the k of most Jaccard, with their first shared entities."""
    rows = bridges.orderBy(F.desc("entity_jaccard"), "cluster_a", "cluster_b").limit(k)
    return rows.select("cluster_a", "cluster_b", "entity_jaccard", "shared_count", F.array_join(F.slice("shared_entities", 1, 5), ", ").alias("entities"))


def all_views(tables: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    """The views whose tables are there; a missing table leaves its view out."""
    makers = {"overview": (overview, "summary"), "bridges": (bridge_links, "bridges"), "colours": (colours, "membership")}
    return {name: make(tables[need]) for name, (make, need) in makers.items() if tables.get(need) is not None}


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and links of a network page, one JSON object a row."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("cluster_id").alias("group"))).alias("json"))
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("json")))
