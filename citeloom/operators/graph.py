"""The shared-entity graph: edges, hubs, reach, walks. Pairs come from an inverted index, never from a loop over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.scratch import written


#: Papers of an entity that meet in one join group; an entity of more is cut into blocks, and pairs of blocks meet.
BLOCK = 2000


def meet(rows: DataFrame, keys: list[str], node: str, block: int = BLOCK) -> DataFrame:
    """keys, src, dst: each pair of nodes, src < dst, that have the keys in common.

    A key that very many nodes have is cut into blocks by a hash of the node; every pair of blocks is a join group of its
    own, so that no task gets all pairs of one key, whatever its size."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = rows.select(*keys, F.col(node).alias("node")).join(sizes, keys).withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")))
    low = placed.select(*keys, F.col("node").alias("a"), F.col("at").alias("bi"), F.explode(F.sequence(F.col("at"), F.col("blocks") - 1)).alias("bj"))
    high = placed.select(*keys, F.col("node").alias("b"), F.col("at").alias("bj"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("at"))).alias("bi"))
    both = low.join(high, [*keys, "bi", "bj"]).where(F.when(F.col("bi") == F.col("bj"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return both.select(*keys, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def _pairs(doc_entity: DataFrame) -> DataFrame:
    return meet(doc_entity, ["entity"], "doc_id").select("src", "dst", "entity")


def _classes(doc_entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers of one entity set are one class: (node, own, n) with the set and the number of its papers, and (node, doc_id) with them; node is the least."""
    sets = doc_entity.groupBy("doc_id").agg(F.array_sort(F.collect_set("entity")).alias("own"))
    classes = sets.groupBy("own").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    return classes.select("node", "own", "n"), sets.join(classes, "own").select("node", "doc_id")


#: Papers of a class that travel in one row.
CHUNK = 512


def _expanded(between: DataFrame, within: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst, weight of papers: weights of pairs of classes for all their papers, and a class's own weight for the pairs inside it.

    A class's papers meet another's as lists of up to CHUNK; the pairs are made where two lists have met, so no pair is shuffled."""
    sizes = members.groupBy("node").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    lists = members.join(sizes, "node").groupBy("node", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).alias("at")).agg(F.collect_list("doc_id").alias("docs"))
    a, b = lists.select(F.col("node").alias("src"), F.col("at").alias("ai"), F.col("docs").alias("xs")), lists.select(F.col("node").alias("dst"), F.col("at").alias("bi"), F.col("docs").alias("ys"))
    outer = between.join(a, "src").join(b, "dst").select(F.explode("xs").alias("x"), "ys", "weight").select("x", F.explode("ys").alias("y"), "weight")
    own = within.withColumnRenamed("node", "src").join(a, "src").join(b, (F.col("src") == F.col("dst")) & (F.col("ai") <= F.col("bi")))
    inner = own.select(F.explode("xs").alias("x"), "ys", "weight", (F.col("ai") == F.col("bi")).alias("same")).select("x", F.explode("ys").alias("y"), "weight", "same").where(~F.col("same") | (F.col("x") < F.col("y"))).drop("same")
    return outer.unionByName(inner).select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "weight")


def _distribution(between: DataFrame, within: DataFrame, classes: DataFrame) -> DataFrame:
    """weight, edges: how many pairs of papers have a weight; the same pairs as _expanded's, multiplied out instead of made."""
    n = classes.select("node", "n")
    outer = between.join(n.select(F.col("node").alias("src"), F.col("n").alias("na")), "src").join(n.select(F.col("node").alias("dst"), F.col("n").alias("nb")), "dst").select("weight", (F.col("na") * F.col("nb")).alias("edges"))
    inner = within.join(n, "node").select("weight", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("edges")).where("edges > 0")
    return outer.unionByName(inner).groupBy("weight").agg(F.sum("edges").alias("edges"))


def _items(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("node").alias("doc_id"), F.explode("own").alias("entity"))


def _shared(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights of pairs of classes and inside classes: the entities in common."""
    return _pairs(_items(classes)).groupBy("src", "dst").agg(F.count("*").alias("weight")), classes.select("node", F.size("own").cast("long").alias("weight"))


def shared_edges(doc_entity: DataFrame, max_df: int | None = None) -> DataFrame:
    """src < dst and the number of entities that both have. max_df leaves out entities of more papers; by default none.

    Weights are counted for pairs of entity sets; papers of equal sets only multiply the rows, not the counting."""
    if max_df:
        doc_entity = doc_entity.join(doc_entity.groupBy("entity").count().where(F.col("count") <= max_df), "entity", "left_semi")
    classes, members = _classes(doc_entity)
    return _expanded(*_shared(classes), members)


def stars(doc_entity: DataFrame) -> DataFrame:
    """src, dst: an edge from each paper to the least paper of each of its entities; papers hang together as in shared_edges, by a row a mention."""
    least = doc_entity.groupBy("entity").agg(F.min("doc_id").alias("dst"))
    return doc_entity.join(least, "entity").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()


def twins(doc_entity: DataFrame, resolution: float = 1.0, scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The shared-entity graph with papers that no best partition parts as one node: (node, doc_id), and src <= dst, weight of nodes.

    Papers of one entity set have the same neighbours, degree d and weight w to each other. If two of them were in different communities, moving
    either to the other's would change the modularity by amounts that add up to a multiple of w - resolution * d * d / 2m, m being the
    graph's weight: where that is positive, one of the moves is a gain. Papers of the other sets stay nodes of their own.

    scope names columns of doc_entity by which there is a graph each; the edges keep them."""
    sets = doc_entity.groupBy(*scope, "doc_id").agg(F.array_sort(F.collect_set("entity")).alias("own"))
    classes = sets.groupBy(*scope, "own").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    items = classes.select(*scope, "node", "n", F.explode("own").alias("entity"))
    degree = items.join(items.groupBy(*scope, "entity").agg(F.sum("n").alias("df")), [*scope, "entity"]).groupBy(*scope, "node", "n").agg(F.sum(F.col("df") - 1).alias("d"))
    twice = degree.groupBy(*scope).agg(F.sum(F.col("n") * F.col("d")).alias("twice"))
    d = F.col("d").cast("double")
    known = classes.join(degree.drop("n"), [*scope, "node"])
    known = known.join(twice, [*scope]) if scope else known.join(F.broadcast(twice))
    one = known.select(*scope, "own", "node", (F.size("own") * F.col("twice") > resolution * d * d).alias("one"))
    members = written(sets.join(one, [*scope, "own"]).select(*scope, F.when(F.col("one"), F.col("node")).otherwise(F.col("doc_id")).alias("node"), "doc_id", "own"), "twins")
    nodes = members.groupBy(*scope, "node").agg(F.count("*").alias("n"), F.first("own").alias("own"))
    n = nodes.select("node", "n")
    pairs = meet(nodes.select(*scope, "node", F.explode("own").alias("entity")), [*scope, "entity"], "node").groupBy(*scope, "src", "dst").agg(F.count("*").alias("weight"))
    pairs = pairs.join(n.select(F.col("node").alias("src"), F.col("n").alias("na")), "src").join(n.select(F.col("node").alias("dst"), F.col("n").alias("nb")), "dst")
    inside = nodes.where("n > 1").select(*scope, F.col("node").alias("src"), F.col("node").alias("dst"), (F.size("own") * F.col("n") * (F.col("n") - 1) / 2).alias("weight"))
    return members.select("node", "doc_id"), written(pairs.select(*scope, "src", "dst", (F.col("weight") * F.col("na") * F.col("nb")).cast("double").alias("weight")).unionByName(inside), "graph")


def strong_edges(doc_entity: DataFrame, least: int) -> DataFrame:
    """The edges of shared_edges with a weight of `least` or more, without building the weaker ones.

    In an order of entities from rare to common, two papers that share enough have one of each other's first n - least + 1
    in common: only these entities make candidates, so the commonest bring few papers together. Papers of equal sets are one class."""
    classes, members = _classes(doc_entity)
    df = doc_entity.groupBy("entity").agg(F.count("*").alias("df"))
    large = classes.where(F.size("own") >= least)
    sets = _items(large).join(df, "entity").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "entity"))).alias("x"))
    sets = sets.select("doc_id", F.transform("x", lambda e: e["entity"]).alias("own"))
    heads = sets.select("doc_id", F.explode(F.slice("own", F.lit(1), F.size("own") - (least - 1))).alias("entity"))
    found = meet(heads, ["entity"], "doc_id").select("src", "dst").distinct()
    both = found.join(sets.select(F.col("doc_id").alias("src"), F.col("own").alias("x")), "src").join(sets.select(F.col("doc_id").alias("dst"), F.col("own").alias("y")), "dst")
    between = both.select("src", "dst", F.size(F.array_intersect("x", "y")).cast("long").alias("weight")).where(F.col("weight") >= least)
    return _expanded(between, large.select("node", F.size("own").cast("long").alias("weight")), members)


def shared_distribution(doc_entity: DataFrame) -> DataFrame:
    """weight, edges: how many pairs share so many entities. Papers of equal entity sets are one class first, so pairs are of classes."""
    classes, _ = _classes(doc_entity)
    return _distribution(*_shared(classes), classes)


def _union_size(between: DataFrame, classes: DataFrame, shared: str) -> DataFrame:
    """between with `whole`, the size of both sets together."""
    n = classes.select("node", F.size("own").alias("n"))
    both = between.join(n.select(F.col("node").alias("src"), F.col("n").alias("na")), "src").join(n.select(F.col("node").alias("dst"), F.col("n").alias("nb")), "dst")
    return both.withColumn("whole", F.col("na") + F.col("nb") - F.col(shared))


def _jaccard(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    between = _union_size(_shared(classes)[0].withColumnRenamed("weight", "s"), classes, "s")
    return between.select("src", "dst", (F.col("s") / F.col("whole")).alias("weight")), classes.select("node", F.lit(1.0).alias("weight"))


def jaccard_edges(doc_entity: DataFrame) -> DataFrame:
    classes, members = _classes(doc_entity)
    return _expanded(*_jaccard(classes), members)


def jaccard_distribution(doc_entity: DataFrame) -> DataFrame:
    """weight, edges of jaccard_edges, counted for pairs of classes."""
    classes, _ = _classes(doc_entity)
    return _distribution(*_jaccard(classes), classes)


def _dampened(doc_entity: DataFrame, classes: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    n = doc_entity.agg(F.countDistinct("doc_id").alias("papers"))
    df = doc_entity.groupBy("entity").agg(F.count("*").alias("df")).join(F.broadcast(n))
    worth = df.select("entity", F.when(F.col("df") > F.floor(share * F.col("papers")), 1 / F.log2(F.col("df") + 1)).otherwise(1.0).alias("worth"))
    entities = _items(classes)
    between = _pairs(entities).join(worth, "entity").groupBy("src", "dst").agg(F.sum("worth").alias("w"), F.count("*").alias("s"))
    between = _union_size(between, classes, "s").select("src", "dst", (F.col("w") / F.col("whole")).alias("weight"))
    return between, entities.join(worth, "entity").groupBy(F.col("doc_id").alias("node")).agg((F.sum("worth") / F.count("*")).alias("weight"))


def dampened_edges(doc_entity: DataFrame, share: float = 0.2) -> DataFrame:
    """Jaccard weights in which entities of many papers count 1 / log2(df + 1)."""
    classes, members = _classes(doc_entity)
    return _expanded(*_dampened(doc_entity, classes, share), members)


def dampened_distribution(doc_entity: DataFrame, share: float = 0.2) -> DataFrame:
    """weight, edges of dampened_edges, counted for pairs of classes."""
    classes, _ = _classes(doc_entity)
    return _distribution(*_dampened(doc_entity, classes, share), classes)


def edge_origin(titles: DataFrame, both: DataFrame) -> DataFrame:
    """origin, n: edges from titles alone, new with abstracts, or mixed. Papers alike in both ways are one class, and pairs of classes are counted."""
    tagged = titles.select("doc_id", "entity", F.lit("t").alias("way")).unionByName(both.select("doc_id", "entity", F.lit("b").alias("way")))
    classes, _ = _classes(tagged.select("doc_id", F.struct("way", "entity").alias("entity")))
    met = meet(classes.select("node", F.explode("own").alias("x")).select("node", "x.way", "x.entity"), ["way", "entity"], "node")
    between = met.groupBy("src", "dst").agg(F.count_if(F.col("way") == "t").alias("w_title"), F.count_if(F.col("way") == "b").alias("w_both"))
    own = lambda way: F.size(F.filter("own", lambda x: x["way"] == way)).cast("long")
    weight = F.struct("w_title", "w_both").alias("weight")
    counted = _distribution(between.select("src", "dst", weight), classes.select("node", own("t").alias("w_title"), own("b").alias("w_both")).select("node", weight), classes)
    kind = F.when(F.col("weight.w_title") == 0, "abstract_new").when(F.col("weight.w_title") == F.col("weight.w_both"), "title_only").otherwise("mixed")
    return counted.where("weight.w_both > 0").groupBy(kind.alias("origin")).agg(F.sum("edges").alias("n"))


def citation_edges(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """References (doc_id, ref) that lie within the collection."""
    return refs.distinct().join(papers.select(F.col("doc_id").alias("ref")), "ref", "left_semi").select(F.col("doc_id").alias("src"), F.col("ref").alias("dst"))


def hub_scores(doc_entity: DataFrame) -> DataFrame:
    """doc_id, score: the weighted degree in the shared-entity graph, without building an edge: each entity of df papers adds df - 1."""
    df = doc_entity.groupBy("entity").agg(F.count("*").alias("df"))
    return doc_entity.join(df, "entity").groupBy("doc_id").agg(F.sum(F.col("df") - 1).alias("score"))


def hubs(doc_entity: DataFrame, k: int) -> DataFrame:
    return hub_scores(doc_entity).orderBy(F.desc("score"), "doc_id").limit(k)


def within_hops(doc_entity: DataFrame, seed: int, hops: int) -> DataFrame:
    """doc_id, hop of all papers that shared entities reach from the seed. A hop goes papers -> entities -> papers, so no edge is built."""
    seen = doc_entity.where(F.col("doc_id") == seed).select("doc_id").distinct().withColumn("hop", F.lit(0))
    if seen.isEmpty():
        raise ValueError(f"no paper {seed} with entities")
    front = seen
    for h in range(1, hops + 1):
        names = doc_entity.join(front, "doc_id", "left_semi").select("entity").distinct()
        front = doc_entity.join(names, "entity", "left_semi").select("doc_id").distinct().join(seen, "doc_id", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def walk(doc_entity: DataFrame, start: int, strategy: str = "strongest", max_hops: int = 10) -> list[int]:
    """A greedy path without returns: the next paper shares most entities, or brings most new ones; ties go to the least id."""
    path = [start]
    for _ in range(max_hops):
        own = doc_entity.where(F.col("doc_id") == path[-1]).select("entity")
        near = doc_entity.join(F.broadcast(own), "entity", "left_semi").where(~F.col("doc_id").isin(path)).groupBy("doc_id").agg(F.count("*").alias("shared"))
        if strategy == "diverse":
            sizes = doc_entity.groupBy("doc_id").agg(F.count("*").alias("n"))
            near = near.join(sizes, "doc_id").withColumn("score", F.col("n") - F.col("shared"))
        else:
            near = near.withColumn("score", F.col("shared") if strategy == "strongest" else F.lit(1))
        step = near.orderBy(F.desc("score"), "doc_id").limit(1).collect()
        if not step:
            break
        path.append(step[0].doc_id)
    return path


def cluster_edges(doc_entity: DataFrame, membership: DataFrame, least: int = 2) -> DataFrame:
    """Clusters that share some entities."""
    e = doc_entity.join(membership, "doc_id").select("cluster_id", "entity").distinct()
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.cluster_id") < F.col("b.cluster_id")))
    return pairs.groupBy(F.col("a.cluster_id").alias("cluster_a"), F.col("b.cluster_id").alias("cluster_b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def graph_stats(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: edges, density, share of edges of weight 1, mean weight."""
    n = papers.agg(F.count("*").alias("n_papers"))
    e = edges.agg(F.count("*").alias("n_edges"), F.avg((F.col("weight") == 1).cast("int")).alias("single_share"), F.avg("weight").alias("mean_weight"))
    return e.join(F.broadcast(n)).withColumn("density", F.col("n_edges") / (F.col("n_papers") * (F.col("n_papers") - 1) / 2))


def entity_graph_stats(doc_entity: DataFrame, papers: DataFrame) -> DataFrame:
    """graph_stats of the shared-entity graph, from the distribution of its weights."""
    n = papers.agg(F.count("*").alias("n_papers"))
    e = shared_distribution(doc_entity).agg(
        F.sum("edges").alias("n_edges"), (F.sum(F.when(F.col("weight") == 1, F.col("edges")).otherwise(0)) / F.sum("edges")).alias("single_share"), (F.sum(F.col("weight") * F.col("edges")) / F.sum("edges")).alias("mean_weight")
    )
    return e.join(F.broadcast(n)).withColumn("density", F.col("n_edges") / (F.col("n_papers") * (F.col("n_papers") - 1) / 2))


def cluster_summary(doc_entity: DataFrame, membership: DataFrame, k: int = 10) -> DataFrame:
    """cluster_id, size, top_entities: the commonest entities, by count and name."""
    size = membership.groupBy("cluster_id").agg(F.count("*").alias("size"))
    count = doc_entity.join(membership, "doc_id").groupBy("cluster_id", "entity").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "entity"))
    top = count.withColumn("rn", rank).where(F.col("rn") <= k).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rn", "entity"))).alias("t"))
    return size.join(top, "cluster_id", "left").select("cluster_id", "size", F.array_join(F.transform("t", lambda x: x["entity"]), ",").alias("top_entities"))


def cluster_labels(papers: DataFrame, membership: DataFrame, stop: list[str], k: int = 3) -> DataFrame:
    """cluster_id, label: the commonest title words of four letters or more, capitalised; `Cluster id` where there are none."""
    words = papers.join(membership, "doc_id").select("cluster_id", F.explode(F.split(F.lower("title"), r"\s+")).alias("w")).withColumn("w", F.regexp_replace("w", r"^[.,;:!?()\[\]{}\"'-]+|[.,;:!?()\[\]{}\"'-]+$", ""))
    words = words.where((F.length("w") >= 4) & F.col("w").rlike(r"^\p{L}+$") & ~F.col("w").isin(stop))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "w"))
    top = words.groupBy("cluster_id", "w").agg(F.count("*").alias("n")).withColumn("rn", rank).where(F.col("rn") <= k)
    label = top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rn", "w"))).alias("t")).select("cluster_id", F.array_join(F.transform("t", lambda x: F.initcap(x["w"])), " + ").alias("label"))
    return membership.select("cluster_id").distinct().join(label, "cluster_id", "left").select("cluster_id", F.coalesce("label", F.concat(F.lit("Cluster "), "cluster_id")).alias("label"))


def stream(doc_entity: DataFrame, start: int, mode: str = "strongest", hops: int = 2) -> DataFrame:
    """step, doc_id: `expand` gives everything within some hops, the other modes a walk."""
    if mode == "expand":
        return within_hops(doc_entity, start, hops).select(F.col("hop").alias("step"), "doc_id")
    return doc_entity.sparkSession.createDataFrame(list(enumerate(walk(doc_entity, start, mode, hops))), "step int, doc_id long")


def restricted(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges between papers that have a cluster."""
    keys = membership.select("doc_id")
    return edges.join(keys.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(keys.withColumnRenamed("doc_id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
