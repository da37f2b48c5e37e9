"""The research frontier: redundancy, trends, background terms, gaps, bridges, null models, bursts, dead ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.stats import bh_rank, choose_threshold, correlation, natural_log, rounded, student_p
from citeloom.operators.scratch import written


#: Papers of a cluster in a block; pairs of blocks meet in tasks of their own. Counts keep no pair, so their blocks are larger.
BLOCK, COUNT_BLOCK = 4096, 16384
#: Pairs of papers or of entity sets, or references in common, that a task holds at a time.
AT_ONCE = 500_000


def _met(doc_entity: DataFrame, refs: DataFrame, membership: DataFrame, block: int):
    """Each cluster's papers with their sets (hashes, sorted), grouped by pairs of blocks bi <= bj."""
    item = lambda rows, name, kind: rows.where(F.col(name).isNotNull()).select("doc_id", F.lit(kind).alias("kind"), F.xxhash64(name).alias("x"))
    own = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("x")))).alias(kind)
    sets = item(doc_entity, "entity", "e").unionByName(item(refs, "ref", "r")).groupBy("doc_id").agg(own("e"), own("r"))
    papers = membership.select("doc_id", F.col("cluster_id").cast("string").alias("cluster_id")).join(sets, "doc_id")
    sizes = membership.groupBy(F.col("cluster_id").cast("string").alias("cluster_id")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = papers.join(sizes, "cluster_id").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return placed.select("cluster_id", F.least("at", "other").alias("bi"), F.greatest("at", "other").alias("bj"), "at", "doc_id", "e", "r").groupBy("cluster_id", "bi", "bj")


def _alike(threshold: float, count: bool):
    """A function of two blocks' papers: their pairs whose mean of two Jaccards is over the threshold, or only how many there are.

    Entity sets are compared set with set; where that alone is enough, every pair of their papers counts. The others need references in
    common, which come from one block's inverted index. Nothing here names the package, which the workers needn't have."""
    at_once = AT_ONCE

    def lists(column):
        column = column.combine_chunks()
        return column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()], np.diff(column.offsets.to_numpy())

    def share(s, union):
        return np.divide(s, union, out=np.zeros(np.shape(union)), where=union > 0)

    def classes(side):
        values, n = lists(side)
        ends, seen = np.cumsum(n), {}
        of = np.array([seen.setdefault(values[e - k : e].tobytes(), len(seen)) for e, k in zip(ends, n, strict=True)], np.int64)
        return of, [np.frombuffer(x, np.int64) for x in seen]

    def inverted(sets):
        index = {}
        for c, own in enumerate(sets):
            for x in own.tolist():
                index.setdefault(x, []).append(c)
        return {x: np.array(cs) for x, cs in index.items()}

    def jaccard(low, index, sizes):
        """Each set of low with all that are in the index."""
        s = np.zeros((len(low), len(sizes)))
        for c, own in enumerate(low):
            for x in own.tolist():
                if x in index:
                    s[c, index[x]] += 1
        return share(s, np.array([len(x) for x in low])[:, None] + sizes[None, :] - s)

    def found(table):
        cluster, bi, bj = (table.column(c)[0].as_py() for c in ("cluster_id", "bi", "bj"))
        at = table.column("at").to_numpy()
        a, b = (table.filter(pa.array(at == k)) for k in (bi, bj))
        if not len(a) or not len(b):
            return
        (ca, low), (cb, high) = classes(a.column("e")), classes(b.column("e"))
        order = np.argsort(ca, kind="stable")  # papers of one set stand together
        a, ca, index, sizes, many = a.take(pa.array(order)), ca[order], inverted(high), np.array([len(x) for x in high]), np.bincount(cb)
        ids_a, ids_b = a.column("doc_id").combine_chunks(), b.column("doc_id").combine_chunks()
        places = np.unique(np.concatenate([ids_a.to_numpy(zero_copy_only=False), ids_b.to_numpy(zero_copy_only=False)]), return_inverse=True)[1]
        pa_, pb = places[: len(a)], places[len(a) :]
        same, wide, by_set, by_refs = bi == bj, len(b), 0, 0
        xa, na = lists(a.column("r"))
        xb, nb = lists(b.column("r"))
        order = np.argsort(xb, kind="stable")
        sorted_b, owner_b = xb[order], np.repeat(np.arange(wide), nb)[order]
        first = np.searchsorted(sorted_b, xa, "left")
        hits = np.searchsorted(sorted_b, xa, "right") - first
        owner_a, ends = np.repeat(np.arange(len(a)), na), np.concatenate([[0], np.cumsum(na)])
        weight = np.concatenate([[0], np.cumsum(hits)])[ends]  # hits before each row
        row = 0
        while row < len(a):
            # Rows until the references in common, the pairs of sets, or the pairs of papers are as many as a task takes at once.
            ends_at = [int(np.searchsorted(weight, weight[row] + at_once, "right")) - 1, int(np.searchsorted(ca, ca[row] + max(1, at_once // len(high)))), len(a)]
            stop = max(row + 1, min(ends_at if count else [*ends_at, row + at_once // wide]))
            ej, near = jaccard(low[ca[row] : ca[stop - 1] + 1], index, sizes), ca - ca[row]
            enough = 0.5 * ej > threshold
            x, y = ends[row], ends[stop]
            h = hits[x:y]
            spot = np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h) + np.repeat(first[x:y], h)
            keys, s = np.unique(np.repeat(owner_a[x:y] - row, h) * wide + owner_b[spot], return_counts=True)
            i, j = keys // wide + row, keys % wide
            if same:
                keep = pa_[i] < pb[j]
                keys, s, i, j = keys[keep], s[keep], i[keep], j[keep]
            bj_ = s / (na[i] + nb[j] - s)
            score = 0.5 * ej[near[i], cb[j]] + 0.5 * bj_
            more = (score > threshold) & ~enough[near[i], cb[j]]
            if count:
                by_set, by_refs = by_set + int((enough @ many)[near[row:stop]].sum()), by_refs + int(more.sum())
            else:
                k, coupling = keys[more], bj_[more]
                free = enough[near[row:stop]][:, cb]
                if same:
                    free &= pa_[row:stop, None] < pb[None, :]
                if free.any():
                    every = np.zeros((stop - row) * wide)
                    every[keys] = bj_
                    of = np.flatnonzero(free)
                    k, coupling = np.concatenate([of, k]), np.concatenate([every[of], coupling])
                if len(k):
                    i, j = k // wide + row, k % wide
                    swap = pa.array(pa_[i] > pb[j])
                    p, q = ids_a.take(pa.array(i)), ids_b.take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([pa.repeat(cluster, len(k)), pc.if_else(swap, q, p), pc.if_else(swap, p, q), pa.array(ej[near[i], cb[j]]), pa.array(coupling)], names=["cluster_id", "doc_a", "doc_b", "ej", "bj"])
            row = stop
        if same:  # each pair has come twice by its sets, and each paper that has entities with itself
            by_set = (by_set - sum(len(low[c]) > 0 for c in ca) * (threshold < 0.5)) // 2
        total = by_set + by_refs
        if count and total:
            yield pa.RecordBatch.from_arrays([pa.array([cluster], pa.string()), pa.array([total], pa.int64())], names=["cluster_id", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from found(pa.Table.from_batches(list(batches)))

    return run


def redundancy(doc_entity: DataFrame, refs: DataFrame, membership: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Pairs within a cluster whose mean of entity Jaccard and reference Jaccard is over the threshold, which isn't negative."""
    kind = membership.schema["doc_id"].dataType.simpleString()
    pairs = _met(doc_entity, refs, membership, BLOCK).applyInArrow(_alike(threshold, False), f"cluster_id string, doc_a {kind}, doc_b {kind}, ej double, bj double")
    return pairs.select("cluster_id", "doc_a", "doc_b", rounded(F.col("ej"), 4).alias("entity_jaccard"), rounded(F.col("bj"), 4).alias("biblio_coupling"), rounded(0.5 * F.col("ej") + 0.5 * F.col("bj"), 4).alias("combined_score"))


def redundancy_counts(doc_entity: DataFrame, refs: DataFrame, membership: DataFrame, threshold: float = 0.15) -> DataFrame:
    """cluster_id, pairs: how many pairs redundancy has of each cluster, counted without making one; clusters without any aren't there."""
    return _met(doc_entity, refs, membership, COUNT_BLOCK).applyInArrow(_alike(threshold, True), "cluster_id string, pairs long").groupBy("cluster_id").agg(F.sum("pairs").alias("pairs"))


def redundancy_summary(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: pairs that clusters hold, notable pairs, correlation of the two axes over them: 0 without pairs, NaN where an axis doesn't vary."""
    checked = membership.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs_checked"))
    one = pairs.agg(F.count("*").alias("notable_pairs"), F.when(F.count("*") == 0, 0.0).otherwise(F.coalesce(correlation(F.col("entity_jaccard"), F.col("biblio_coupling")), F.lit(float("nan")))).alias("axis_correlation"))
    return checked.join(F.broadcast(one))


def trends(doc_entity: DataFrame, papers: DataFrame, membership: DataFrame, least_papers: int = 20, least_years: int = 5, per_year: int = 5, mentions: int = 5, alpha: float = 0.05, method: str = "rowwise") -> DataFrame:
    """Per cluster and entity: slope of its yearly share of papers, r squared, p, q, direction and whether it is significant.

    Years count with enough papers of the cluster; years in which an entity is absent count as 0. method: `rowwise`
    takes each p for itself against alpha * rank / m, `stepup` takes all up to the last that passes."""
    dated = papers.where(F.coalesce("year", F.lit(0)) != 0).select("doc_id", "year").join(membership, "doc_id").join(doc_entity.groupBy("doc_id").agg(F.collect_list("entity").alias("own")), "doc_id")
    # One pass counts papers and their entities by year; the counts, far fewer than papers, are written and all else comes from them.
    marks = F.concat(F.array(F.struct(F.lit(True).alias("paper"), F.lit(None).cast("string").alias("entity"))), F.transform("own", lambda e: F.struct(F.lit(False).alias("paper"), e.cast("string").alias("entity"))))
    counted = written(dated.select("cluster_id", "year", F.explode(marks).alias("x")).groupBy("cluster_id", "year", "x.paper", "x.entity").agg(F.count("*").alias("n")), "counts")
    yearly_papers, counts = counted.where("paper").select("cluster_id", "year", F.col("n").alias("year_n")), counted.where("not paper").select("cluster_id", "entity", "year", "n")
    sizes = yearly_papers.groupBy("cluster_id").agg(F.sum("year_n").alias("n_papers")).where(F.col("n_papers") >= least_papers)
    years = yearly_papers.where(F.col("year_n") >= per_year).join(sizes, "cluster_id")
    years = years.withColumn("n_years", F.count("*").over(Window.partitionBy("cluster_id"))).where(F.col("n_years") >= least_years)
    tested = counts.groupBy("cluster_id", "entity").agg(F.sum("n").alias("freq")).where(F.col("freq") >= mentions)
    grid = tested.join(years, "cluster_id").join(counts, ["cluster_id", "entity", "year"], "left")
    share = F.coalesce("n", F.lit(0)) / F.col("year_n")
    fits = grid.withColumn("share", share).groupBy("cluster_id", "entity").agg(
        F.first("freq").alias("freq"), F.count("*").alias("points"), F.regr_slope("share", F.col("year").cast("double")).alias("slope_raw"), correlation(F.col("share"), F.col("year").cast("double")).alias("r")
    )
    fits = fits.withColumn("p_value", student_p(F.col("r"), F.col("points")))
    fits = fits.withColumn("rank", bh_rank(F.round("p_value", 12), F.col("entity"), "cluster_id")).withColumn("m", F.count("*").over(Window.partitionBy("cluster_id")))
    passes = F.col("p_value") <= alpha * F.col("rank") / F.col("m")
    if method == "stepup":
        passes = F.col("rank") <= F.coalesce(F.max(F.when(passes, F.col("rank"))).over(Window.partitionBy("cluster_id")), F.lit(0))
    slope = F.coalesce("slope_raw", F.lit(0.0))
    return fits.select(
        "cluster_id", "entity", "freq", "rank", "m", F.round(slope, 6).alias("slope"), F.round(F.coalesce(F.col("r") * F.col("r"), F.lit(0.0)), 4).alias("r_squared"), "p_value",
        F.round(F.least(F.col("p_value") * F.col("m") / F.col("rank"), F.lit(1.0)), 6).alias("q_value"), F.when(slope > 0, "rising").otherwise("declining").alias("direction"), passes.alias("significant"),
    )


def momentum(fits: DataFrame) -> DataFrame:
    """Per cluster: tests, significant, rising and declining ones, and the mean slope of the significant, or else of the five least p."""
    sig = F.col("significant")
    return fits.groupBy("cluster_id").agg(
        F.count("*").alias("tests"), F.count_if(sig).alias("n_significant"), F.count_if(sig & (F.col("direction") == "rising")).alias("rising"), F.count_if(sig & (F.col("direction") == "declining")).alias("declining"),
        F.round(F.coalesce(F.avg(F.when(sig, F.col("slope"))), F.avg(F.when(F.col("rank") <= 5, F.col("slope"))), F.lit(0.0)), 6).alias("momentum"),
    )


def _frequencies(doc_entity: DataFrame, membership: DataFrame, least_papers: int) -> tuple[DataFrame, DataFrame]:
    """Clusters with enough papers that have entities (cluster_id, n) and how many of their papers each entity is in."""
    own = membership.join(doc_entity.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = own.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_papers)
    return sizes, doc_entity.join(own, "doc_id").join(sizes, "cluster_id").groupBy("cluster_id", "n", "entity").agg(F.count("*").alias("f"))


def background_terms(doc_entity: DataFrame, membership: DataFrame, fraction: float = 0.8, least_papers: int = 20, extra: list[str] | None = None, fixed: bool = False) -> DataFrame:
    """entity, cluster_df: terms with three papers or more in almost all clusters; the share needed falls for many clusters, unless it is fixed."""
    sizes, freq = _frequencies(doc_entity, membership, least_papers)
    k = sizes.count() or 1
    found = freq.where("f >= 3").groupBy("entity").agg(F.count("*").alias("cluster_df")).where(F.col("cluster_df") / k >= (fraction if fixed else choose_threshold(k, fraction)))
    if extra:
        more = doc_entity.sparkSession.createDataFrame([(e,) for e in sorted(set(extra))], "entity string").join(found, "entity", "left_anti").select("entity", F.lit(0).cast("long").alias("cluster_df"))
        found = found.unionByName(more)
    return found


def gaps(doc_entity: DataFrame, membership: DataFrame, least_papers: int = 20, least_entities: int = 5, ratio: float = 0.2, expected: float = 5, top: int | None = 20) -> DataFrame:
    """Entity pairs that a cluster's papers combine far less often than their frequencies make one expect; the first `top` by expectation."""
    _, freq = _frequencies(doc_entity, membership, least_papers)
    often = freq.where(F.col("f") >= least_entities)
    a, b = often.alias("a"), often.alias("b")
    pairs = a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.entity") < F.col("b.entity"))).select(
        F.col("a.cluster_id").alias("cluster_id"), F.col("a.entity").alias("entity_a"), F.col("b.entity").alias("entity_b"), F.col("a.f").alias("freq_a"), F.col("b.f").alias("freq_b"), (F.col("a.f") * F.col("b.f") / F.col("a.n")).alias("e")
    ).where(F.col("e") >= expected)
    rows = doc_entity.join(membership, "doc_id").join(often.select("cluster_id", "entity"), ["cluster_id", "entity"], "left_semi")
    x, y = rows.alias("x"), rows.alias("y")
    seen = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.entity") < F.col("y.entity"))).groupBy(F.col("x.cluster_id").alias("cluster_id"), F.col("x.entity").alias("entity_a"), F.col("y.entity").alias("entity_b")).agg(F.count("*").alias("o"))
    both = pairs.join(seen, ["cluster_id", "entity_a", "entity_b"], "left").withColumn("observed", F.coalesce("o", F.lit(0)))
    low = both.where(F.col("observed") / F.col("e") < ratio)
    out = low.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("e"), "entity_a", "entity_b")))
    out = out.where(F.col("rn") <= top) if top else out
    return out.select("cluster_id", "entity_a", "entity_b", "freq_a", "freq_b", F.round("e", 2).alias("expected"), "observed", F.round(F.col("observed") / F.col("e"), 4).alias("ratio"), "rn")


def bridges(doc_entity: DataFrame, membership: DataFrame, background: DataFrame | None = None, least_papers: int = 20, jaccard: float = 0.05, top: int = 10) -> DataFrame:
    """Cluster pairs with alike entity profiles: Jaccard, counts, and the shared entities with the highest product of cluster TF-IDF, in order."""
    _, freq = _frequencies(doc_entity, membership, least_papers)
    if background is not None:
        freq = freq.join(background.select("entity"), "entity", "left_anti")
    w = Window.partitionBy("cluster_id")
    profile = freq.where("f >= 3").withColumn("total", F.sum("f").over(w)).withColumn("size", F.count("*").over(w))
    clusters = profile.select("cluster_id").distinct().agg(F.count("*").alias("k"))
    df = profile.groupBy("entity").agg(F.count("*").alias("df")).join(F.broadcast(clusters)).withColumn("idf", natural_log(1 + F.col("k") / F.col("df")))
    profile = profile.join(df.select("entity", "idf"), "entity").withColumn("w", F.col("f") / F.col("total") * F.col("idf"))
    order = lambda c: F.struct(F.expr(f"try_cast({c} AS INT)"), F.col(c))
    a, b = profile.alias("a"), profile.alias("b")
    shared = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (order("a.cluster_id") < order("b.cluster_id"))).select(
        F.col("a.cluster_id").alias("cluster_a"), F.col("b.cluster_id").alias("cluster_b"), F.col("a.entity").alias("entity"), F.col("a.size").alias("sa"), F.col("b.size").alias("sb"), rounded(F.col("a.w") * F.col("b.w"), 15).alias("score")
    )
    rank = F.row_number().over(Window.partitionBy("cluster_a", "cluster_b").orderBy(F.desc("score"), "entity"))
    rows = shared.withColumn("rn", rank).groupBy("cluster_a", "cluster_b").agg(
        F.first("sa").alias("sa"), F.first("sb").alias("sb"), F.count("*").alias("shared_count"), F.sort_array(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", "entity")))).alias("t")
    )
    jac = F.col("shared_count") / (F.col("sa") + F.col("sb") - F.col("shared_count"))
    return rows.where(jac > jaccard).select(
        "cluster_a", "cluster_b", rounded(jac, 4).alias("entity_jaccard"), F.transform("t", lambda x: x["entity"]).alias("shared_entities"),
        (F.col("sa") - F.col("shared_count")).alias("unique_a"), (F.col("sb") - F.col("shared_count")).alias("unique_b"), "shared_count",
    )


def drop_share(doc_entity: DataFrame, membership: DataFrame, least_papers: int = 20) -> DataFrame:
    """One row: clusters, those with too few papers, their share, and whether that is over 30 % while some stay."""
    own = membership.join(doc_entity.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n"))
    one = own.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") < least_papers).alias("dropped"))
    share = F.col("dropped") / F.col("clusters")
    return one.select("clusters", "dropped", share.alias("drop_share"), ((share > 0.3) & (F.col("dropped") < F.col("clusters"))).alias("too_many"))


def structural_gaps(doc_entity: DataFrame, membership: DataFrame, allow_high_drop: bool = False, least_papers: int = 20, **options) -> dict[str, DataFrame]:
    """gaps, bridges and background together, of clusters with enough papers; raises if over 30 % of the clusters are too small, unless allowed."""
    if not allow_high_drop and drop_share(doc_entity, membership, least_papers).first().too_many:
        raise RuntimeError("over 30 % of the clusters have too few papers; allow_high_drop=True lets them go")
    background = background_terms(doc_entity, membership, least_papers=least_papers)
    return {"gaps": gaps(doc_entity, membership, least_papers, **options), "bridges": bridges(doc_entity, membership, background, least_papers), "background": background}


def permutation_gaps(doc_entity: DataFrame, membership: DataFrame, rounds: int = 1000, least_papers: int = 20, most_entities: int = 100, seed: int = 7, shares: int = 8) -> DataFrame:
    """cluster_id, entity_a, entity_b, observed, mean, z: co-occurrence against shuffles of the cluster's entity mentions over its papers.

    A cluster's commonest entities (a fixed number) make its table. Its rounds are dealt to `shares` tasks, whose sums are
    added up; a task holds the cluster's mentions as numbers and a few thousand papers' rows at a time. The seed of a share
    comes from the cluster's id and the share."""
    top = Window.partitionBy("cluster_id").orderBy(F.desc("f"), "entity")
    _, freq = _frequencies(doc_entity, membership, least_papers)
    chosen = freq.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= most_entities).select("cluster_id", "entity", "rn")
    rows = doc_entity.join(membership, "doc_id").join(chosen, ["cluster_id", "entity"]).select("cluster_id", "doc_id", "rn")
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "rn"])
        owner = np.unique(frame["doc_id"].to_numpy(), return_inverse=True)[1]
        pool, n = frame["rn"].to_numpy() - 1, int(frame["rn"].max())
        cuts = np.searchsorted(owner, np.arange(0, owner[-1] + 4097, 4096))
        rng = np.random.default_rng([seed, int(key[1]), *str(key[0]).encode()])

        def together(columns: np.ndarray) -> np.ndarray:
            out = np.zeros((n, n), np.float64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    x = np.zeros((4096, n), np.float32)
                    x[owner[a:b] - owner[a], columns[a:b]] = 1
                    out += x.T @ x
            return out

        observed, total, squares = together(pool), np.zeros((n, n)), np.zeros((n, n))
        for _ in range(rounds // shares + (int(key[1]) < rounds % shares)):
            c = together(rng.permutation(pool))
            total, squares = total + c, squares + c * c
        i, j = np.triu_indices(n, 1)
        return pd.DataFrame({"cluster_id": str(key[0]), "a": i + 1, "b": j + 1, "observed": observed[i, j].astype(int), "total": total[i, j], "squares": squares[i, j]})

    kind = "cluster_id string, a int, b int, observed long, total double, squares double"
    sums = rows.groupBy("cluster_id", "share").applyInPandas(run, kind).groupBy("cluster_id", "a", "b").agg(F.max("observed").alias("observed"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    name = lambda n, e: chosen.select(F.col("cluster_id").cast("string").alias("cluster_id"), F.col("rn").alias(n), F.col("entity").alias(e))
    mean = F.col("total") / rounds
    both = sums.join(name("a", "x"), ["cluster_id", "a"]).join(name("b", "y"), ["cluster_id", "b"]).withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("squares") / rounds - F.col("mean") ** 2, F.lit(0.0))))
    both = both.where("std >= 1e-9").withColumn("z", (F.col("observed") - F.col("mean")) / F.col("std"))
    return both.select("cluster_id", F.least("x", "y").alias("entity_a"), F.greatest("x", "y").alias("entity_b"), "observed", "mean", "z")


def yearly(doc_entity: DataFrame, papers: DataFrame, mentions: int = 5) -> DataFrame:
    """entity, t, n: how many papers of each period name an entity; entities with few mentions are left out."""
    n = doc_entity.join(papers.select("doc_id", F.col("year").alias("t")), "doc_id").groupBy("entity", "t").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("entity"))).where(F.col("total") >= mentions).select("entity", "t", "n")


def burst_states(series: DataFrame, s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """entity, t, n, state (0 to 2): the cheapest states of a Poisson model whose rates grow by s; going up costs gamma ln T a state.

    Observed periods only; under three of them all are state 0. The costs are a fold over each entity's sorted periods."""
    lists = series.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("t", "n"))).alias("x"))
    lists = lists.withColumn("len", F.size("x")).withColumn("q", F.aggregate("x", F.lit(0.0), lambda a, v: a + v["n"]) / F.col("len"))
    up = gamma * F.ln(F.col("len"))

    def cost(n, k: int):
        rate = F.col("q") * s**k
        return -(n * F.ln(rate) - rate)

    def step(a, v):
        came = []
        for k in range(3):
            paths = [F.struct((a["c"][j] + (up * (k - j) if k > j else F.lit(0.0)) + cost(v["n"], k)).alias("c"), F.lit(j).alias("j")) for j in range(3)]
            came.append(F.array_min(F.array(*paths)))
        return F.struct(F.array(*[x["c"] for x in came]).alias("c"), F.concat(a["back"], F.array(F.array(*[x["j"] for x in came]))).alias("back"))

    none = F.array().cast("array<array<int>>")
    start = F.struct(F.array(*[cost(F.col("x")[0]["n"], k) for k in range(3)]).alias("c"), none.alias("back"))
    folded = lists.withColumn("dp", F.aggregate(F.slice("x", 2, F.greatest(F.col("len") - 1, F.lit(1))), start, step))
    last = F.array_min(F.zip_with(F.col("dp.c"), F.sequence(F.lit(0), F.lit(2)), lambda c, k: F.struct(c.alias("c"), k.alias("k"))))["k"]
    traced = F.aggregate(F.reverse("dp.back"), F.array(last.cast("int")), lambda path, b: F.concat(F.array(b[path[0]]), path))
    states = F.when(F.col("len") < 3, F.transform("x", lambda v: F.lit(0))).otherwise(traced)
    out = folded.select("entity", F.explode(F.arrays_zip("x", states.alias("state"))).alias("z"))
    return out.select("entity", F.col("z.x.t").alias("t"), F.col("z.x.n").alias("n"), F.col("z.state").alias("state"))


def burst_intervals(states: DataFrame, threshold: int = 1) -> DataFrame:
    """entity, first, last, length, peak, peak_n of runs of observed periods at the threshold or over; of equal peaks the first."""
    w = Window.partitionBy("entity").orderBy("t")
    rows = states.withColumn("i", F.row_number().over(w)).where(F.col("state") >= threshold).withColumn("run", F.col("i") - F.row_number().over(w))
    return rows.groupBy("entity", "run").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("length"), F.max(F.struct(F.col("n"), (-F.unix_date("t") if dict(states.dtypes)["t"] == "date" else -F.col("t")).alias("o"))).alias("p")
    ).select("entity", "first", "last", "length", F.col("p.n").alias("peak_n"))


def burst_matches(intervals: DataFrame, events: DataFrame, slack: int = 2) -> DataFrame:
    """Known events (name, entity, t) that an interval of their entity covers within some periods."""
    hit = (F.col("t") >= F.col("first") - slack) & (F.col("t") <= F.col("last") + slack)
    return events.join(intervals, "entity", "left").groupBy("name", "entity", "t").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("matched"))


def dead_ends(papers: DataFrame, now: int, age: int = 5) -> DataFrame:
    """doc_id of papers (doc_id, year, citations, retracted) that are retracted, or old and within the least-cited quarter."""
    n = papers.count()
    if not n:
        return papers.select("doc_id")
    place = max(0, int(n * 0.25) - 1)
    # The value at a place of the sorted counts, from the counts of each value: no sort of all rows.
    steps = papers.groupBy("citations").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("citations")))
    cut = steps.where(F.col("upto") > place).agg(F.min("citations").alias("cut"))
    return papers.join(F.broadcast(cut)).where(F.col("retracted") | ((F.col("citations") <= F.col("cut")) & (F.lit(now) - F.col("year") >= age))).select("doc_id")


def acceptance(counts: DataFrame, fits: DataFrame, found: DataFrame, least: int = 3) -> DataFrame:
    """Clusters with five redundant pairs (counts: cluster_id, pairs), a significant trend and a gap; and whether enough clusters have all three."""
    a = counts.where("pairs >= 5")
    b = fits.where("significant").select("cluster_id").distinct()
    c = found.select("cluster_id").distinct()
    return a.join(b, "cluster_id", "left_semi").join(c, "cluster_id", "left_semi").agg(F.count("*").alias("clusters")).withColumn("accepted", F.col("clusters") >= least)


