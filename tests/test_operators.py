"""Operators on small fixtures: invariants, determinism, independent recomputation."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import bridges as B
from citeloom.operators import collections as C
from citeloom.operators import communities as U
from citeloom.operators import entities as E
from citeloom.operators import evaluate as V
from citeloom.operators import failures as X
from citeloom.operators import frontier as R
from citeloom.operators import graph as G
from citeloom.operators import layout as L


@pytest.fixture(scope="module")
def ents(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"e{j}") for i in range(60) for j in sorted(set(rng.integers(0, 25, 4).tolist()))]
    return spark.createDataFrame(rows, "doc_id long, entity string").persist()


def member(spark, labels):
    return spark.createDataFrame([(i, str(c)) for i, c in enumerate(labels)], "doc_id long, cluster_id string")


def test_edges_hubs_and_weights_agree(spark, ents):
    sets = {}
    for r in ents.collect():
        sets.setdefault(r.doc_id, set()).add(r.entity)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    assert {(r.src, r.dst): r.weight for r in G.shared_edges(ents).collect()} == want
    degree = {d: sum(w for p, w in want.items() if d in p) for d in sets}
    assert {r.doc_id: r.score for r in G.hub_scores(ents).collect()} == degree
    jac = {(r.src, r.dst): r.weight for r in G.jaccard_edges(ents).collect()}
    assert all(abs(jac[p] - w / len(sets[p[0]] | sets[p[1]])) < 1e-12 for p, w in want.items())


def test_walks_and_reach(spark, ents):
    path = G.walk(ents, 0, "strongest", 5)
    assert path[0] == 0 and len(set(path)) == len(path) == 6
    hops = {r.doc_id: r.hop for r in G.within_hops(ents, 0, 2).collect()}
    assert hops[0] == 0 and max(hops.values()) <= 2 and hops[path[1]] == 1
    with pytest.raises(ValueError):
        G.within_hops(ents, -1, 1)


def test_filters_complement(spark, ents):
    papers = ents.select("doc_id").distinct()
    kept = C.having_any(papers, ents, ["E1", "e2"])
    assert kept.count() + C.excluding(papers, kept).count() == papers.count()
    both = C.having_all(papers, ents, ["e1", "e2"])
    assert both.join(kept, "doc_id", "left_anti").count() == 0


def test_first_type_wins_and_stop_words(spark):
    v = E.merged_vocabulary()
    p = spark.createDataFrame([(1, "Development of RNA-seq in Yeast: The XYZ Atlas", "classification of rat cells")], "doc_id long, title string, abstract string")
    got = {r.entity: r.kind for r in E.title_entities(p, v).collect()}
    assert got["rna-seq"] == "METHOD" and got["yeast"] == "ORGANISM" and got["development"] == "CONCEPT" and got["xyz"] == "METHOD" and got["atlas"] == "DATASET" and "the" not in got
    assert {r.entity for r in E.abstract_entities(p, v).collect()} == {"rat"}


def test_merge_keeps_the_first(spark):
    a, b = spark.createDataFrame([("k", 1)], "key string, v int"), spark.createDataFrame([("k", 2), ("m", 3)], "key string, v int")
    assert {(r.key, r.v) for r in C.merge_first([a, b], "key", "v").collect()} == {("k", 1), ("m", 3)}


def test_partition_measures(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 80), rng.integers(0, 3, 80)
    got = V.agreement(member(spark, a), member(spark, b)).first()
    same = lambda x: np.equal.outer(x, x)[np.triu_indices(80, 1)]
    sa, sb = same(a), same(b)
    expected, most = sa.sum() * sb.sum() / len(sa), (sa.sum() + sb.sum()) / 2
    assert abs(got.ari - ((sa & sb).sum() - expected) / (most - expected)) < 1e-9
    assert V.agreement(member(spark, a), member(spark, a)).first().ari == 1.0
    p = V.pair_preservation(member(spark, a), member(spark, b)).first()
    assert (p.pairs, p.kept) == (sa.sum(), (sa & sb).sum())


def test_modularity_by_hand(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    q = V.modularity(e, member(spark, [0, 0, 0, 1, 1, 1])).first().modularity
    assert abs(q - (6 / 7 - 0.5)) < 1e-9


def test_communities_find_two_triangles_and_are_deterministic(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    v = spark.range(7).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.cluster_id for r in U.communities(v, e, 1.0, 5).collect()}
    assert got[0] == got[1] == got[2] != got[3] == got[4] == got[5] and len(set(got.values())) == 3 and len(got) == 7
    assert got == {r.doc_id: r.cluster_id for r in U.communities(v, e, 1.0, 5).collect()}
    sub = U.sub_clusters(member(spark, [0] * 6), e, "0", 1.0)
    assert {r.cluster_id.split(".")[0] for r in sub.collect()} == {"0"} and sub.count() == 6
    with pytest.raises(ValueError):
        U.sub_clusters(member(spark, [0, 1]), e, "1")
    none = U.citation_clusters(v, e.where("src < 0").select("src", "dst"))
    assert {r.cluster_id for r in none.collect()} == {"0"}


def test_trend_of_a_rising_entity(spark):
    rows, papers, n = [], [], 0
    for y in range(2010, 2018):
        for k in range(10):
            papers.append((n, y))
            rows.append((n, "all"))
            if k < (y - 2009):
                rows.append((n, "up"))
            n += 1
    m = member(spark, [0] * n)
    fits = {r.entity: r for r in R.trends(spark.createDataFrame(rows, "doc_id long, entity string"), spark.createDataFrame(papers, "doc_id long, year int"), m).collect()}
    assert fits["up"].slope == 0.1 and fits["up"].significant and fits["up"].direction == "rising"
    assert fits["all"].slope == 0 and not fits["all"].significant and fits["all"].p_value == 1.0


def viterbi(counts, s, gamma):
    t, q = len(counts), sum(counts) / len(counts)
    cost = lambda c, k: -(c * np.log(q * s**k) - q * s**k)
    best = min(itertools.product(range(3), repeat=t), key=lambda w: sum(cost(c, k) for c, k in zip(counts, w)) + sum(max(0, b - a) * gamma * np.log(t) for a, b in zip(w, w[1:])))
    return list(best)


def test_bursts_are_the_cheapest_path(spark):
    counts = [1, 1, 9, 12, 1, 2]
    df = spark.createDataFrame([("e", i, c) for i, c in enumerate(counts)] + [("short", 1, 5)], "entity string, t int, n int")
    got = {(r.entity, r.t): r.state for r in R.burst_states(df).collect()}
    assert [got["e", i] for i in range(6)] == viterbi(counts, 2.0, 1.0) and got["short", 1] == 0
    iv = R.burst_intervals(R.burst_states(df)).collect()
    assert [(r.first, r.last, r.peak_n) for r in iv] == [(2, 3, 12)]


def test_gaps_need_expectation(spark):
    rows = [(i, "a") for i in range(0, 15)] + [(i, "b") for i in range(15, 30)] + [(i, "c") for i in range(30)]
    got = R.gaps(spark.createDataFrame(rows, "doc_id long, entity string"), member(spark, [0] * 30)).collect()
    assert [(r.entity_a, r.entity_b, r.expected, r.observed) for r in got] == [("a", "b", 7.5, 0)]
    assert R.gaps(spark.createDataFrame(rows, "doc_id long, entity string"), member(spark, [0] * 10)).count() == 0


def test_drop_guard(spark):
    rows = [(i, "a") for i in range(40)]
    with pytest.raises(RuntimeError):
        R.structural_gaps(spark.createDataFrame(rows, "doc_id long, entity string"), member(spark, [0] * 25 + list(range(1, 16))))


def test_themes_grow(spark):
    texts = ["alpha bravo charlie", "delta echo foxtrot", "bravo golf", "golf hotel india"]
    df = spark.createDataFrame([("c", i, i, t) for i, t in enumerate(texts)], "cluster_id string, doc_id int, pos int, text string")
    got = X.themes(df).collect()
    assert len(got) == 1 and got[0].members == ["0", "2", "3"] and got[0].n == 3


def test_semantic_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.99, 0.01]), (3, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<float>")
    assert {r.vec_id for r in X.semantic_dedup(df, "label").collect()} == {1, 3}


def test_bridge_scores(spark):
    vals = spark.createDataFrame([(0.6,), (0.04,), (0.2,), (0.4,)], "j double").select(B.bridge_gap(F.col("j")).alias("g")).collect()
    assert [round(r.g, 6) for r in vals] == [0.5, 0.3, 1.0, 0.6]
    assert B.weights_from([1.0, 1.0, 1.0]) == (0.3333, 0.3333, 0.3333)


def test_batches_cover_in_order(spark):
    got = C.batches(spark.range(100).withColumnRenamed("id", "doc_id"), "doc_id", 30).collect()
    assert {r.doc_id: r.batch_id for r in got} == {i: i // 30 for i in range(100)}


def test_stratified_sample_is_repeatable(spark):
    papers = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 5 > 0).alias("has_abstract"))
    m = member(spark, [i % 6 for i in range(54)] + [100 + i for i in range(6)])
    a, b = (sorted(map(tuple, C.stratified_sample(papers, m, 9, 50).collect())) for _ in range(2))
    assert a == b and len(a) == 50 and len({x[0] for x in a}) == 50 and sum(x[1] == 2 for x in a) == 3


def test_layout(spark, ents):
    papers = ents.select("doc_id").distinct().union(spark.createDataFrame([(999,)], "doc_id long"))
    got = L.embed(papers, ents).collect()
    assert len(got) == papers.count() and all(len(r.xy) == 2 and not np.isnan(r.xy).any() for r in got)
    with pytest.raises(ValueError):
        L.embed(papers, ents.where("doc_id = 0"))
