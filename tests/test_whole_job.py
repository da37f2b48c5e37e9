"""Registered queries do the whole job of what they stand for: full rounds, whole grids, all rows of a table."""

import numpy as np

from citeloom.operators import communities as U
from citeloom.operators import evaluate as V
from citeloom.plans import registry
from citeloom.plans.corpora import PC, PE, PT
from citeloom.plans.q_frontier import RED, _redundant_counts
from citeloom.plans.q_text import title_pairs


def test_zscore_runs_a_thousand_shuffles(spark):
    rows = registry.QUERIES["fr_zscore"][0](spark, "/root/testdata/sf0.01").collect()  # on smaller tables no cluster has 20 papers
    sums = np.array([r["mean"] for r in rows]) * 1000
    assert len(sums) and np.allclose(sums, sums.round(), atol=1e-6)
    assert (sums.round() % 20 > 0).any()  # means of 50 shuffles would all be multiples of 1/50


def test_sweep_is_its_definition_for_every_cluster(spark):
    # Cluster a: five cliques in a ring; b: two papers and one edge, which never part at 1.5; c: papers without edges; d: one paper.
    edges = [(10 * c + i, 10 * c + j) for c in range(5) for i in range(6) for j in range(i + 1, 6)] + [(10 * c, (10 * c + 10) % 50) for c in range(5)] + [(100, 101)]
    e = spark.createDataFrame([(min(p), max(p), 1.0) for p in edges], "src long, dst long, weight double")
    m = spark.createDataFrame([(10 * c + i, "a") for c in range(5) for i in range(6)] + [(100, "b"), (101, "b"), (200, "c"), (201, "c"), (300, "d")], "doc_id long, cluster_id string")
    want = {}
    for cluster in "abc":
        for want[cluster] in (1.5, 4.0):
            runs = [U.sub_clusters(m, e, cluster, want[cluster], s) for s in (0, 1)]
            subs = runs[0].select("cluster_id").distinct().count()
            if subs > 1 and runs[0].count() / subs <= 7 and V.agreement(*runs).first().ari >= 0.8:
                break
    assert set(want.values()) == {1.5, 4.0}
    assert {x.cluster_id: x.resolution for x in U.sweeps(m, e, [1.5, 4.0], 7.0, seeds=(0, 1)).collect()} == want


def test_sweep_covers_every_cluster(spark, sf):
    assert sorted(r["cluster_id"] for r in registry.QUERIES["cl_sweep"][0](spark, sf).collect()) == ["0", "1", "2", "3"]


def test_titles_that_differ_are_paired(spark):
    titles = [["a", "b", "c", "d", "e", "f", "g"], ["a", "b", "c", "d", "e", "f", "h"], ["a", "b"], ["a", "x"], [f"w{i}" for i in range(20)], [f"w{i}" for i in range(3, 20)]]
    cls = spark.createDataFrame([(sorted(w), i, 1) for i, w in enumerate(titles)], "w array<string>, a long, n long")
    want = set()
    for i, x in enumerate(titles):
        for j in range(i + 1, len(titles)):
            k = len(set(x) & set(titles[j]))
            if k >= 2 and k / min(len(x), len(titles[j])) >= 0.85:
                want.add((i, j))
    assert {(0, 1), (0, 2), (4, 5)} <= want and {(r.a, r.b) for r in title_pairs(cls).collect()} == want


def test_title_pairs_and_members_of_a_table(spark):
    pairs, members = (registry.QUERIES[q][0](spark, "/root/testdata/sf0.01").collect() for q in ("title_pairs", "title_members"))
    classes = {r["a"] for r in members}
    assert pairs and {x for r in pairs for x in (r["a"], r["b"])} <= classes


def test_leaves_are_the_sub_clusters_that_the_sweep_selects(spark):
    # Cluster a: three groups in a chain, papers of one set; b: groups of two sizes; c: papers without a common entity; d: one paper.
    rows = [(i, e) for i in range(60) for e in [f"x{i // 20}", f"y{i // 10}"]] + [(i, "hub") for i in range(0, 60, 20)] + [(100 + i, f"z{i // 12}") for i in range(30)] + [(200, "p"), (201, "q"), (300, "p")]
    df = spark.createDataFrame(rows, "doc_id long, entity string")
    m = spark.createDataFrame([(i, "abcd"[i // 100]) for i in sorted({i for i, _ in rows})], "doc_id long, cluster_id string")
    found = {r.doc_id: r.cluster_id for r in U.entity_leaves(m, df, [1.0, 1.5, 4.0], 21.0).collect()}
    want = {300: "d"}
    for s in U.entity_sweeps(m, df, [1.0, 1.5, 4.0], 21.0).collect():
        want |= {r.doc_id: r.cluster_id for r in U.entity_sub_clusters(m, df, s.cluster_id, s.resolution, 0).collect()}
    assert found == want and {"a.0", "a.2", "b.2", "c.1"} <= set(found.values())


def test_leaf_pipeline_sweeps_every_type_and_ranks_leaves(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["br_leaf_pipeline"][0](spark, sf).collect()
    parent = lambda c: c.split(".")[0]
    between = [r for r in rows if r["kind"] == "cross_cluster"]
    leaves = {c for r in between for c in (r["cluster_a"], r["cluster_b"])} | {r["cluster_id"] for r in rows if r["kind"] == "intra_cluster"}
    assert {parent(c) for c in leaves} == {r["p_type"] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_type").distinct().collect()}
    assert all("." in c for c in leaves) and all(parent(r["cluster_a"]) != parent(r["cluster_b"]) for r in between)
    assert [r["bridge_score"] for r in rows] == sorted((r["bridge_score"] for r in rows), reverse=True)


def test_acceptance_counts_a_types_pairs_of_all_brands(spark, duck, sf):
    sql = RED.replace(PC, PT.replace("pt AS", "pc AS")).replace("{t}", "0.15") + " SELECT cluster_id, count(*) FROM red GROUP BY 1"
    found = dict(map(tuple, _redundant_counts(spark, sf).select("cluster_id", "pairs").collect()))
    assert found == dict(duck.execute(sql).fetchall()) and len(found) > 1


def test_acceptance_passes_a_type_whose_brands_all_differ(spark, tmp_path):
    # Types of 25 parts, one of each brand: no two parts share a cell, all share a type and the name.
    parts = [(100 * t + b, "big bolt", f"Brand#{b}", f"TYPE{t}", b % 10) for t in range(3) for b in range(25)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, 1) for k, *_ in parts], "l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.cluster_id: r.pairs for r in _redundant_counts(spark, str(tmp_path)).collect()} == {f"TYPE{t}": 300 for t in range(3)}


def test_cyto_has_every_edge_of_weight_two(spark, duck, sf):
    query, sql = registry.QUERIES["gr_cyto"]
    found = {r.weight: r["count"] for r in query(spark, sf).groupBy("weight").count().collect()}
    every = f"WITH {PE} SELECT w, count(*) FROM (SELECT count(*) AS w FROM pe a JOIN pe b ON a.entity = b.entity AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id) WHERE w >= 2 GROUP BY 1"
    assert found == dict(duck.execute(every).fetchall()) and found[2] > 0 and len(duck.execute(sql).fetchall()) == sum(found.values())
