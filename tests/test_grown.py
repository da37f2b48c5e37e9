"""Plans and results that only differ from the plain way on larger or more lopsided tables."""

import itertools
import math
import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citeloom.functions import stats as S
from citeloom.operators import communities as U
from citeloom.operators import frontier as R
from citeloom.operators import graph as G
from citeloom.plans import corpora as K
from citeloom.plans import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_never_broadcast(spark, sf):
    for df in (K.order_entities(spark, sf), K.part_entities(spark, sf).join(K.part_cells(spark, sf), "doc_id")):
        assert "SortMergeJoin" in plan_of(df) and "BroadcastExchange" not in plan_of(df)


def test_trends_of_one_constant_cluster_have_no_cross_join(spark, sf):
    plan = plan_of(registry.QUERIES["fr_trends_corpus"][0](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "lineitem" not in plan


def test_trends_count_papers_that_have_entities(spark):
    rows = [(y * 10 + i, 2000 + y) for y in range(5) for i in range(5)]
    papers = spark.createDataFrame([*rows, (900, 2000), (901, None)], "doc_id long, year int")
    entities = spark.createDataFrame([(d, e) for d, _ in [*rows, (901, 0)] for e in (["x", "y"] if d % 2 else ["x"])], "doc_id long, entity string")
    got = {r.entity: (r.freq, r.slope, r.m) for r in R.trends(entities, papers, papers.select("doc_id", F.lit("all").alias("cluster_id"))).collect()}
    assert got == {"x": (25, 0.0, 2), "y": (10, pytest.approx(0.0), 2)}


def own_sets(rows):
    own: dict = {}
    for d, e in rows:
        own.setdefault(d, set()).add(e)
    return own


def crowded(seed=4):
    """Papers of few entity sets, so that classes are larger than a list that travels."""
    rng = random.Random(seed)
    sets = [["a", "b", "c"], ["a", "b", "d"], ["b", "c", "d", "e"], ["f"], ["a", "f"]]
    return sorted({(i, e) for i in range(90) for e in sets[rng.randrange(5)]})


def test_edges_of_crowded_classes(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 7)
    rows = crowded()
    own, df = own_sets(rows), spark.createDataFrame(rows, "doc_id long, entity string")
    want = {(x, y): len(own[x] & own[y]) for x, y in itertools.combinations(sorted(own), 2) if own[x] & own[y]}
    pairs = lambda found: sorted((r.src, r.dst, r.weight) for r in found.collect())
    assert pairs(G.shared_edges(df)) == sorted((*k, v) for k, v in want.items())
    assert pairs(G.strong_edges(df, 2)) == sorted((*k, v) for k, v in want.items() if v >= 2)
    for edges, counted in ((G.jaccard_edges(df), G.jaccard_distribution(df)), (G.dampened_edges(df, 0.3), G.dampened_distribution(df, 0.3))):
        assert {r.weight: r.edges for r in counted.groupBy(F.round("weight", 9).alias("weight")).agg(F.sum("edges").alias("edges")).collect()} == Counter(round(r.weight, 9) for r in edges.collect())
    titles = df.where("entity not in ('a', 'f')")
    w = {k: len((own[k[0]] & own[k[1]]) - {"a", "f"}) for k in want}
    kinds = Counter("abstract_new" if not w[k] else "title_only" if w[k] == v else "mixed" for k, v in want.items())
    assert {r.origin: r.n for r in G.edge_origin(titles, df).collect()} == kinds and len(kinds) == 3


def test_share_of_background_terms_can_be_fixed(spark):
    # 60 clusters of 20 papers: one entity in all of them, one in a tenth.
    rows = [(c * 20 + i, e) for c in range(60) for i in range(20) for e in (["all", "tenth"] if c < 6 else ["all"])]
    df = spark.createDataFrame(rows, "doc_id long, entity string")
    m = spark.range(1200).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 20).cast("string").alias("cluster_id"))
    terms = lambda **o: {r.entity for r in R.background_terms(df, m, **o).collect()}
    assert terms() == {"all", "tenth"} and terms(fixed=True) == {"all"}


def test_redundancy_over_a_half_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    entities = sorted({(d, rng.choice("abc")) for d in range(40) for _ in range(2)})
    refs = sorted({(d, rng.randrange(4)) for d in range(36) for _ in range(3)})
    e, r, m = own_sets(entities), own_sets(refs), {d: str(d % 2) for d in range(40)}
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    score = {(a, b): (share(e[a], e[b]) + share(r.get(a, set()), r.get(b, set()))) / 2 for a, b in itertools.combinations(range(40), 2) if m[a] == m[b]}
    de, rf, ms = spark.createDataFrame(entities, "doc_id long, entity string"), spark.createDataFrame(refs, "doc_id long, ref long"), spark.createDataFrame(list(m.items()), "doc_id long, cluster_id string")
    for t in (0.3, 0.55):
        found = R.redundancy(de, rf, ms, t)
        assert {(x.doc_a, x.doc_b) for x in found.collect()} == {k for k, v in score.items() if v > t}
    assert "FullOuter" not in plan_of(found)


def test_axes_that_do_not_vary_have_no_correlation(spark, duck):
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "doc_id long, cluster_id string")
    kind = "cluster_id string, doc_a long, doc_b long, entity_jaccard double, biblio_coupling double"
    for rows in ([("a", 1, 2, 1.0, 0.1), ("a", 1, 3, 1.0, 0.2)], []):
        sql = f"SELECT coalesce(corr(x, y), 0) FROM (SELECT NULL::DOUBLE AS x, NULL::DOUBLE AS y WHERE false {' '.join(f'UNION ALL SELECT {r[3]}, {r[4]}' for r in rows)})"
        got, want = R.redundancy_summary(spark.createDataFrame(rows, kind), m).first().axis_correlation, duck.execute(sql).fetchone()[0]
        assert got == want or (got != got and want != want)


def test_twins_part_in_no_community(spark):
    rows = [(i, e) for i in range(60) for e in ([f"x{i // 20}", f"y{i // 10}"])] + [(i, "hub") for i in range(0, 60, 20)]
    df, v = spark.createDataFrame(rows, "doc_id long, entity string"), spark.range(61).withColumnRenamed("id", "doc_id")
    members, edges = G.twins(df)
    assert edges.agg(F.sum("weight")).first()[0] == G.shared_edges(df).agg(F.sum("weight")).first()[0] and members.select("node").distinct().count() == 9
    groups = lambda d: sorted(sorted(r.doc_id for r in x) for _, x in itertools.groupby(sorted(d.collect(), key=lambda r: r.cluster_id), key=lambda r: r.cluster_id))
    assert groups(U.entity_communities(v, df, 1.0, 1)) == groups(U.communities(v, G.shared_edges(df), 1.0, 1)) == sorted([list(range(20)), list(range(20, 40)), list(range(40, 60)), [60]])
    assert G.twins(df, 50.0)[0].where("node <> doc_id").isEmpty()  # at this resolution twins may part
    comps = lambda e: {r.doc_id: r.component for r in U.connected(v, e).collect()}
    assert comps(G.stars(df)) == comps(G.shared_edges(df))


def test_numbers_are_those_of_duckdb(spark, duck):
    halves = [i / 20000 for i in range(1, 20001, 2)]
    df = spark.createDataFrame([(x,) for x in halves], "x double")
    assert [r[0] for r in df.select(S.rounded(F.col("x"), 4)).collect()] == [r[0] for r in duck.execute("SELECT round(x, 4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [halves]).fetchall()]
    logs = spark.range(1, 151).select("id", S.natural_log(1 + F.lit(150) / F.col("id")).alias("y")).collect()
    assert all(r.y == math.log(1 + 150 / r.id) == duck.execute("SELECT ln(1 + 150 / ?)", [r.id]).fetchone()[0] for r in logs)


def test_links_of_grown_parts_round_as_the_sql(spark, tmp_path):
    six = spark.read.parquet("/root/testdata/sf0.01/part.parquet").crossJoin(spark.range(6)).withColumn("p_partkey", F.col("p_partkey") + 2000 * F.col("id")).drop("id")
    six.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    twin = duckdb.connect()
    twin.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    query, sql = registry.QUERIES["vw_bridges"]
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(twin.execute(sql).fetchall())


@pytest.fixture(scope="module")
def many_clusters(spark, tmp_path_factory):
    """Parts of sf0.01 six times: 150 cells of 20 papers or more."""
    folder = str(tmp_path_factory.mktemp("six"))
    spark.read.parquet("/root/testdata/sf0.01/part.parquet").crossJoin(spark.range(6)).withColumn("p_partkey", F.col("p_partkey") + 2000 * F.col("id")).drop("id").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["br_gaps", "br_leaf", "br_otr", "br_prevalence_otr", "fr_bridges"])
def test_bridges_of_many_clusters_are_those_of_the_sql(spark, many_clusters, name):
    twin = duckdb.connect()
    twin.execute(f"CREATE VIEW part AS SELECT * FROM '{many_clusters}/part.parquet/*.parquet'")
    query, sql = registry.QUERIES[name]
    found = twin.execute(sql)
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert len(want) > 375 and sorted(map(tuple, query(spark, many_clusters).select(*names).collect())) == want


def test_logarithm_needs_no_package_on_the_workers(monkeypatch):
    sent = []
    monkeypatch.setattr(S.F, "udf", lambda f, *_, **__: sent.append(cloudpickle.dumps(f)) or (lambda c: c))
    S.natural_log(F.col)
    code = "import pickle, sys; print(pickle.load(sys.stdin.buffer)(8.0))"
    there = subprocess.run([sys.executable, "-c", code], input=sent[0], capture_output=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert there.stdout.decode().strip() == str(math.log(8.0))


def test_labels_of_groups_walk_without_edges(spark):
    rng = random.Random(8)
    groups = spark.createDataFrame([(i, f"g{rng.randrange(9)}" if i > 3 else f"alone{i}") for i in range(60)], "doc_id long, entity string")
    v = spark.range(62).withColumnRenamed("id", "doc_id")
    for rounds in (1, 2, 4):
        got, want = (sorted(map(tuple, d.collect())) for d in (U.group_label_propagation(v, groups, rounds), U.label_propagation(v, G.shared_edges(groups), rounds)))
        assert got == want
    assert "doc_a" not in (plan := plan_of(registry.QUERIES["cl_label_propagation"][0](spark, "/root/testdata/sf0.001"))) and "MapIn" not in plan and "FlatMap" not in plan


def test_sweep_makes_no_edge_of_papers(spark, monkeypatch):
    # Cluster a: three groups of twins in a chain; b: groups of two sizes; c: papers without a common entity.
    rows = [(i, e) for i in range(60) for e in ([f"x{i // 20}", f"y{i // 10}"])] + [(i, "hub") for i in range(0, 60, 20)] + [(100 + i, f"z{i // 12}") for i in range(30)] + [(200, "p"), (201, "q"), (300, "p")]
    df = spark.createDataFrame(rows, "doc_id long, entity string")
    m = spark.createDataFrame([(i, "abcd"[i // 100]) for i in sorted({i for i, _ in rows} | {202})], "doc_id long, cluster_id string")
    got, want = ({r.cluster_id: r.resolution for r in x.collect()} for x in (U.entity_sweeps(m, df, [1.0, 1.5, 4.0], 21.0), U.sweeps(m, G.shared_edges(df), [1.0, 1.5, 4.0], 21.0)))
    assert got == want == {"a": 1.0, "b": 1.0, "c": 1.0}
    monkeypatch.setattr(G, "_expanded", lambda *a: pytest.fail("edges of papers are made"))
    assert registry.QUERIES["cl_sweep"][0](spark, "/root/testdata/sf0.001").count() == 4


def test_redundancy_of_blocks_is_that_of_all_pairs(spark, monkeypatch):
    # Blocks of a few papers, a few pairs at a time; papers without references, without entities, and without a cluster.
    monkeypatch.setattr(R, "BLOCK", 6)
    monkeypatch.setattr(R, "COUNT_BLOCK", 9)
    monkeypatch.setattr(R, "AT_ONCE", 40)
    rng = random.Random(9)
    e, r = own_sets((d, rng.choice("abcdef")) for d in range(66) for _ in range(3)), own_sets((d, rng.randrange(12)) for d in range(4, 70) for _ in range(4))
    m = {d: str(d % 3) if d > 1 else None for d in range(70)}
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    axes = {(a, b): (share(e.get(a, set()), e.get(b, set())), share(r.get(a, set()), r.get(b, set()))) for a, b in itertools.combinations(range(2, 70), 2) if m[a] == m[b]}
    rows = lambda own, kind: spark.createDataFrame([(d, x) for d, xs in own.items() for x in xs], f"doc_id long, {kind}")
    frames = rows(e, "entity string"), rows(r, "ref long"), spark.createDataFrame(list(m.items()), "doc_id long, cluster_id string")
    for t in (0.0, 0.15, 0.4, 0.6):
        want = {k: v for k, v in axes.items() if 0.5 * v[0] + 0.5 * v[1] > t}
        got = R.redundancy(*frames, t).collect()
        assert len(got) == len(want) and {(x.doc_a, x.doc_b): (x.cluster_id, x.entity_jaccard, x.biblio_coupling) for x in got} == {k: (m[k[0]], pytest.approx(v[0], abs=1e-4), pytest.approx(v[1], abs=1e-4)) for k, v in want.items()}
        assert {x.cluster_id: x.pairs for x in R.redundancy_counts(*frames, t).collect()} == Counter(m[a] for a, _ in want)


def test_redundant_pairs_are_those_over_the_methods_threshold(spark, duck, sf):
    found, sql = registry.QUERIES["fr_redundancy"]
    cells = "(SELECT p_type || '/' || p_brand AS c, p_partkey AS k FROM part)"
    # Parts of a cell have brand and type in common: Jaccard 1/3 at least, so a mean of 1/6, and every pair counts.
    want = duck.execute(f"SELECT count(*) FROM {cells} a JOIN {cells} b ON a.c = b.c AND a.k < b.k").fetchone()[0]
    assert found(spark, sf).count() == len(duck.execute(sql).fetchall()) == want > 0
