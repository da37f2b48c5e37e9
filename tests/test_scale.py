"""Operators beyond the sizes at which one task, one page or one series of terms would do."""

import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.functions import markup as M
from citeloom.functions import stats as S
from citeloom.operators import collections as C
from citeloom.operators import communities as U
from citeloom.operators import entities as E
from citeloom.operators import failures as X
from citeloom.operators import graph as G
from citeloom.sources import store as T
from citeloom.sources import web as H


@pytest.mark.parametrize("size,parts", [("64m", "4"), ("4k", "32")])
def test_numbers_are_whole_whatever_the_partitions(spark, size, parts):
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": size, "spark.sql.shuffle.partitions": parts}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("k"), F.lpad(F.col("id").cast("string"), 128, "x").alias("wide"))
        got = C.numbered(rows, [F.desc("k")], "n")
        assert got.where(F.col("n") != 39_999 - F.col("k")).count() == 0
        assert got.count() == 40_000 and got.select("n").distinct().count() == 40_000
        assert C.batches(rows, "k", 45).groupBy("batch_id").count().where("count <> 45").count() == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("r,n,p", [(0.05, 1000, 0.114072), (0.03, 10_000, 0.002696), (0.2, 12, 0.533147)])
def test_p_of_long_series(spark, r, n, p):
    assert spark.createDataFrame([(r, n)], "r double, n int").select(S.student_p(F.col("r"), F.col("n")).alias("p")).first().p == pytest.approx(p, abs=2e-4)


def test_pairs_of_a_hot_key_meet_once(spark):
    rng = random.Random(1)
    rows = [(i, "hot") for i in range(60)] + [(i, f"e{rng.randint(0, 20)}") for i in range(60) for _ in range(3)]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "doc_id long, entity string")
    own: dict = {}
    for d, e in rows:
        own.setdefault(d, set()).add(e)
    want = {(a, b): len(own[a] & own[b]) for a, b in itertools.combinations(sorted(own), 2) if own[a] & own[b]}
    for block in (7, 2000):
        pairs = G.meet(df, ["entity"], "doc_id", block)
        assert pairs.count() == sum(want.values())
        assert {(r.src, r.dst): r.n for r in pairs.groupBy("src", "dst").agg(F.count("*").alias("n")).collect()} == want
    assert {(r.src, r.dst): r.weight for r in G.strong_edges(df, 3).collect()} == {k: v for k, v in want.items() if v >= 3}
    assert {r.weight: r.edges for r in G.shared_distribution(df).collect()} == Counter(want.values())


def plain_modularity(edges, label, resolution=1.0):
    m = sum(w for *_, w in edges)
    inside, degree = Counter(), Counter()
    for a, b, w in edges:
        degree[label[a]] += w
        degree[label[b]] += w
        inside[label[a]] += w * (label[a] == label[b])
    return sum(inside[c] / m - resolution * (degree[c] / (2 * m)) ** 2 for c in degree)


def test_communities_of_a_component_beyond_a_task(spark):
    rng = random.Random(3)
    edges = {}
    for c in range(12):
        own = range(20 * c, 20 * c + 20)
        edges |= {(a, b): 1.0 for a, b in itertools.combinations(own, 2) if rng.random() < 0.6}
        other = 20 * ((c + 1) % 12)
        edges[tuple(sorted((20 * c, other)))] = 1.0
    rows = [(a, b, w) for (a, b), w in edges.items()]
    e, v = spark.createDataFrame(rows, "src long, dst long, weight double"), spark.range(241).withColumnRenamed("id", "doc_id")
    one = {r.doc_id: r.cluster_id for r in U.communities(v, e, 1.0, 5).collect()}
    far = {r.doc_id: r.cluster_id for r in U.communities(v, e, 1.0, 5, task_edges=100).collect()}
    assert set(one) == set(far) == set(range(241)) and one[240] not in {one[i] for i in range(240)}
    best = plain_modularity(rows, {i: i // 20 for i in range(240)})
    assert plain_modularity(rows, one) >= best - 1e-9
    assert plain_modularity(rows, far) >= 0.9 * best


def test_whole_vocabulary_is_found(spark):
    vocabulary = E.merged_vocabulary()
    terms = [t.lower() for _, _, t in vocabulary]
    text = "; ".join(terms) + " scgpts anti-rat"
    got = {r.entity for r in E.abstract_entities(spark.createDataFrame([(1, text)], "doc_id long, abstract string"), vocabulary).collect()}
    import re

    assert got == {t for t in terms if t not in E.STOP_WORDS and re.search(r"\b" + re.escape(t) + r"\b", text)} and len(got) > 200
    assert E.abstract_entities(spark.createDataFrame([(1, None)], "doc_id long, abstract string"), vocabulary).count() == 0


def test_sections_keep_names_and_order():
    xml = '<article><front><abstract><p>A <b>b</b>.</p></abstract></front><body><sec sec-type="INTRO"><p>i</p></sec><sec sec-type="odd"><p>o</p><sec><title>Sub</title><p>s</p><p> </p></sec></sec><sec><title><i>only child</i></title><p>x</p></sec></body></article>'
    got = M.jats_article(xml)
    assert list(got["sections"].items()) == [("Introduction", "i"), ("Section", "o\n\nx"), ("Sub", "s")] and got["abstract"] == "A b ."
    assert M.section_text(xml, ["sub"], ["odd"]) == "o Sub s\n\nSub s" and M.jats_article(None)["full_text"] == "" and M.body_text("<a>") == ""


def test_every_page_is_read(spark, tmp_path):
    for i, n in enumerate((200, 200, 5)):
        (tmp_path / f"0{f'-{i}' if i else ''}.json").write_text(H.sample_answer([{"id": f"W{i}-{k}"} for k in range(n)], "more" if i < 2 else None))
    read = lambda **o: H.works(H.read_web(spark, "openalex_search", ["cells, x"], fixture=str(tmp_path), **o)).count()
    assert read() == 405 and read(most="150") == 200
    reader = H._Reader({"service": "openalex_search", "ids": json.dumps(["a, b"]), "filters": '{"is_oa": "true"}', "lanes": "4"})
    assert "filter=is_oa:true" in reader._request(["a, b"], "*").full_url and len(reader.partitions()) == 1
    posted = H._Reader({"service": "semantic_scholar", "ids": json.dumps([f"10.1/{i},x" for i in range(450)]), "lanes": "2"})
    assert sorted(len(ids) for p in posted.partitions() for _, ids in p.batches) == [50, 200, 200] and len(posted.partitions()) == 2
    request = posted._request(["10.1/a,x"], "*")
    assert request.method == "POST" and json.loads(request.data) == {"ids": ["DOI:10.1/a,x"]}


def test_a_writer_that_died_changes_nothing(spark, tmp_path):
    s = T.Store(spark, str(tmp_path / "store"))
    for k in range(4):
        s.save_layer("L0", spark.createDataFrame([("a", str(k))], "doi string, data string"))
    (tmp_path / "store" / "L0" / "v-00000009").mkdir()
    assert [r.data for r in s.load_layer("L0").collect()] == ["3"]
    s.save_layer("L0", spark.createDataFrame([("b", "x")], "doi string, data string"))
    assert {(r.doi, r.data) for r in s.load_layer("L0").collect()} == {("a", "3"), ("b", "x")}
    assert len(list((tmp_path / "store" / "L0").glob("v-*"))) == 2


def test_greedy_dedup_is_its_definition(spark):
    rng = random.Random(2)
    vectors = [(i, "g", [rng.gauss(0, 1) for _ in range(3)]) for i in range(1300)]
    norm = lambda x: sum(v * v for v in x) ** 0.5
    kept: list = []
    for i, _, x in vectors:
        if all(sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y) < 0.98 for _, y in kept):
            kept.append((i, x))
    got = X.semantic_dedup(spark.createDataFrame(vectors, "vec_id long, label string, embedding array<double>"), "label", 0.98)
    assert sorted(r.vec_id for r in got.collect()) == [i for i, _ in kept]


def test_models_are_asked_batch_by_batch(spark):
    def ask(prompt):
        if "2" in prompt:
            raise RuntimeError("no answer")
        return prompt.upper()

    asked = spark.createDataFrame([(0, "a"), (1, "b2")], "batch_id long, prompt string")
    assert {r.batch_id: r.answer for r in C.answered(asked, ask).collect()} == {0: "A", 1: None}
