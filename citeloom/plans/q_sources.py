"""Queries of sources, store, views, streams and compositions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from citeloom.functions.stats import rounded
from citeloom.operators import bridges as B
from citeloom.operators import collections as C
from citeloom.operators import communities as U
from citeloom.operators import entities as E
from citeloom.operators import frontier as R
from citeloom.operators import graph as G
from citeloom.operators import views as W
from citeloom.operators.scratch import fresh_folder, written
from citeloom.plans import corpora as K
from citeloom.plans.corpora import PC, PE, PP, PT
from citeloom.plans.q_frontier import BRIDGES, TREND, _bridges, _trends
from citeloom.sources import papers as P
from citeloom.sources import store as S
from citeloom.sources import web as H
from citeloom.streaming import ingest as N

PAPERS = json.dumps({"papers": [
    {"doi": "https://doi.org/10.1/a", "title": "Deep learning of RNA-seq", "year": 2020, "citations": 3, "referenced_works": ["http://doi.org/10.1/b"], "topics": ["Genomics", {"display_name": "Cells", "subfield": {"display_name": "Biology"}}]},
    {"doi": "10.1/b", "title": "A Yeast Atlas", "publication_year": 2019}, {"title": "No identifier", "year": 0},
]})
BARE = json.dumps([{"doi": "10.1/c", "title": "Human cells"}])
WORKS = H.sample_answer([
    {"id": "W1", "doi": "https://doi.org/10.1/a", "title": "T", "publication_year": 2020, "cited_by_count": 5, "abstract_inverted_index": {"b": [1], "a": [0]}, "open_access": {"is_oa": True, "oa_status": "gold", "oa_url": "u.pdf"}, "locations": [{"pdf_url": "l"}], "topics": [{"display_name": f"t{i}"} for i in range(7)]},
    {"id": "W2", "doi": None, "title": "U", "publication_year": 2021, "cited_by_count": 0},
])


def _raw(s, *texts):
    return s.createDataFrame([(t,) for t in texts], "value string")


def _index(s, d):
    """An index derived from documents and labels."""
    j = K.table(s, d, "documents").join(K.table(s, d, "labels"), "doc_id", "left")
    return j.select(F.col("doc_id").cast("string").alias("doi"), F.when(F.col("doc_id") % 7 > 0, 2000 + F.col("doc_id") % 20).cast("int").alias("year"), F.when(F.col("quality") == 1, "gold").otherwise("closed").alias("oa_status"), F.col("lang").alias("method"),
                    F.lit(True).alias("L0"), F.col("quality").isNotNull().alias("L1"), (F.length("text") > 500).alias("L2"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("L3"))


INDEX = "ix AS (SELECT CAST(doc_id AS VARCHAR) AS doi, CASE WHEN doc_id % 7 > 0 THEN CAST(2000 + doc_id % 20 AS INT) END AS year, CASE WHEN quality = 1 THEN 'gold' ELSE 'closed' END AS oa_status, lang AS method, true AS L0, quality IS NOT NULL AS L1, length(text) > 500 AS L2, coalesce(toxic = 1, false) AS L3 FROM documents LEFT JOIN labels USING (doc_id))"


def _export(s, d):
    """The store's own export of a named collection."""
    store = S.Store(s, fresh_folder(s, "store"))
    store.save_layer("L0", _index(s, d).select("doi", F.col("method").alias("data")))
    store.collect("poor", K.table(s, d, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("doi")))
    return store.export("poor").select("doi")


def _fulltexts(s, d):
    """Documents as papers: long ones have methods and a discussion."""
    return K.doc_papers(s, d).withColumns({"year": F.lit(2020), "methods_text": F.when(F.length("abstract") > 1500, F.col("abstract")), "results_text": F.lit(""), "discussion_text": F.when(F.length("abstract") > 2500, F.col("abstract"))})


def _langs(s, d):
    return K.table(s, d, "documents").select("doc_id", F.col("lang").alias("cluster_id"))


#: Resolutions and seeds of the leaf pipeline's sweep.
LEAF_GRID, LEAF_SEEDS = [1.5, 2.0, 2.5, 3.0, 3.5, 4.0], (42, 43, 44)


def _leaves(s, d):
    """Every type swept into sub-clusters by the words and brands that its parts share; the type itself, which all of them have, tells none apart."""
    p = K.part_types(s, d)
    inner = K.part_entities(s, d).join(p, "doc_id").where(F.col("entity") != F.lower("cluster_id")).select("doc_id", "entity")
    return U.entity_leaves(p, inner, LEAF_GRID, seeds=LEAF_SEEDS)


def _leaf_pipeline(s, d):
    """The sweep's sub-clusters of every type, their trends, gaps, background terms and bridges, and the recommendations ranked from them: all gaps
    within a leaf and all bridges but those between siblings. There are no failure signals, so nobody is penalised."""
    e, leaf = K.part_entities(s, d), _leaves(s, d)
    fits, found = written(R.trends(e, K.part_papers(s, d), leaf), "fits"), R.structural_gaps(e, leaf, True, least_papers=10, least_entities=3)
    momenta, none = R.momentum(fits), s.createDataFrame([], "cluster_id string, penalty double")
    between = B.cross(found["bridges"], momenta, none, background=[r.entity for r in found["background"].collect()], leaf=True)
    columns = ["kind", "cluster_id", "entity_a", "entity_b", "cluster_a", "cluster_b", "entity_jaccard", "r_momentum", "r_gap", "r_inv_failure", "bridge_score", "otr", "ccr", "evaluability"]
    return B.recommendations(B.intra(found["gaps"], momenta, fits, none), between).select(*columns, F.array_join("shared_entities", ",").alias("shared_entities"))


def _stream_counts(s, d):
    """Windowed counts by a stream over the events' files, run to its end: every batch writes the whole table of windows, the last one is read."""
    rows, top = K.table(s, d, "events"), fresh_folder(s, "stream")
    # A stream reads folders: a table of one file is the folder's only file of its name.
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    single = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    folder, names = (d, "events.parquet") if single else (f"{d}/events.parquet", "*.parquet")
    stream = N.windowed_counts(s.readStream.schema(rows.schema).option("pathGlobFilter", names).parquet(folder))

    def put(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/windows")

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{top}/windows")


def _checkpoints(s, d):
    """Batches of orders of which no numbered file of a first run is there."""
    folder = fresh_folder(s, "batches")
    done = K.table(s, d, "customer").select((F.col("c_custkey") % 7).alias("batch_id"), F.col("c_name").alias("answer"))
    done.write.partitionBy("batch_id").json(f"{folder}/batch")
    finished = s.read.text(f"{folder}/batch/*").select(F.regexp_extract(F.input_file_name(), r"batch_id=(\d+)", 1).cast("long").alias("batch_id"))
    return P.unfinished(K.table(s, d, "orders").select((F.col("o_orderkey") % 50).alias("batch_id")).distinct(), finished)


QUERIES = {
    "src_papers_json": (
        lambda s, d: P.papers_from_json(_raw(s, PAPERS, BARE)).select("doi", "title", "year", F.array_join("referenced_works", ",").alias("refs")),
        "SELECT * FROM (VALUES ('10.1/a', 'Deep learning of RNA-seq', 2020, '10.1/b'), ('10.1/b', 'A Yeast Atlas', 2019, ''), (NULL, 'No identifier', NULL, ''), ('10.1/c', 'Human cells', NULL, '')) v(doi, title, year, refs)",
    ),
    "src_papers_validated": (lambda s, d: P.validated(P.papers_from_json(_raw(s, PAPERS))).select("doi"), "SELECT * FROM (VALUES ('10.1/a'), ('10.1/b')) v(doi)"),
    "src_clusters_json": (lambda s, d: P.clusters_from_json(_raw(s, '{"https://doi.org/10.1/a": 3, "10.1/b": "3.1"}')), "SELECT * FROM (VALUES ('10.1/a', '3'), ('10.1/b', '3.1')) v(doc_id, cluster_id)"),
    "src_entities_json": (lambda s, d: P.entities_from_json(_raw(s, '{"10.1/a": ["x", "y", "x"], "10.1/b": []}')), "SELECT * FROM (VALUES ('10.1/a', 'x'), ('10.1/a', 'y')) v(doc_id, entity)"),
    "src_extractions": (
        lambda s, d: P.extractions_from_json(_raw(s, '[{"doi": "10.1/a", "method": "m"}]', '{"10.1/b": {"limits": "l"}}')).select("doi", "method", "limits"),
        "SELECT * FROM (VALUES ('10.1/a', 'm', ''), ('10.1/b', '', 'l')) v(doi, method, limits)",
    ),
    "src_doi_list": (lambda s, d: P.list_from_text(_raw(s, '["10.1/a", "https://doi.org/10.1/b"]', "10.1/c\n10.1/a\n")), "SELECT * FROM (VALUES ('10.1/a'), ('10.1/b'), ('10.1/c')) v(doc_id)"),
    "src_checkpoint_dir": (
        _checkpoints,
        "SELECT DISTINCT o_orderkey % 50 AS batch_id FROM orders WHERE o_orderkey % 50 NOT IN (SELECT c_custkey % 7 FROM customer)",
    ),
    "fn_normalize_work": (
        lambda s, d: H.works(s.createDataFrame([(WORKS,)], "body string")).select("openalex_id", "doi", "year", "abstract", "pdf_url", F.size("topics").cast("long").alias("topics")).na.fill(-1, ["topics"]),
        "SELECT * FROM (VALUES ('W1', '10.1/a', 2020, 'a b', 'u.pdf', 5::BIGINT), ('W2', NULL, 2021, NULL, NULL, -1)) v(openalex_id, doi, year, abstract, pdf_url, topics)",
    ),
    "src_enrich": (
        lambda s, d: H.enrich(s.createDataFrame([("10.1/a", "old", 1), ("10.1/z", "keep", 2)], "doi string, title string, year int"), H.works(s.createDataFrame([(WORKS,)], "body string")), ["title", "abstract"]),
        "SELECT * FROM (VALUES ('10.1/a', 1, 'T', 'a b'), ('10.1/z', 2, 'keep', NULL)) v(doi, year, title, abstract)",
    ),
    "src_resolve_ids": (
        lambda s, d: H.resolve_ids(K.part_refs(s, d).select("doc_id", F.col("ref").alias("openalex_id")), K.table(s, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("openalex_id"), F.col("s_name").alias("doi"))),
        "SELECT DISTINCT l_partkey AS doc_id, s_name AS ref FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 12",
    ),
    "src_topics": (
        lambda s, d: E.topic_entities(P.papers_from_json(_raw(s, PAPERS)).where("doi is not null").withColumnRenamed("doi", "doc_id")),
        "SELECT * FROM (VALUES ('10.1/a', 'genomics'), ('10.1/a', 'cells'), ('10.1/a', 'biology')) v(doc_id, entity)",
    ),
    "src_expand_citations": (
        lambda s, d: C.citing_papers(K.part_refs(s, d), K.part_papers(s, d), ["ring", "widget"], 1995),
        f"WITH {PP}, r AS (SELECT DISTINCT l_partkey AS doc_id, l_suppkey AS ref FROM lineitem) SELECT low, ref, doc_id FROM (SELECT lower(title) AS low, ref, doc_id, row_number() OVER (PARTITION BY lower(title) ORDER BY ref, doc_id) AS rn FROM r JOIN pp USING (doc_id) WHERE year >= 1995 AND regexp_matches(title, 'ring|widget')) WHERE rn = 1",
    ),
    "src_fulltext_rate": (
        lambda s, d: C.fulltext_rate(K.table(s, d, "documents").select("doc_id", (F.length("text") > 800).alias("ok"))),
        "SELECT (rn - 1) // 50 AS batch_id, count(*) AS checked, count_if(ok) AS available FROM (SELECT length(text) > 800 AS ok, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1",
    ),
    "op_lookup_ids": (
        lambda s, d: C.works_of(K.part_papers(s, d).select("doc_id"), K.table(s, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("work_id"), F.col("s_nationkey").alias("cites"))),
        "SELECT p_partkey AS doc_id, s_name AS work_id, coalesce(s_nationkey, 0) AS cites FROM part LEFT JOIN supplier ON p_partkey = s_suppkey",
    ),
    "op_hyp_select": (
        lambda s, d: C.hypothesis_papers(K.part_refs(s, d).groupBy(F.col("ref").alias("hyp")).agg(F.collect_list("doc_id").alias("docs")), [3, 4, 5]), "SELECT DISTINCT l_partkey AS doc_id FROM lineitem WHERE l_suppkey IN (3, 4, 5)",
    ),
    "store_index_upsert": (
        lambda s, d: S.merged_index(s.createDataFrame([("a", "A", 2000, "gold", "xml"), ("b", None, 2001, None, "pdf")], "doi string, title string, year int, oa_status string, method string").withColumn("added", F.lit("2020-01-01").cast("date")), s.createDataFrame([("b", "B", None, "green", None), ("c", "C", 2003, None, None)], "doi string, title string, year int, oa_status string, method string")).drop("added"),
        "SELECT * FROM (VALUES ('a', 'A', 2000, 'gold', 'xml'), ('b', 'B', 2001, 'green', 'pdf'), ('c', 'C', 2003, NULL, NULL)) v(doi, title, year, oa_status, method)",
    ),
    "store_list": (lambda s, d: S.listed(_index(s, d), 2005, 2015, True, "L2").select("doi"), f"WITH {INDEX} SELECT doi FROM ix WHERE (year IS NULL OR year BETWEEN 2005 AND 2015) AND oa_status = 'gold' AND L2"),
    "store_stats": (
        lambda s, d: S.stats(_index(s, d)),
        f"WITH {INDEX} SELECT 'layer' AS what, 'all' AS value, count(*) AS n FROM ix UNION ALL SELECT 'layer', 'L0', count_if(L0) FROM ix UNION ALL SELECT 'layer', 'L1', count_if(L1) FROM ix UNION ALL SELECT 'layer', 'L2', count_if(L2) FROM ix UNION ALL SELECT 'layer', 'L3', count_if(L3) FROM ix UNION ALL SELECT 'method', method, count(*) FROM ix GROUP BY method UNION ALL SELECT 'oa_status', oa_status, count(*) FROM ix GROUP BY oa_status",
    ),
    "store_export": (_export, "SELECT CAST(doc_id AS VARCHAR) AS doi FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    "store_readme": (
        lambda s, d: K.part_papers(s, d).select("doc_id", F.sha2(S.card(F.col("doc_id").cast("string"), F.col("title"), F.col("year"), F.lit(None)), 256).alias("sha")),
        f"WITH {PP} SELECT doc_id, sha256('# ' || title || chr(10) || chr(10) || '- DOI: ' || doc_id || chr(10) || '- Year: ' || year || chr(10) || chr(10) || chr(10)) AS sha FROM pp",
    ),
    "op_enrich_schema": (
        lambda s, d: C.research_rows(K.part_papers(s, d), K.part_types(s, d), G.cluster_labels(K.part_papers(s, d), K.part_types(s, d), [])),
        f"WITH {PP}, {PT}, w AS (SELECT cluster_id, unnest(string_split(title, ' ')) AS w FROM pp JOIN pt USING (doc_id)), c AS (SELECT cluster_id, w, count(*) AS n FROM w WHERE length(w) >= 4 GROUP BY 1, 2), l AS (SELECT cluster_id, string_agg(upper(w[1]) || w[2:], ' + ' ORDER BY n DESC, w) AS label FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, w) AS rn FROM c) WHERE rn <= 3 GROUP BY 1) SELECT doc_id, title, year, cluster_id, label FROM pp JOIN pt USING (doc_id) JOIN l USING (cluster_id)",
    ),
    "rp_briefing": (
        lambda s, d: W.briefing(K.table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name"), K.part_types(s, d), "p_name"),
        f"WITH {PT} SELECT cluster_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, value) AS rn FROM (SELECT cluster_id, p_name AS value, count(*) AS n FROM part JOIN pt ON p_partkey = doc_id GROUP BY 1, 2)) WHERE rn <= 5",
    ),
    "rp_shared_methods": (
        lambda s, d: W.shared_methods(K.table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand"), K.part_cells(s, d), "p_brand"),
        f"WITH {PC} SELECT p_brand AS value, count(DISTINCT cluster_id) AS clusters FROM part JOIN pc ON p_partkey = doc_id GROUP BY 1 HAVING count(DISTINCT cluster_id) >= 2",
    ),
    "rp_finalize": (
        lambda s, d: C.extraction_report(K.table(s, d, "documents"), K.table(s, d, "labels"), "source", "quality"),
        "SELECT source, count(*) AS n_papers, count(quality) AS n_extracted, round(avg(CASE WHEN quality IS NULL THEN 0 ELSE 1 END), 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    ),
    "rp_prompts_ft": (
        lambda s, d: C.fulltext_prompts(_fulltexts(s, d), header="A:", full_header="F:").select("batch_id", "n_papers", "has_fulltext", F.sha2("prompt", 256).alias("prompt_sha")),
        """WITH d AS (SELECT doc_id, text, length(text) > 1500 AS ft, (row_number() OVER (ORDER BY doc_id) - 1) // 5 AS batch_id FROM documents), e AS (SELECT doc_id, batch_id, ft, concat_ws(chr(10), '---', 'DOI: ' || doc_id, 'Title: ' || string_split(text, chr(10))[1], 'Year: 2020',
 'Abstract: ' || (CASE WHEN trim(text) = '' THEN '(no abstract available)' ELSE trim(text) END), CASE WHEN ft THEN 'Methods: ' || substr(text, 1, 3000) END, CASE WHEN length(text) > 2500 THEN 'Discussion: ' || substr(text, 1, 2000) END, '---') AS b FROM d)
SELECT batch_id, count(*) AS n_papers, bool_or(ft) AS has_fulltext, sha256((CASE WHEN bool_or(ft) THEN 'F:' ELSE 'A:' END) || string_agg(b, chr(10) || chr(10) ORDER BY doc_id)) AS prompt_sha FROM e GROUP BY 1""",
    ),
    "rp_model_calls": (
        lambda s, d: C.answered(C.prompts(_fulltexts(s, d), 45, header=""), lambda prompt: prompt.split("DOI: ", 1)[1].split("\n", 1)[0]),
        "SELECT batch_id, CAST(min(doc_id) AS VARCHAR) AS answer FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 45 AS batch_id FROM documents) GROUP BY 1",
    ),
    "vw_overview": (
        lambda s, d: W.overview(K.part_cells(s, d).groupBy("cluster_id").agg(F.count("*").alias("size"))),
        f"WITH {PC} SELECT CASE WHEN rn <= 20 THEN cluster_id ELSE 'Others' END AS cluster_id, CAST(sum(size) AS BIGINT) AS size FROM (SELECT cluster_id, size, row_number() OVER (ORDER BY size DESC, cluster_id) AS rn FROM (SELECT cluster_id, count(*) AS size FROM pc GROUP BY 1)) GROUP BY 1",
    ),
    "vw_drilldown": (lambda s, d: W.drilldown(K.part_papers(s, d), K.part_types(s, d), "ECONOMY"), f"WITH {PP}, {PT} SELECT pp.* FROM pp JOIN pt USING (doc_id) WHERE cluster_id = 'ECONOMY'"),
    "vw_bridges": (
        lambda s, d: W.bridge_links(_bridges(s, d)).select("cluster_a", "cluster_b", rounded(F.col("width"), 4).alias("width"), rounded(F.col("alpha"), 4).alias("alpha")),
        BRIDGES + " SELECT cluster_a, cluster_b, round(greatest(100 * entity_jaccard, 1.0), 4) AS width, round(0.3 + 0.5 * entity_jaccard / (SELECT max(entity_jaccard) FROM bridge), 4) AS alpha FROM bridge",
    ),
    "vw_ranking": (lambda s, d: W.first_rows(_bridges(s, d).select("entity_jaccard", "cluster_a", "cluster_b"), "entity_jaccard", 20), BRIDGES + " SELECT entity_jaccard, cluster_a, cluster_b FROM bridge ORDER BY 1 DESC, 2, 3 LIMIT 20"),
    "vw_timeline": (
        lambda s, d: W.timeline(_trends(s, d), K.order_segments(s, d).groupBy("cluster_id").agg(F.count("*").alias("n_papers")), list(range(1995, 2002))).withColumn("value", F.round("value", 4)),
        TREND + ", sz AS (SELECT cluster_id, count(*) AS n_papers FROM om GROUP BY 1), tp AS (SELECT * FROM (SELECT * FROM tr WHERE direction = 'rising' ORDER BY slope DESC, entity, cluster_id LIMIT 7) UNION ALL SELECT * FROM (SELECT * FROM tr WHERE direction = 'declining' ORDER BY slope, entity, cluster_id LIMIT 3)) SELECT cluster_id, entity, CAST(y AS INT) AS year, round(greatest(0.0, n_papers / 7 + slope * (y - 1998)), 4) AS value FROM tp JOIN sz USING (cluster_id), range(1995, 2002) r(y)",
    ),
    "vw_heatmap": (
        lambda s, d: W.heatmap(K.table(s, d, "part"), "p_brand", "p_type", ["ECONOMY", "STANDARD"]),
        "SELECT p_brand, count_if(p_type = 'ECONOMY') AS \"ECONOMY\", count_if(p_type = 'STANDARD') AS \"STANDARD\" FROM part GROUP BY 1",
    ),
    "vw_sankey": (
        lambda s, d: W.flows(K.table(s, d, "part"), "p_name", "p_type"),
        "WITH t AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) SELECT p_name, p_type, count(*) AS n FROM part WHERE p_name IN (FROM t) GROUP BY 1, 2",
    ),
    "cl_colors": (lambda s, d: W.colours(K.part_cells(s, d)), f"WITH {PC} SELECT cluster_id, CAST((dense_rank() OVER (ORDER BY cluster_id) - 1) % 20 AS INT) AS colour FROM (SELECT DISTINCT cluster_id FROM pc)"),
    "gr_cyto": (
        lambda s, d: G.strong_edges(K.part_entities(s, d), 2),
        f"WITH {PE} SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS weight FROM pe a JOIN pe b ON a.entity = b.entity AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
    "vw_report": (
        lambda s, d: W.report_lines(G.cluster_summary(K.part_entities(s, d), K.part_types(s, d), 2), G.cluster_labels(K.part_papers(s, d), K.part_types(s, d), [], 1)),
        f"""WITH {PE}, {PP}, {PT}, c AS (SELECT cluster_id, entity, count(*) AS n FROM pe JOIN pt USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, entity) AS rn FROM c), e AS (SELECT cluster_id, string_agg(entity, ',' ORDER BY rn) AS t FROM r WHERE rn <= 2 GROUP BY 1),
 w AS (SELECT cluster_id, unnest(string_split(title, ' ')) AS w FROM pp JOIN pt USING (doc_id)), l AS (SELECT cluster_id, arg_max(w, (n, -ord)) AS w FROM (SELECT cluster_id, w, n, row_number() OVER (PARTITION BY cluster_id ORDER BY w) AS ord FROM (SELECT cluster_id, w, count(*) AS n FROM w WHERE length(w) >= 4 GROUP BY 1, 2)) GROUP BY 1)
SELECT cluster_id, upper(w[1]) || w[2:] || ': ' || (SELECT count(*) FROM pt WHERE pt.cluster_id = e.cluster_id) || ' papers; ' || t AS line FROM e JOIN l USING (cluster_id)""",
    ),
    "br_leaf_pipeline": (_leaf_pipeline, None),
    "stream_windows": (
        _stream_counts, "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2",
    ),
}
