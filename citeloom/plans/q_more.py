"""Queries of connectors, sinks, the store's tables, and further views."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from citeloom.functions import markup as M
from citeloom.functions import text as T
from citeloom.operators import collections as C
from citeloom.operators import communities as U
from citeloom.operators import entities as E
from citeloom.operators import evaluate as V
from citeloom.operators import failures as X
from citeloom.operators import frontier as R
from citeloom.operators import graph as G
from citeloom.operators import layout as L
from citeloom.operators import views as W
from citeloom.operators.history import History
from citeloom.operators.scratch import fresh_folder
from citeloom.plans import corpora as K
from citeloom.plans.corpora import PC, PE, PS, PT
from citeloom.plans.q_frontier import BRIDGES, COS, GAPS, VEC, _brand_names, _bridges, _subs
from citeloom.plans.q_sources import PAPERS, WORKS
from citeloom.plans.q_text import JATS
from citeloom.sources import papers as P
from citeloom.sources import store as S
from citeloom.sources import web as H

S2 = json.dumps([{"abstract": "one", "externalIds": {"DOI": "10.1/A"}}, {"abstract": "two"}, None])
EPMC = json.dumps({"resultList": {"result": [{"doi": "10.1/X", "pmcid": "PMC1", "abstractText": "<h4>Aim</h4>Short.", "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "html", "availability": "Open access", "url": "h"}, {"documentStyle": "pdf", "availability": "Open access", "url": "e.pdf"}]}}]}})


def _folder(s, name: str) -> str:
    """A new folder under the shared one."""
    return fresh_folder(s, name)


def _web(s, service: str, ids: list[str], *answers, **options: str):
    return H.read_web(s, service, ids, answers=json.dumps(answers), **options)


def _page(first: int, n: int, cursor: str | None) -> str:
    """A page of works whose citations fall with their number."""
    return H.sample_answer([{"id": f"W{k}", "doi": f"https://doi.org/10.1/{k}", "title": "T", "publication_year": 2020, "cited_by_count": 1000 - k, "abstract_inverted_index": {"of": [1], f"a{k}": [0]}} for k in range(first, first + n)], cursor)


PAGES = [_page(0, 200, "x"), _page(200, 200, "y"), _page(400, 37, None)]


def _download(s, d):
    """PDFs by address: one that is there, one that isn't a PDF, one that is missing."""
    folder = _folder(s, "pdfs")
    rows = s.createDataFrame([("10.1/a", "%PDF-1.7 text"), ("10.1/b", "<html>")], "doi string, value string")
    for r in rows.collect():
        rows.where(F.col("doi") == r.doi).select("value").coalesce(1).write.text(f"{folder}/{r.doi[-1]}")
    files = s.read.format("binaryFile").load(f"{folder}/*").select(F.concat(F.lit("10.1/"), F.regexp_extract("path", r"/([ab])/[^/]*$", 1)).alias("doi"), F.regexp_replace("path", "^file:/+", "file:///").alias("url"))
    urls = files.unionByName(s.createDataFrame([("10.1/c", "file:///nowhere/x.pdf")], "doi string, url string"))
    store = S.Store(s, _folder(s, "store"))
    store.save_content(H.download_pdfs(urls, spacing=0.0))
    return store.load_content("pdf").select("doi", F.length("content").alias("n"))


def _fulltext_chain(s, d):
    """Identifier to PMCID to full text to sections."""
    found = H.europe_pmc_results(_web(s, "europe_pmc", ["10.1/X", "10.1/y"], EPMC, EPMC.replace("10.1/X", "10.1/y").replace("PMC1", "PMC2")))
    xml = H.article_xml(found, _web(s, "europe_pmc_xml", ["PMC1", "PMC2"], JATS, "<article/>"))
    return xml.select("doi", "pmcid", M.parse_jats(F.col("xml")).alias("f")).where("f.methods_text <> '' or f.results_text <> '' or f.discussion_text <> ''").select("doi", "pmcid", "f.methods_text")


def _store(s, d) -> S.Store:
    store = S.Store(s, _folder(s, "store"))
    rows = K.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doi"), F.col("s_name").alias("data"))
    store.save_layer("L0", rows)
    store.save_layer("L0", rows.where("doi like '%1'").withColumn("data", F.lit("new")))
    return store


def _collections(s, d):
    store = _store(s, d)
    for name, rule in (("ones", "doi like '%1'"), ("twos", "doi like '%2'"), ("ones", "doi like '%3'")):
        store.collect(name, store.load_layer("L0").where(rule).select("doi"))
    return store.collections()


def _content(s, d):
    store = S.Store(s, _folder(s, "store"))
    store.save_content(K.table(s, d, "pages").select(F.col("page_id").cast("string").alias("doi"), F.lit("html").alias("kind"), F.encode("html", "utf-8").alias("content")))
    return store.load_content("html").select("doi", F.sha2("content", 256).alias("sha"))


def _round_trip(s, df, kind: str, name: str):
    path = _folder(s, name)
    df.write.format(kind).save(path)
    return s.read.schema(df.schema).format(kind).load(path)


def _clusters(s, d):
    path = _folder(s, "clusters")
    S.write_json_map(K.part_types(s, d), "doc_id", "cluster_id", path)
    return P.clusters_from_json(s.read.text(path, wholetext=True))


def _eval_csv(s, d):
    path = _folder(s, "csv")
    S.write_bridges_csv(_bridges(s, d), path)
    return s.read.option("header", True).schema("cluster_a string, cluster_b string, entity_jaccard double, shared_count long, unique_a long, unique_b long, shared_entities string").csv(path)


def _history(s, d):
    h, out = History(3), []
    for i in range(5):
        h.push(i)
    for i in range(4):
        out.append((i, h.undo(), len(h)))
    return s.createDataFrame(out, "step int, state int, depth int")


def _vocabulary(s, d):
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:
        f.write("domain: test\nmethods: [Kriging, kriging, PCA]\nconcepts: [drift]\n")
        f.flush()
        return s.createDataFrame(E.merged_vocabulary(P.read_vocabulary(f.name), base={}), "rank int, kind string, term string")


def _layout(s, d):
    return L.embed(K.part_papers(s, d), K.part_entities(s, d))


def _cached(s, d):
    """A layout asked for twice: the second time it is read, from the one table that there is."""
    folder = _folder(s, "layouts")
    first, second = (L.cached(K.part_papers(s, d), K.part_entities(s, d), folder) for _ in range(2))
    tables = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select(F.regexp_extract("path", "(layout-[^/]*)/", 1).alias("t")).agg(F.countDistinct("t").alias("tables"))
    return first.join(second.withColumnRenamed("xy", "again"), "doc_id").select("doc_id", (F.col("xy") == F.col("again")).alias("same")).join(F.broadcast(tables))


def _prepared(s, d):
    """Clusters, texts and prompts together: how many papers, texts and prompts there are."""
    docs = K.doc_papers(s, d).withColumn("year", F.lit(2020))
    asked = C.prompts(docs, 45, header="").agg(F.count("*").alias("n_prompts"), F.sum(F.length("prompt")).alias("chars"))
    return docs.agg(F.count("*").alias("n_papers"), F.count_if(F.length("abstract") > 0).alias("n_texts")).join(F.broadcast(asked))


QUERIES = {
    "src_vocab_yaml": (_vocabulary, "SELECT CAST(rank AS INT) AS rank, kind, term FROM (VALUES (0, 'METHOD', 'Kriging'), (1, 'METHOD', 'PCA'), (2, 'CONCEPT', 'drift')) v(rank, kind, term)"),
    "src_analysis_dir": (
        lambda s, d: s.createDataFrame([(n, P.optional(s, f"{d}/{n}.parquet") is not None) for n in ("part", "nothing")], "name string, found boolean"), "SELECT * FROM (VALUES ('part', true), ('nothing', false)) v(name, found)",
    ),
    "src_openalex_search": (lambda s, d: H.top_works(H.works(_web(s, "openalex_search", ["cells"], PAGES, most="300", filters='{"publication_year": ">2019"}')), 300).agg(F.count("*").alias("n"), F.min("cited_by_count").alias("least")), "SELECT 300::BIGINT AS n, CAST(701 AS INT) AS least"),
    "src_openalex_topic": (lambda s, d: H.works(_web(s, "openalex_topic", ["T1", "T2"], PAGES, WORKS)).groupBy(F.col("publication_date").isNull().alias("x")).agg(F.countDistinct("openalex_id").alias("n")).select("n"), "SELECT 437::BIGINT AS n"),
    "src_openalex_citing": (lambda s, d: _web(s, "openalex_citing", ["W9"], PAGES).select("page", F.size(F.from_json("body", "results array<struct<id:string>>")["results"]).cast("long").alias("n")), "SELECT CAST(page AS INT) AS page, n FROM (VALUES (0, 200::BIGINT), (1, 200), (2, 37)) v(page, n)"),
    "src_openalex_dois": (
        lambda s, d: _web(s, "openalex_dois", [f"10.1/{i},x" for i in range(65)], WORKS, WORKS).select("batch", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.col("body").isNotNull().alias("answered")),
        "SELECT CAST(batch AS INT) AS batch, n, first, answered FROM (VALUES (0, 30::BIGINT, '10.1/0,x', true), (1, 30, '10.1/30,x', true), (2, 5, '10.1/60,x', false)) v(batch, n, first, answered)",
    ),
    "src_abs_s1": (
        lambda s, d: H.openalex_abstracts(H.fetch(K.table(s, d, "supplier").select(F.concat(F.lit("10.1/"), F.col("s_suppkey") % 100).alias("doi")).distinct(), "openalex_abstracts", answers=json.dumps([_page(0, 50, None), _page(50, 50, None)]))),
        "SELECT '10.1/' || k AS doi, 'a' || k || ' of' AS abstract FROM range(0, 100) r(k) WHERE (SELECT count(DISTINCT s_suppkey % 100) FROM supplier) > 50 OR k < 50",
    ),
    "src_abs_s2": (
        lambda s, d: H.semantic_scholar_abstracts(_web(s, "semantic_scholar", ["10.1/a", "10.1/b", "10.1/c", *[f"10.2/{i}" for i in range(250)]], S2, json.dumps([None] * 52 + [{"abstract": "last"}]))),
        "SELECT * FROM (VALUES ('10.1/a', 'one'), ('10.1/b', 'two'), ('10.2/249', 'last')) v(doi, abstract)",
    ),
    "src_abs_s3": (lambda s, d: H.europe_pmc_results(_web(s, "europe_pmc", ["10.1/X"], EPMC)), "SELECT '10.1/x' AS doi, 'PMC1' AS pmcid, 'AimShort.' AS abstract"),
    "src_pmcid": (lambda s, d: H.europe_pmc_results(_web(s, "europe_pmc", ["10.1/X", "10.1/Z"], EPMC, '{"resultList": {"result": []}}')).select("doi", "pmcid"), "SELECT '10.1/x' AS doi, 'PMC1' AS pmcid"),
    "src_pmc_xml": (lambda s, d: _web(s, "europe_pmc_xml", ["PMC1", "PMC9"], JATS).select(F.get("ids", F.lit(0)).alias("pmcid"), M.parse_body(F.col("body")).alias("text")), "SELECT * FROM (VALUES ('PMC1', 'Methods We used cells . Results and findings It works. Figure one. Discussion Good.'), ('PMC9', '')) v(pmcid, text)"),
    "src_fulltext": (_fulltext_chain, "SELECT '10.1/x' AS doi, 'PMC1' AS pmcid, 'Methods We used cells .' AS methods_text"),
    "src_epmc": (lambda s, d: H.europe_pmc_urls(_web(s, "europe_pmc", ["10.1/X", "10.1/b"], EPMC, "{}")), "SELECT '10.1/X' AS id, 'e.pdf' AS url"),
    "src_unpaywall": (lambda s, d: H.unpaywall_urls(_web(s, "unpaywall", ["10.1/a", "10.1/b"], '{"best_oa_location":{"url_for_pdf":"u"}}', "{}")), "SELECT '10.1/a' AS id, 'u' AS url"),
    "src_biorxiv": (
        lambda s, d: H.preprint_urls(_web(s, "biorxiv", ["1", "2"], '{"collection":[{"doi":"10.1101/1v1"},{"doi":"10.1101/1v2"}]}', '{"collection":[]}')).unionByName(H.preprint_urls(_web(s, "medrxiv", ["2"], '{"collection":[{"doi":"10.1101/2"}]}'), "medrxiv")),
        "SELECT * FROM (VALUES ('1', 'https://www.biorxiv.org/content/10.1101/1v2.full.pdf'), ('2', 'https://www.medrxiv.org/content/10.1101/2.full.pdf')) v(id, url)",
    ),
    "src_crossref": (
        lambda s, d: H.crossref_urls(_web(s, "crossref", ["a", "b", "c"], '{"message":{"link":[{"URL":"x.html","content-type":"text/html"},{"URL":"y","content-type":"application/pdf"}]}}', '{"message":{"link":[{"URL":"z.PDF","content-type":"unspecified"}]}}', '{"message":{}}')),
        "SELECT * FROM (VALUES ('a', 'y'), ('b', 'z.PDF')) v(id, url)",
    ),
    "src_pdf": (_download, "SELECT '10.1/a' AS doi, CAST(14 AS INT) AS n"),
    "fn_pdf_text": (lambda s, d: s.createDataFrame([(1, None), (2, bytearray(b"<html>"))], "id long, content binary").select("id", M.pdf_text(F.col("content")).alias("text")), "SELECT * FROM (VALUES (1::BIGINT, NULL::VARCHAR), (2, NULL)) v(id, text)"),
    "fn_sections_by": (
        lambda s, d: s.createDataFrame([(1, JATS), (2, "<a/>"), (3, None)], "id long, x string").select("id", M.parse_sections(F.col("x"), ["result", "discussion"], ["methods"]).alias("text")),
        "SELECT * FROM (VALUES (1::BIGINT, 'Methods We used cells .' || chr(10) || chr(10) || 'Results and findings It works. Figure one.' || chr(10) || chr(10) || 'Discussion Good.'), (2, ''), (3, '')) v(id, text)",
    ),
    "fn_body_text": (lambda s, d: K.table(s, d, "pages").select("page_id", M.parse_body(F.concat(F.lit("<a><body><p>"), F.col("url"), F.lit("</p>  x<i> y </i></body></a>"))).alias("text")), "SELECT page_id, CASE WHEN contains(url, '&') THEN '' ELSE url || ' x y' END AS text FROM pages"),
    "snk_clusters": (_clusters, f"WITH {PT} SELECT CAST(doc_id AS VARCHAR) AS doc_id, cluster_id FROM pt"),
    "snk_papers": (lambda s, d: _round_trip(s, K.part_papers(s, d), "json", "papers"), f"WITH {K.PP} SELECT * FROM pp"),
    "snk_research": (lambda s, d: _round_trip(s, C.with_cluster(K.part_papers(s, d), K.part_types(s, d)), "parquet", "research").select("doc_id", "title", "cluster_id"), f"WITH {K.PP}, {PT} SELECT doc_id, title, cluster_id FROM pp JOIN pt USING (doc_id)"),
    "snk_prompts": (lambda s, d: _round_trip(s, C.prompts(K.doc_papers(s, d).withColumn("year", F.lit(2020)), 45), "json", "prompts").select("batch_id", "n_papers"), "SELECT (rn - 1) // 45 AS batch_id, count(*) AS n_papers FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1"),
    "snk_eval_csv": (_eval_csv, BRIDGES + " SELECT cluster_a, cluster_b, entity_jaccard, shared_count, unique_a, unique_b, array_to_string(top, ';') AS shared_entities FROM bridge"),
    "store_save_layer": (lambda s, d: _store(s, d).load_layer("L0"), "SELECT CAST(s_suppkey AS VARCHAR) AS doi, CASE WHEN CAST(s_suppkey AS VARCHAR) LIKE '%1' THEN 'new' ELSE s_name END AS data FROM supplier"),
    "store_content": (_content, "SELECT CAST(page_id AS VARCHAR) AS doi, sha256(html) AS sha FROM pages"),
    "store_collections": (_collections, "WITH k AS (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier) SELECT 'ones' AS name, count(*) AS n FROM k WHERE k LIKE '%1' OR k LIKE '%3' UNION ALL SELECT 'twos', count(*) FROM k WHERE k LIKE '%2'"),
    "op_keep": (lambda s, d: C.in_list(K.part_papers(s, d), K.table(s, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("doc_id"))).select("doc_id"), "SELECT p_partkey AS doc_id FROM part WHERE p_size < 10"),
    "op_exclude_sel": (lambda s, d: C.excluding(K.part_papers(s, d), K.table(s, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("doc_id"))).select("doc_id"), "SELECT p_partkey AS doc_id FROM part WHERE p_size >= 10"),
    "op_undo_stack": (_history, "SELECT CAST(step AS INT) AS step, CAST(state AS INT) AS state, CAST(depth AS INT) AS depth FROM (VALUES (0, 3, 2), (1, 2, 1), (2, NULL, 0), (3, NULL, 0)) v(step, state, depth)"),
    "ent_paper_map": (
        lambda s, d: E.paper_entities(P.papers_from_json(s.createDataFrame([(PAPERS,)], "value string")).where("doi is not null").withColumnRenamed("doi", "doc_id"), use_topics=True),
        "SELECT * FROM (VALUES ('10.1/a', 'deep learning'), ('10.1/a', 'rna-seq'), ('10.1/a', 'genomics'), ('10.1/a', 'cells'), ('10.1/a', 'biology'), ('10.1/b', 'yeast'), ('10.1/b', 'atlas')) v(doc_id, entity)",
    ),
    "gr_networkx": (
        lambda s, d: G.strong_edges(C.in_list(K.part_entities(s, d), K.part_sizes(s, d).where("cluster_id = '1'").select("doc_id")), 3),
        f"WITH {PE}, {PS}, k AS (SELECT doc_id FROM ps WHERE cluster_id = '1') SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS weight FROM pe a JOIN pe b ON a.entity = b.entity AND a.doc_id < b.doc_id WHERE a.doc_id IN (FROM k) AND b.doc_id IN (FROM k) GROUP BY 1, 2 HAVING count(*) >= 3",
    ),
    "op_browse_export": (
        lambda s, d: C.export_clusters(K.part_papers(s, d), K.part_cells(s, d), ["ECONOMY/Brand#1", "STANDARD/Brand#2", "nothing"]), f"WITH {K.PP}, {PC} SELECT pp.* FROM pp JOIN pc USING (doc_id) WHERE cluster_id IN ('ECONOMY/Brand#1', 'STANDARD/Brand#2')",
    ),
    "op_reset": (
        lambda s, d: C.with_cluster(C.reset(K.part_papers(s, d), C.excluding(K.part_papers(s, d), K.part_types(s, d))), K.part_types(s, d)).groupBy("cluster_id").agg(F.count("*").alias("n")), f"WITH {PT} SELECT cluster_id, count(*) AS n FROM pt GROUP BY 1",
    ),
    "vw_detail": (
        lambda s, d: W.directory(K.part_papers(s, d), K.part_types(s, d).where("cluster_id <> 'ECONOMY'"), G.cluster_labels(K.part_papers(s, d), K.part_types(s, d), []).where("cluster_id <> 'STANDARD'").withColumn("label", F.lower("cluster_id"))),
        f"""WITH {K.PP}, {PT}, c AS (SELECT cluster_id, CAST((dense_rank() OVER (ORDER BY cluster_id) - 1) % 20 AS INT) AS colour FROM (SELECT DISTINCT cluster_id FROM pt WHERE cluster_id <> 'ECONOMY')),
 r AS (SELECT doc_id, title, year, colour, CASE WHEN pt.cluster_id = 'ECONOMY' THEN 'Unassigned' WHEN pt.cluster_id = 'STANDARD' THEN 'Cluster STANDARD' ELSE lower(pt.cluster_id) END AS cluster_label FROM pp JOIN pt USING (doc_id) LEFT JOIN c USING (cluster_id))
SELECT doc_id, title, year, cluster_label, colour, 'https://doi.org/' || doc_id AS url, lower(title || ' ' || doc_id || ' ' || cluster_label) AS search_key FROM r""",
    ),
    "vw_detail_search": (
        lambda s, d: W.searched(W.directory(K.part_papers(s, d), K.part_types(s, d), G.cluster_labels(K.part_papers(s, d), K.part_types(s, d), [])), "Ring 1", page=1, size=5).select("doc_id"),
        f"WITH {K.PP}, {PT}, l AS (SELECT cluster_id, string_agg(upper(w[1]) || w[2:], ' + ' ORDER BY n DESC, w) AS label FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, w) AS rn FROM (SELECT cluster_id, w, count(*) AS n FROM (SELECT cluster_id, unnest(string_split(title, ' ')) AS w FROM pp JOIN pt USING (doc_id)) WHERE length(w) >= 4 GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1)"
        " SELECT doc_id FROM pp JOIN pt USING (doc_id) JOIN l USING (cluster_id) WHERE contains(lower(title || ' ' || doc_id || ' ' || label), 'ring') AND contains(lower(title || ' ' || doc_id || ' ' || label), '1') ORDER BY year DESC, doc_id LIMIT 5 OFFSET 5",
    ),
    "vw_novelty_tab": (
        lambda s, d: W.novelty_points(R.gaps(K.part_entities(s, d), K.part_types(s, d)).withColumn("z", -F.col("expected"))).select("label", "cluster_id", F.round("x", 4).alias("x"), "y"),
        GAPS + " SELECT entity_a || ' × ' || entity_b AS label, cluster_id, round(1 - ratio, 4) AS x, -expected AS y FROM gp ORDER BY -expected, entity_a, entity_b, cluster_id LIMIT 10",
    ),
    "vw_themes_tab": (
        lambda s, d: W.theme_rows(X.coherence(K.table(s, d, "embeddings"), "label").select(F.col("label").alias("theme_id"), F.array(F.lit("a"), F.lit("b")).alias("keywords"), F.col("n").alias("size"), "mean_cosine", "coherent")),
        f"WITH {VEC} SELECT label AS theme_id, 'a, b' AS label, any_value(n) AS size, round(avg({COS}), 3) AS coherence, CASE WHEN avg({COS}) >= 0.5 THEN 'Yes' ELSE 'No' END AS coherent FROM embeddings JOIN c USING (label) GROUP BY embeddings.label",
    ),
    "vw_bridges_tab": (
        lambda s, d: W.bridge_rows(_bridges(s, d)), BRIDGES + " SELECT cluster_a, cluster_b, entity_jaccard, shared_count, array_to_string(top[:5], ', ') AS entities FROM bridge ORDER BY entity_jaccard DESC, cluster_a, cluster_b LIMIT 20",
    ),
    "jn_attach_fulltext": (
        lambda s, d: C.attach(K.part_papers(s, d).select(F.col("doc_id").cast("string").alias("doi"), "title"), K.table(s, d, "pages").select(F.col("page_id").cast("string").alias("doi"), T.strip_tags(F.col("html")).alias("text"), "page_id"), "doi", ["text"], "page_id").select("doi", "title", F.sha2("text", 256).alias("sha")),
        "SELECT CAST(p_partkey AS VARCHAR) AS doi, p_name AS title, sha256(coalesce(regexp_replace(html, '<[^>]+>', '', 'g'), '')) AS sha FROM part LEFT JOIN pages ON p_partkey = page_id",
    ),
    "cl_subcluster_cmd": (lambda s, d: _subs(s, d).groupBy(F.split_part("cluster_id", F.lit("."), F.lit(1)).alias("parent")).agg(F.count("*").alias("n")), "SELECT CAST(p_partkey % 4 AS VARCHAR) AS parent, count(*) AS n FROM part GROUP BY 1"),
    "cl_cluster_topics": (
        lambda s, d: G.cluster_summary(K.part_entities(s, d), K.part_types(s, d), 3).select("cluster_id", "size", T.truncate(F.col("top_entities"), 12).alias("topics")),
        f"WITH {PE}, {PT}, c AS (SELECT cluster_id, entity, count(*) AS n FROM pe JOIN pt USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, entity) AS rn FROM c), t AS (SELECT cluster_id, string_agg(entity, ',' ORDER BY rn) AS t FROM r WHERE rn <= 3 GROUP BY 1) SELECT cluster_id, (SELECT count(*) FROM pt WHERE pt.cluster_id = t.cluster_id) AS size, CASE WHEN length(t) > 12 THEN t[:12] || '...' ELSE t END AS topics FROM t",
    ),
    "gq_stream_cmd": (
        lambda s, d: G.stream(K.part_entities(s, d), 0, "expand", 1), f"WITH {PE} SELECT CAST(min(CASE WHEN b.doc_id = 0 THEN 0 ELSE 1 END) AS INT) AS step, b.doc_id FROM pe a JOIN pe b ON a.entity = b.entity WHERE a.doc_id = 0 GROUP BY b.doc_id",
    ),
    "ev_go_nogo": (
        lambda s, d: V.go_or_not(V.cluster_metrics(K.part_cells(s, d)).select("clusters", "majors", "largest"), {"clusters": 10, "majors": 5, "largest": 10_000}, 3),
        f"WITH {PC}, z AS (SELECT count(*) AS n FROM pc GROUP BY cluster_id), c AS (SELECT count(*) AS clusters, count_if(n >= 5) AS majors, max(n) AS largest FROM z), m AS (SELECT *, CAST(clusters >= 10 AS INT) + CAST(majors >= 5 AS INT) + CAST(largest >= 10000 AS INT) AS met FROM c) SELECT clusters, majors, largest, met, CASE WHEN met >= 3 THEN 'GO' WHEN met = 2 THEN 'CONDITIONAL' ELSE 'KILL' END AS verdict FROM m",
    ),
    "em_reduce": (lambda s, d: L.embed(K.part_papers(s, d), K.part_entities(s, d), k=3).select("doc_id", F.size("xy").alias("dims"), F.exists("xy", lambda v: F.isnan(v)).alias("broken")), "SELECT p_partkey AS doc_id, CAST(3 AS INT) AS dims, false AS broken FROM part"),
    "em_cached": (_cached, "SELECT p_partkey AS doc_id, true AS same, 1::BIGINT AS tables FROM part"),
    "rp_prepare": (_prepared, "SELECT count(*) AS n_papers, count_if(length(text) > 0) AS n_texts, CAST(ceil(count(*) / 45) AS BIGINT) AS n_prompts, CAST(sum(45 + length(CAST(doc_id AS VARCHAR)) + length(string_split(text, chr(10))[1]) + CASE WHEN trim(text) = '' THEN 23 ELSE length(trim(text)) END) - 2 * CAST(ceil(count(*) / 45) AS BIGINT) AS BIGINT) AS chars FROM documents"),
    "rp_checkpointed": (
        lambda s, d: P.unfinished(C.batches(K.table(s, d, "documents").select("doc_id"), "doc_id", 45).select("batch_id").distinct(), K.table(s, d, "labels").select((F.col("doc_id") % 5).alias("batch_id"))),
        "SELECT DISTINCT (rn - 1) // 45 AS batch_id FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 1) // 45 NOT IN (SELECT doc_id % 5 FROM labels)",
    ),
    "vw_decision": (
        lambda s, d: W.decision(G.cluster_summary(K.part_entities(s, d), K.part_cells(s, d), 1), _bridges(s, d)),
        BRIDGES + ", sd AS (SELECT cluster_a AS cluster_id, entity_jaccard AS j FROM bridge UNION ALL SELECT cluster_b, entity_jaccard FROM bridge) SELECT pc.cluster_id, count(*) AS size, (SELECT count(*) FROM sd WHERE sd.cluster_id = pc.cluster_id) AS bridges, (SELECT max(j) FROM sd WHERE sd.cluster_id = pc.cluster_id) AS best FROM pc GROUP BY 1",
    ),
    "vw_all": (
        lambda s, d: s.createDataFrame([(n,) for n in W.all_views({"summary": G.cluster_summary(K.part_entities(s, d), K.part_types(s, d)), "membership": K.part_types(s, d), "bridges": None})], "name string"), "SELECT * FROM (VALUES ('overview'), ('colours')) v(name)",
    ),
    "vw_landscape": (lambda s, d: W.landscape(_layout(s, d), K.part_types(s, d)).where("central").groupBy("cluster_id").agg(F.count("*").alias("n")), f"WITH {PT} SELECT cluster_id, 1::BIGINT AS n FROM pt GROUP BY 1"),
    "vw_bubble": (
        lambda s, d: L.bubbles(_layout(s, d), K.part_types(s, d), K.part_papers(s, d)).select("cluster_id", "n", F.round("size", 6).alias("size"), "first_year", "last_year"),
        f"WITH {K.PP}, {PT} SELECT cluster_id, count(*) AS n, round(greatest(20.0, 8 * sqrt(count(*))), 6) AS size, min(year) AS first_year, max(year) AS last_year FROM pp JOIN pt USING (doc_id) GROUP BY 1",
    ),
    "vw_burst": (lambda s, d: W.first_rows(R.yearly(K.order_entities(s, d), K.order_papers(s, d)).groupBy("entity").agg(F.sum("n").alias("mentions")), "mentions", 15), f"WITH {K.OE}, {K.OP} SELECT entity, count(*) AS mentions FROM oe JOIN op USING (doc_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "vw_area": (
        lambda s, d: K.order_entities(s, d).join(K.order_papers(s, d), "doc_id").groupBy("entity", F.floor(F.col("year") / 2).alias("period")).agg(F.count("*").alias("n")), f"WITH {K.OE}, {K.OP} SELECT entity, CAST(floor(year / 2) AS BIGINT) AS period, count(*) AS n FROM oe JOIN op USING (doc_id) GROUP BY 1, 2",
    ),
    "vw_export": (
        lambda s, d: W.graph_json(K.part_types(s, d), G.strong_edges(K.part_entities(s, d), 4)).groupBy("kind").agg(F.count("*").alias("n")),
        f"WITH {PE}, e AS (SELECT a.doc_id, b.doc_id AS d2 FROM pe a JOIN pe b ON a.entity = b.entity AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 4) SELECT 'node' AS kind, count(*) AS n FROM part UNION ALL SELECT 'link', count(*) FROM e HAVING count(*) > 0",
    ),
    "cl_leiden_invariants": (
        lambda s, d: U.entity_communities(K.part_papers(s, d).select("doc_id"), _brand_names(s, d), 1.0, 1).agg(F.count("*").alias("papers"), F.countDistinct("doc_id").alias("distinct_papers")),
        "SELECT count(*) AS papers, count(*) AS distinct_papers FROM part",
    ),
}
