"""Queries of identifiers, text functions and section parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import markup as M
from citeloom.functions import text as T
from citeloom.plans import corpora as K

DOIS = [
    "https://doi.org/10.1038/s41586-020-1234-5", "http://doi.org/10.1016/j.cell.2020.01.001", "10.1371/journal.pone.0000001.s001", "10.1000/abc_suppl2", "10.14573/altex.1812101s1",
    "10.7554/eLife.12345.sa1", "10.3410/f.123.456", "10.5281/zenodo.12345", "10.6084/m9.figshare.77", "10.1101/2020.01.02.123456", "10.1101/123456", "10.1101/gad.12345",
    "10.48550/arXiv.2001.00001", "10.21203/rs.3.rs-1/v1", "10.7554/elife.12345.001", "10.7554/elife.12345.01", "10.1007/978-3-030-1_2", "10.1016/B978-0-12-1", "10.1201/9781",
    "10.12345/abc", "10.1126/science.abc", "", "10.2139/ssrn.99", "10.7910/DVN/ABC", "10.26434/chemrxiv-2020", "HTTPS://doi.org/10.1/X", " 10.1093/nar/gkz1 ",
]
TITLES = [
    "Deep learning predicts gene expression in cells", "Deep Learning predicts gene expression in cells (preprint)", "Deep learning predicts gene expression in cells: a large resource for all",
    "A virtual cell", "A Virtual Cell, revised version v2", "Single-cell atlas of the human heart", "Single cell atlas of human heart", "Graph networks", "", "v1 preprint",
]
ANSWERS = [
    '[{"doi":"10.1/a","problem":"p","method":"m"}]', '```json\n[{"doi":"10.1/b","finding":"f, [1]"},{"nope":1}]\n```', 'Here it is:\n[{"doi":"10.1/c"}]\nDone.', "no array", '[{"doi":',
]


def _values(items: list[str]) -> str:
    return ", ".join(f"({i}::BIGINT, '" + x.replace("'", "''") + "')" for i, x in enumerate(items))


def _frame(s, items: list[str], name: str):
    return s.createDataFrame(list(enumerate(items)), f"id long, {name} string")


def _starts(d: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({d}, '{p}')" for p in prefixes) + ")"


KIND = f"""CASE WHEN doi = '' THEN 'other' WHEN regexp_matches(d, '\\.s\\d{{3,4}}$|_suppl\\d*$|\\.supp\\d*$|[a-z0-9]s\\d{{1,2}}$') THEN 'supplementary'
 WHEN regexp_matches(d, '\\.sa\\d+$') OR {_starts("d", I.EDITORIAL_PREFIXES)} THEN 'editorial' WHEN {_starts("d", I.DATASET_PREFIXES)} THEN 'dataset'
 WHEN starts_with(d, '10.1101/') AND regexp_matches(d, '{I.BIORXIV}') THEN 'preprint' WHEN NOT starts_with(d, '10.1101/') AND {_starts("d", I.PREPRINT_PREFIXES)} THEN 'preprint'
 WHEN regexp_matches(d, '{I.SUB_ARTICLE}') THEN 'editorial' WHEN regexp_matches(d, '{I.BOOK_CHAPTER}') THEN 'book_chapter' WHEN regexp_matches(d, '{I.LONG_REGISTRAR}') THEN 'other' ELSE 'journal' END"""
DOI_SQL = f"WITH v(id, doi) AS (VALUES {_values(DOIS)}), n AS (SELECT id, doi, regexp_replace(doi, '^https?://doi\\.org/', '') AS plain FROM v), k AS (SELECT *, lower(trim(plain)) AS d FROM n), kinds AS (SELECT id, doi, plain, {KIND} AS kind FROM k)"
WORDS_SQL = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{w}'" for w in I.TITLE_NOISE) + "))"
MATCH_SQL = "len(list_intersect(a.w, b.w)) >= 2 AND (len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) >= 0.85 OR len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.85)"
_re = lambda patterns: "|".join(p.replace("'", "''") for p in patterns)
GENERIC_SQL = f"coalesce(length(trim(text)) < 10 OR regexp_matches(lower(text), '{_re(T.GENERIC)}'), true)"
GENERIC_X_SQL = f"coalesce(length(trim(text)) < 10 OR regexp_matches(lower(text), '{_re(T.GENERIC + T.GENERIC_MORE)}'), true)"


def _title_pairs(s, d):
    w = _frame(s, TITLES, "title").select("id", F.array_distinct(I.title_words(F.col("title"))).alias("w")).where(F.size("w") > 0)
    a, b = w.select(F.col("id").alias("a"), F.col("w").alias("wa")), w.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    cand = a.withColumn("t", F.explode("wa")).join(b.withColumn("t", F.explode("wb")), "t").where("a < b").select("a", "b", "wa", "wb").distinct()
    return cand.where(I.same_title(F.col("wa"), F.col("wb"))).select("a", "b")


def preprints_deduped(papers, id_col="doi", title_col="title"):
    """papers without the preprints whose title a journal paper has: candidates share a title word, so the theta join has an index."""
    w = papers.select(id_col, I.doi_kind(F.col(id_col)).alias("kind"), F.array_distinct(I.title_words(F.col(title_col))).alias("w"))
    words = lambda k, n: w.where(F.col("kind") == k).select(F.col(id_col).alias(n), F.col("w").alias(f"w_{n}"), F.explode("w").alias("t"))
    gone = words("preprint", "pre").join(words("journal", "jou"), "t").where(I.same_title(F.col("w_pre"), F.col("w_jou"))).select(F.col("pre").alias(id_col)).distinct()
    return papers.join(gone, id_col, "left_anti")


PAPERS = [
    ("10.1101/2020.01.01.000001", TITLES[1]), ("10.1038/s1-2", TITLES[0]), ("10.48550/arxiv.1", "Graph networks"), ("10.1126/x", "Graph neural networks for cells"), ("10.5281/zenodo.1", "Data of all"),
    ("10.1371/j.s001", "Supplement"), ("10.1101/654321", TITLES[6]), ("10.1093/y", TITLES[5]), ("10.3410/f.1", "Opinion"),
]
PAPER_SQL = "p(doi, title) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAPERS) + ")"


def _papers(s):
    return s.createDataFrame(PAPERS, "doi string, title string")


def _docs(s, d):
    return K.table(s, d, "documents")


def clean_papers(papers):
    """Research papers only, without preprints that were published."""
    return preprints_deduped(papers.where(I.is_research(F.col("doi"))))


def _first_titles(s, d):
    rows = _docs(s, d).where("lang = 'en'").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    w = rows.select("doc_id", F.array_distinct(I.title_words(F.col("title"))).alias("w")).where(F.size("w") >= 2)
    # A title that is equal to another but for its order of words is one with it: classes first, then pairs of classes.
    cls = w.groupBy(F.sort_array("w").alias("w")).agg(F.min("doc_id").alias("a"), F.count("*").alias("n"))
    return cls


def title_pairs(cls, threshold=0.85):
    """a, b, n_a, n_b: pairs of title classes (w, a, n) that same_title takes for one work, by least ids and class sizes.

    A match shares enough words of the smaller title, so one of that title's rarest words, as many as a match may miss and one more,
    is in the other: only those meet the index of all words, and no pair is lost."""
    # 256 bits of a title's words: every bit of the smaller title that the larger one hasn't is a word missing, so too many rule a pair out.
    bits = [F.expr(f"aggregate(w, 0L, (o, x) -> o | if(pmod(xxhash64(x), 256) div 64 = {k}, shiftleft(1L, CAST(pmod(xxhash64(x), 64) AS INT)), 0L))").alias(f"b{k}") for k in range(4)]
    words = cls.select("a", F.size("w").alias("size"), *bits, "w").select("a", "size", "b0", "b1", "b2", "b3", F.explode("w").alias("t"))
    df = words.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")  # a word of one title only meets nothing
    index = words.join(df, "t")
    need = F.greatest(F.lit(2), F.ceil(F.col("size") * threshold - 1e-9)).cast("int")
    head = F.col("size") - need + 1
    # Words of one title only would be the first of the prefix: they take its places without meeting anything.
    ranked = index.groupBy("a", "size", "b0", "b1", "b2", "b3").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("x"))
    left = F.greatest(F.lit(0), head - (F.col("size") - F.size("x")))
    rare = ranked.select(F.col("a").alias("s"), F.col("size").alias("size_s"), (F.col("size") - need).alias("spare"), *[F.col(f"b{k}").alias(f"s{k}") for k in range(4)], F.explode(F.slice("x", F.lit(1), left)).alias("x")).withColumn("t", F.col("x.t")).drop("x")
    missing = sum((F.bit_count(F.expr(f"s{k} & ~b{k}")) for k in range(4)), F.lit(0))
    larger = (F.col("size_s") < F.col("size")) | ((F.col("size_s") == F.col("size")) & (F.col("s") < F.col("a")))
    pairs = rare.join(index, "t").where(larger & (missing <= F.col("spare"))).select(F.least("s", "a").alias("a"), F.greatest("s", "a").alias("b")).distinct()
    both = pairs.join(cls.select("a", F.col("w").alias("w_a"), F.col("n").alias("n_a")), "a").join(cls.select(F.col("a").alias("b"), F.col("w").alias("w_b"), F.col("n").alias("n_b")), "b")
    return both.where(I.same_title(F.col("w_a"), F.col("w_b"), threshold)).select("a", "b", "n_a", "n_b")


def _title_members(s, d):
    w = _docs(s, d).where("lang = 'en'").select("doc_id", F.sort_array(F.array_distinct(I.title_words(F.split_part("text", F.lit("\n"), F.lit(1))))).alias("w")).where(F.size("w") >= 2)
    return w.join(w.groupBy("w").agg(F.min("doc_id").alias("a")), "w").select("doc_id", "a")


TITLE_CLASSES = f"WITH {K.DP}, w AS (SELECT doc_id, list_sort(list_distinct({WORDS_SQL})) AS w FROM dp WHERE lang = 'en'), c AS (SELECT w, min(doc_id) AS a, count(*) AS n FROM w WHERE len(w) >= 2 GROUP BY w)"


JATS = """<article><front><abstract><p>Short abstract.</p></abstract></front><body><sec sec-type="methods"><title>Methods</title><p>We used <b>cells</b>.</p></sec>
<sec><title>Results and findings</title><p>It works.</p><fig><caption><p>Figure one.</p></caption></fig></sec><sec sec-type="discussion"><title>Discussion</title><p>Good.</p></sec></body></article>"""
TYPES = '<article><body><sec sec-type="intro"><p>a</p></sec><sec sec-type="materials|methods"><p>b</p></sec><sec sec-type="METHODS"><p>c</p></sec><sec sec-type="foo"><p>d</p></sec><sec sec-type="intro"><title> Own </title><p>e</p></sec></body></article>'
TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>1. Introduction</head><p>One.</p><p>Two.</p></div><div><p>Bare.</p></div></body></text></TEI>'
MARKDOWN = "# Abstract\nWe do.\n\n## 2. Methods\nThis way.\n# Results\n\n# Other\nMore."

QUERIES = {
    "fn_normalize_doi": (lambda s, d: _frame(s, DOIS, "doi").select("id", I.normalize_doi(F.col("doi")).alias("doi")), f"{DOI_SQL} SELECT id, plain AS doi FROM kinds"),
    "fn_normalize_doi_lower": (lambda s, d: _frame(s, DOIS, "doi").select("id", I.normalize_doi_lower(F.col("doi")).alias("doi")), f"WITH v(id, doi) AS (VALUES {_values(DOIS)}) SELECT id, regexp_replace(lower(trim(doi)), '^https?://doi\\.org/', '') AS doi FROM v"),
    "fn_classify_doi": (lambda s, d: _frame(s, DOIS, "doi").select("id", I.doi_kind(F.col("doi")).alias("kind")), f"{DOI_SQL} SELECT id, kind FROM kinds"),
    "fn_is_research": (lambda s, d: _frame(s, DOIS, "doi").select("id", I.is_research(F.col("doi")).alias("research")), f"{DOI_SQL} SELECT id, kind IN ('journal', 'preprint', 'book_chapter') AS research FROM kinds"),
    "store_dirname": (
        lambda s, d: K.table(s, d, "pages").select("page_id", I.safe_name(F.col("url")).alias("name")),
        "SELECT page_id, list_aggregate(list_transform(regexp_extract_all(replace(url, '/', '__'), '.'), lambda c: CASE WHEN regexp_matches(c, '[a-zA-Z0-9._\\-]') THEN c ELSE '_' || lower(printf('%02x', unicode(c))) || '_' END), 'string_agg', '') AS name FROM pages",
    ),
    "fn_title_tokens": (
        lambda s, d: K.doc_papers(s, d).select("doc_id", F.array_join(I.title_words(F.col("title")), " ").alias("words")),
        f"WITH {K.DP} SELECT doc_id, array_to_string({WORDS_SQL}, ' ') AS words FROM dp",
    ),
    "fn_titles_match": (_title_pairs, f"WITH v(id, title) AS (VALUES {_values(TITLES)}), w AS (SELECT id, list_distinct({WORDS_SQL}) AS w FROM v) SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0 AND {MATCH_SQL}"),
    "jn_dedupe_preprints": (
        lambda s, d: preprints_deduped(_papers(s)).select("doi"),
        f"WITH {PAPER_SQL}, k AS (SELECT *, {KIND} AS kind, list_distinct({WORDS_SQL}) AS w FROM (SELECT *, lower(trim(doi)) AS d FROM p)) SELECT doi FROM k WHERE doi NOT IN (SELECT a.doi FROM k a JOIN k b ON a.kind = 'preprint' AND b.kind = 'journal' AND {MATCH_SQL})",
    ),
    "jn_clean": (
        lambda s, d: clean_papers(_papers(s)).groupBy(I.doi_kind(F.col("doi")).alias("kind")).agg(F.count("*").alias("n")),
        f"WITH {PAPER_SQL}, k AS (SELECT *, {KIND} AS kind, list_distinct({WORDS_SQL}) AS w FROM (SELECT *, lower(trim(doi)) AS d FROM p)) SELECT kind, count(*) AS n FROM k WHERE kind IN ('journal', 'preprint', 'book_chapter') AND doi NOT IN (SELECT a.doi FROM k a JOIN k b ON a.kind = 'preprint' AND b.kind = 'journal' AND {MATCH_SQL}) GROUP BY 1",
    ),
    "title_classes": (
        lambda s, d: _first_titles(s, d).select("a", "n"),
        f"WITH {K.DP}, w AS (SELECT doc_id, list_sort(list_distinct({WORDS_SQL})) AS w FROM dp WHERE lang = 'en') SELECT min(doc_id) AS a, count(*) AS n FROM w WHERE len(w) >= 2 GROUP BY w",
    ),
    "title_pairs": (
        lambda s, d: title_pairs(_first_titles(s, d)),
        f"{TITLE_CLASSES} SELECT a.a, b.a AS b, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.a < b.a AND {MATCH_SQL}",
    ),
    "title_members": (_title_members, f"{TITLE_CLASSES} SELECT doc_id, a FROM w JOIN c USING (w)"),
    "fn_is_generic": (lambda s, d: K.table(s, d, "conversations").select("conv_id", "turn", T.is_generic(F.col("text")).alias("generic")), f"SELECT conv_id, turn, {GENERIC_SQL} AS generic FROM conversations"),
    "fn_is_generic_x": (lambda s, d: K.table(s, d, "conversations").select("conv_id", "turn", T.is_generic(F.col("text"), True).alias("generic")), f"SELECT conv_id, turn, {GENERIC_X_SQL} AS generic FROM conversations"),
    "fn_keywords4": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(F.array_sort(T.keywords(F.col("text"))), " ").alias("words")),
        "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}') AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.KEYWORD_STOP) + ")))), ' ') AS words FROM documents",
    ),
    "fn_key_phrases": (
        lambda s, d: _frame(s, ["The lack of data; how models fail, and validation needed.", "short", "a thing, b is bigger; whether it scales", ""], "text").select("id", F.array_join(T.key_phrases(F.col("text")), "|").alias("phrases")),
        "SELECT * FROM (VALUES (0::BIGINT, 'lack of data|models fail|validation needed'), (1, 'short'), (2, 'b is bigger|it scales'), (3, '')) v(id, phrases)",
    ),
    "fn_quant_signal": (
        lambda s, d: _docs(s, d).groupBy("lang").agg(F.round(F.avg(T.has_number(F.col("text")).cast("int")) * 100, 6).alias("pct")),
        "SELECT lang, round(avg(CASE WHEN regexp_matches(text, '\\d+\\.?\\d*%?') THEN 1 ELSE 0 END) * 100, 6) AS pct FROM documents GROUP BY 1",
    ),
    "fn_sota_signal": (
        lambda s, d: _docs(s, d).groupBy("lang").agg(F.round(F.avg(T.has_comparison(F.col("text")).cast("int")) * 100, 6).alias("pct")),
        f"SELECT lang, round(avg(CASE WHEN regexp_matches(lower(text), '{_re(T.COMPARISON)}') THEN 1 ELSE 0 END) * 100, 6) AS pct FROM documents GROUP BY 1",
    ),
    "fn_dead_end_kw": (
        lambda s, d: K.table(s, d, "conversations").select("conv_id", "turn", T.tells_failure(F.col("text")).alias("failed")),
        f"SELECT conv_id, turn, regexp_matches(lower(text), '{_re(T.FAILED)}') AS failed FROM conversations",
    ),
    "op_truncate": (
        lambda s, d: _docs(s, d).select("doc_id", T.truncate(F.col("text"), 100).alias("short")),
        "SELECT doc_id, CASE WHEN length(text) > 100 THEN text[:100] || '...' ELSE text END AS short FROM documents",
    ),
    "op_table_rows": (
        lambda s, d: _docs(s, d).join(K.table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("cluster"), F.substring("text", 1, 100).alias("abstract")),
        "SELECT d.doc_id, coalesce(quality, -1) AS cluster, text[:100] AS abstract FROM documents d LEFT JOIN labels USING (doc_id)",
    ),
    "op_slim": (lambda s, d: K.doc_papers(s, d).select("doc_id", "title"), f"WITH {K.DP} SELECT doc_id, title FROM dp"),
    "fn_strip_tags": (
        lambda s, d: K.table(s, d, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("sha")),
        "SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS sha FROM pages",
    ),
    "fn_abstract_from_index": (
        lambda s, d: s.createDataFrame([(0, {"deep": [1], "we": [0, 3], "learn": [2], "can": [3]}), (1, {})], "id long, index map<string,array<int>>").select("id", T.abstract_from_index(F.col("index")).alias("text")),
        "SELECT * FROM (VALUES (0::BIGINT, 'we deep learn can we'), (1, '')) v(id, text)",
    ),
    "fn_oa_pdf_url": (
        lambda s, d: s.createDataFrame([(0, "p.pdf", "o", ["x"]), (1, None, "o.pdf", ["x"]), (2, "", "o", [None, "", "l"]), (3, None, "o", []), (4, None, None, [])], "id long, p string, o string, l array<string>").select("id", T.open_pdf_url(F.col("p"), F.col("o"), F.col("l")).alias("url")),
        "SELECT * FROM (VALUES (0::BIGINT, 'p.pdf'), (1, 'o.pdf'), (2, 'l'), (3, 'o'), (4, NULL)) v(id, url)",
    ),
    "fn_parse_model_json": (
        lambda s, d: _frame(s, ANSWERS, "answer").select("id", F.explode(T.parse_answer(F.col("answer"))).alias("e")).select("id", "e.doi", "e.problem", "e.finding", "e.limits"),
        "SELECT * FROM (VALUES (0::BIGINT, '10.1/a', 'p', '', ''), (1, '10.1/b', '', 'f, [1]', ''), (2, '10.1/c', '', '', '')) v(id, doi, problem, finding, limits)",
    ),
    "fn_quality_trunc": (
        lambda s, d: T.checked_fields(K.table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("limits"), F.col("role").alias("method")), ["limits", "method"], 60).select("conv_id", "turn", "limits", F.array_join("quality_flags", ",").alias("flags")),
        "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN regexp_replace(text[:60], ' [^ ]*$', '') || '...' ELSE text END AS limits, CASE WHEN length(text) > 60 THEN 'limits_truncated' ELSE '' END AS flags FROM conversations",
    ),
    "fn_parse_actions": (
        lambda s, d: _frame(s, ['Done. ---ACTIONS--- {"actions":[{"type":"zoom"}]}', "Plain text ", "Bad ---ACTIONS--- {"], "text").select("id", T.parse_actions(F.col("text")).alias("p")).select("id", "p.text", F.size("p.actions").cast("long").alias("n")),
        "SELECT * FROM (VALUES (0::BIGINT, 'Done.', 1::BIGINT), (1, 'Plain text', 0), (2, 'Bad', 0)) v(id, text, n)",
    ),
    "fn_pair_parse": (
        lambda s, d: _frame(s, ["C0 <-> C2", "12<->3", "C7 - C8"], "text").select("id", T.parse_pair(F.col("text")).alias("p")).select("id", "p.a", "p.b"),
        "SELECT * FROM (VALUES (0::BIGINT, '0', '2'), (1, '3', '12'), (2, NULL, NULL)) v(id, a, b)",
    ),
    "fn_parse_jats": (
        lambda s, d: _frame(s, [JATS, "<broken"], "xml").select("id", M.parse_jats(F.col("xml")).alias("p")).select("id", "p.*"),
        "SELECT * FROM (VALUES (0::BIGINT, 'Methods We used cells .', 'Results and findings It works. Figure one.', 'Discussion Good.', 'Methods We used cells . Results and findings It works. Figure one. Discussion Good.'), (1, '', '', '', '')) v(id, methods_text, results_text, discussion_text, full_body_text)",
    ),
    "fn_jats_full": (
        lambda s, d: _frame(s, [JATS], "xml").select(M.parse_article(F.col("xml")).alias("p")).select("p.abstract", F.map_keys("p.sections")[1].alias("second"), F.size("p.figures").cast("long").alias("figures"), "p.full_text"),
        "SELECT 'Short abstract.' AS abstract, 'Results and findings' AS second, 1::BIGINT AS figures, '## Abstract' || chr(10) || chr(10) || 'Short abstract.' || chr(10) || chr(10) || '## Methods' || chr(10) || chr(10) || 'We used cells .' || chr(10) || chr(10) || '## Results and findings' || chr(10) || chr(10) || 'It works.' || chr(10) || chr(10) || '## Discussion' || chr(10) || chr(10) || 'Good.' AS full_text",
    ),
    "fn_jats_types": (
        lambda s, d: _frame(s, [TYPES], "xml").select(F.explode(M.parse_article(F.col("xml"))["sections"]).alias("name", "content")),
        "SELECT * FROM (VALUES ('Introduction', 'a'), ('Methods', 'b' || chr(10) || chr(10) || 'c'), ('Section', 'd'), ('Own', 'e')) v(name, content)",
    ),
    "fn_tei": (
        lambda s, d: _frame(s, [TEI], "xml").select(F.explode(M.parse_tei(F.col("xml"))).alias("name", "content")),
        "SELECT * FROM (VALUES ('Introduction', 'One.' || chr(10) || chr(10) || 'Two.'), ('Section', 'Bare.')) v(name, content)",
    ),
    "fn_regex_segment": (
        lambda s, d: _frame(s, [MARKDOWN, "plain text"], "t").select("id", F.explode(M.parse_markdown(F.col("t"))).alias("name", "content")),
        "SELECT * FROM (VALUES (0::BIGINT, 'Abstract', 'We do.'), (0, 'Methods', 'This way.'), (0, 'Results', '# Other' || chr(10) || 'More.'), (1, 'Content', 'plain text')) v(id, name, content)",
    ),
    "fn_xml_text": (
        lambda s, d: _frame(s, [JATS], "xml").select(F.array_join(F.filter(F.transform(F.xpath("xml", F.lit("//body//text()")), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != ""), " ").alias("text")),
        "SELECT 'Methods We used cells . Results and findings It works. Figure one. Discussion Good.' AS text",
    ),
    "src_content_chain": (
        lambda s, d: K.table(s, d, "documents").join(K.table(s, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 0, "xml").when(F.col("quality") == 1, "pdf").when(F.length("text") > 500, "abstract_only").otherwise("metadata_only").alias("content")),
        "SELECT doc_id, CASE WHEN toxic = 0 THEN 'xml' WHEN quality = 1 THEN 'pdf' WHEN length(text) > 500 THEN 'abstract_only' ELSE 'metadata_only' END AS content FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "src_pattern_hits": (
        lambda s, d: _docs(s, d).select("source", F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lower("text").rlike(p).alias("hit")) for p in ("the|and", "de la", "und|die", "token", "licen[sc]e")])).alias("x")).groupBy("x.pattern").agg(F.count("*").alias("n"), F.sum(F.col("x.hit").cast("long")).alias("hits"), F.round(F.avg(F.col("x.hit").cast("int")), 6).alias("rate")),
        "SELECT pattern, count(*) AS n, CAST(count_if(regexp_matches(lower(text), pattern)) AS BIGINT) AS hits, round(avg(CASE WHEN regexp_matches(lower(text), pattern) THEN 1 ELSE 0 END), 6) AS rate FROM documents, (VALUES ('the|and'), ('de la'), ('und|die'), ('token'), ('licen[sc]e')) p(pattern) GROUP BY 1",
    ),
}
