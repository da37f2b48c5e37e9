"""Scholarly web services as a Python data source: requests are batched, paged, spaced and retried in the reading tasks.

Options: service (a name of SERVICES), ids (a JSON list), batch (identifiers a request), filters (a JSON object of the
service's own filters), most (results wanted of each batch of a paged service; all by default), spacing (seconds between
requests to the service), lanes (tasks that ask at once; each waits so much longer), attempts, and for work without a
network fixture (a folder of saved answers `<batch>.json`, later pages `<batch>-<page>.json`) or answers (a JSON list of
answers, one a batch, or a list of pages)."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Service:
    url: str
    joint: str = ","
    #: Identifiers that one request takes, and seconds between requests.
    batch: int = 1
    spacing: float = 0.1
    #: Whether answers come in pages, by a cursor; whether a failed batch is asked again one identifier at a time; whether identifiers are posted.
    paged: bool = False
    singly: bool = False
    posted: bool = False


_WORKS = "https://api.openalex.org/works?per-page=200&cursor={cursor}"
# Public services' addresses, identifiers that one request takes, and least spacing.
SERVICES = {
    "openalex_dois": Service("https://api.openalex.org/works?per-page=50&filter=doi:{ids}", "|", 30, singly=True),
    "openalex_ids": Service("https://api.openalex.org/works?per-page=50&filter=openalex:{ids}", "|", 50, singly=True),
    "openalex_abstracts": Service("https://api.openalex.org/works?per-page=50&select=doi,abstract_inverted_index&filter=doi:{ids}", "|", 50),
    "openalex_search": Service(_WORKS + "&sort=cited_by_count:desc&search={ids}{filters}", " ", paged=True),
    "openalex_topic": Service(_WORKS + "&sort=cited_by_count:desc&filter=topics.id:{ids}{filters}", "|", paged=True),
    "openalex_citing": Service(_WORKS + "&filter=cites:{ids}{filters}", "|", paged=True),
    "europe_pmc": Service("https://www.ebi.ac.uk/europepmc/webservices/rest/search?format=json&resultType=core&query=DOI:{ids}", " OR DOI:", spacing=0.2),
    "europe_pmc_xml": Service("https://www.ebi.ac.uk/europepmc/webservices/rest/{ids}/fullTextXML", spacing=0.2),
    "semantic_scholar": Service("https://api.semanticscholar.org/graph/v1/paper/batch?fields=externalIds,abstract", batch=200, spacing=1.0, posted=True),
    "unpaywall": Service("https://api.unpaywall.org/v2/{ids}?email=nobody@example.org"),
    "crossref": Service("https://api.crossref.org/works/{ids}"),
    "biorxiv": Service("https://api.biorxiv.org/details/biorxiv/{ids}", spacing=0.5),
    "medrxiv": Service("https://api.biorxiv.org/details/medrxiv/{ids}", spacing=0.5),
}


class _Lane(InputPartition):
    def __init__(self, batches: list[tuple[int, list[str]]]):
        self.batches = batches


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.service = SERVICES[options["service"]]
        self.size = int(options.get("batch", self.service.batch))
        self.ids = json.loads(options.get("ids", "[]"))
        self.filters = json.loads(options.get("filters", "{}"))
        self.most = int(options["most"]) if options.get("most") else None
        self.lanes = max(1, int(options.get("lanes", 1)))
        self.spacing, self.attempts, self.fixture = float(options.get("spacing", self.service.spacing)), int(options.get("attempts", 3)), options.get("fixture")
        self.answers = json.loads(options["answers"]) if options.get("answers") else None

    def partitions(self) -> list[_Lane]:
        """Batches are dealt to the lanes; together the lanes keep to the service's rate."""
        batches = [(k, self.ids[i : i + self.size]) for k, i in enumerate(range(0, len(self.ids), self.size))]
        return [_Lane(batches[k :: self.lanes]) for k in range(min(self.lanes, max(1, len(batches))))]

    def _saved(self, batch: int, page: int) -> str | None:
        if self.answers is not None:
            pages = self.answers[batch] if batch < len(self.answers) else None
            pages = pages if isinstance(pages, list) else [pages]
            return pages[page] if page < len(pages) else None
        try:
            with open(f"{self.fixture}/{batch}{f'-{page}' if page else ''}.json") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _request(self, ids: list[str], cursor: str) -> Request:
        headers = {"User-Agent": "citeloom"}
        if self.service.posted:
            return Request(self.service.url, json.dumps({"ids": [f"DOI:{i}" for i in ids]}).encode(), headers | {"Content-Type": "application/json"}, method="POST")
        given = ",".join(f"{k}:{v}" for k, v in self.filters.items())
        given = given and (f",{given}" if "filter=" in self.service.url else f"&filter={given}")
        return Request(self.service.url.format(ids=quote(self.service.joint.join(ids), safe="/|:"), cursor=quote(cursor), filters=quote(given, safe="&=,:>|")), headers=headers)

    def _get(self, batch: int, page: int, ids: list[str], cursor: str) -> str | None:
        if self.answers is not None or self.fixture:
            return self._saved(batch, page)
        for attempt in range(self.attempts):
            time.sleep(self.spacing * self.lanes * 2**attempt)
            try:
                with urlopen(self._request(ids, cursor), timeout=60) as r:
                    return r.read().decode()
            except OSError:
                continue
        return None

    def _pages(self, batch: int, ids: list[str]) -> Iterator[tuple]:
        page, seen, cursor = 0, 0, "*"
        while True:
            body = self._get(batch, page, ids, cursor)
            if page and body is None:
                return
            yield batch, page, ids, body
            found = json.loads(body) if body and self.service.paged else {}
            seen, page, cursor = seen + len(found.get("results", [])), page + 1, (found.get("meta") or {}).get("next_cursor")
            if not cursor or not found.get("results") or (self.most is not None and seen >= self.most):
                return

    def read(self, lane: _Lane) -> Iterator[tuple]:
        for batch, ids in lane.batches:
            for row in self._pages(batch, ids):
                if row[3] is None and self.service.singly and len(ids) > 1 and self.answers is None and not self.fixture:
                    for one in ids:
                        yield from self._pages(batch, [one])
                else:
                    yield row


class WebSource(DataSource):
    """Rows (batch, page, ids, body); body is null where no attempt succeeded."""

    @classmethod
    def name(cls) -> str:
        return "scholarly_web"

    def schema(self) -> str:
        return "batch int, page int, ids array<string>, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_web(spark: SparkSession, service: str, ids: list[str], **options: str) -> DataFrame:
    """A service's answers for identifiers that the driver holds, as a search's or a user's list; see `fetch` for a table of them."""
    spark.dataSource.register(WebSource)
    return spark.read.format("scholarly_web").options(service=service, ids=json.dumps(ids), **options).load()


def fetch(ids: DataFrame, service: str, lanes: int = 1, **options: str) -> DataFrame:
    """read_web's rows for the identifiers (first column) of a table of any size: `lanes` tasks ask, the driver holds none of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, held, at = int(options.get("batch", SERVICES[service].batch)), [], 0

        def ask(part: list[str], batch: int) -> pd.DataFrame:
            reader = _Reader({"service": service, "ids": "[]", "lanes": str(lanes), **options})
            return pd.DataFrame(list(reader.read(_Lane([(batch, part)]))), columns=["batch", "page", "ids", "body"])

        for frame in frames:
            held += frame.iloc[:, 0].tolist()
            while len(held) >= size:
                yield ask(held[:size], at)
                held, at = held[size:], at + 1
        if held:
            yield ask(held, at)

    return ids.select(ids.columns[0]).repartition(lanes).mapInPandas(run, "batch int, page int, ids array<string>, body string")


WORK = (
    "id string, doi string, title string, publication_year int, publication_date string, cited_by_count int, type string, referenced_works array<string>, abstract_inverted_index map<string,array<int>>, "
    "open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, primary_location struct<pdf_url:string,source:struct<display_name:string>>, locations array<struct<pdf_url:string>>, "
    "topics array<struct<display_name:string,score:double,subfield:struct<display_name:string>>>, authorships variant"
)


def works(answers: DataFrame) -> DataFrame:
    """Works of answers as flat papers: first five topics, best open PDF, abstract from its index."""
    from citeloom.functions.identifiers import normalize_doi
    from citeloom.functions.text import abstract_from_index, open_pdf_url

    w = answers.select(F.explode(F.from_json("body", f"results array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _fields(WORK))}>>")["results"]).alias("w")).select("w.*")
    return w.select(
        F.col("id").alias("openalex_id"), normalize_doi(F.col("doi")).alias("doi"), "title", F.col("publication_year").alias("year"), "publication_date", "cited_by_count", "type", "referenced_works",
        F.slice("topics", 1, 5).alias("topics"), abstract_from_index(F.col("abstract_inverted_index")).alias("abstract"), F.col("open_access.is_oa").alias("is_oa"), F.col("open_access.oa_status").alias("oa_status"),
        F.col("primary_location.source.display_name").alias("journal"), open_pdf_url(F.col("primary_location.pdf_url"), F.col("open_access.oa_url"), F.transform("locations", lambda x: x["pdf_url"])).alias("pdf_url"), "authorships",
    )


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return out


def enrich(papers: DataFrame, fetched: DataFrame, fields: list[str]) -> DataFrame:
    """papers with the requested columns replaced by what was fetched for their identifier, where there is something."""
    new = fetched.select("doi", *[F.col(f).alias(f"new_{f}") for f in fields])
    both = papers.join(new, "doi", "left")
    return both.select(*[c for c in papers.columns if c not in fields], *[F.coalesce(f"new_{f}", f).alias(f) if f in papers.columns else F.col(f"new_{f}").alias(f) for f in fields])


def resolve_ids(refs: DataFrame, lookup: DataFrame) -> DataFrame:
    """References by work id as identifiers; those that no lookup row resolves are dropped."""
    return refs.join(lookup, "openalex_id").select("doc_id", F.col("doi").alias("ref"))


def top_works(found: DataFrame, most: int) -> DataFrame:
    """The best-cited works of a search."""
    return found.orderBy(F.desc("cited_by_count"), "openalex_id").limit(most)


def openalex_abstracts(answers: DataFrame) -> DataFrame:
    """doi, abstract of works' answers that have one."""
    return works(answers).where("doi is not null and abstract <> ''").select(F.lower("doi").alias("doi"), "abstract")


def semantic_scholar_abstracts(answers: DataFrame) -> DataFrame:
    """doi, abstract of answers whose body is a list beside the list of identifiers asked for: an answer without an identifier takes its place's."""
    item = "array<struct<abstract:string,externalIds:struct<DOI:string>>>"
    rows = answers.select("ids", F.posexplode(F.from_json("body", item)).alias("pos", "x"))
    return rows.select(F.lower(F.coalesce(F.col("x.externalIds.DOI"), F.get("ids", F.col("pos")))).alias("doi"), F.col("x.abstract").alias("abstract")).where("abstract <> ''")


def europe_pmc_results(answers: DataFrame) -> DataFrame:
    """doi, pmcid, abstract without tags."""
    kind = "resultList struct<result:array<struct<doi:string,pmcid:string,abstractText:string>>>"
    rows = answers.select(F.explode(F.from_json("body", kind)["resultList"]["result"]).alias("r"))
    return rows.select(F.lower("r.doi").alias("doi"), "r.pmcid", F.regexp_replace("r.abstractText", "<[^>]+>", "").alias("abstract"))


def one_url(answers: DataFrame, path: str) -> DataFrame:
    """id, url: the address at a JSON path of each answer, as a resolver of one service gives it."""
    return answers.select(F.get("ids", F.lit(0)).alias("id"), F.get_json_object("body", path).alias("url")).where("url is not null")


def unpaywall_urls(answers: DataFrame) -> DataFrame:
    return one_url(answers, "$.best_oa_location.url_for_pdf")


def europe_pmc_urls(answers: DataFrame) -> DataFrame:
    """id, url: the first open PDF among a result's full-text addresses."""
    kind = "resultList struct<result:array<struct<fullTextUrlList:struct<fullTextUrl:array<struct<documentStyle:string,availability:string,url:string>>>>>>"
    urls = F.flatten(F.transform(F.from_json("body", kind)["resultList"]["result"], lambda r: r["fullTextUrlList"]["fullTextUrl"]))
    first = F.get(F.filter(urls, lambda u: (u["documentStyle"] == "pdf") & u["availability"].isin("Open access", "Free")), F.lit(0))["url"]
    return answers.select(F.get("ids", F.lit(0)).alias("id"), first.alias("url")).where("url is not null")


def preprint_urls(answers: DataFrame, server: str = "biorxiv") -> DataFrame:
    """id, url: the PDF of an article's latest version on a preprint server."""
    latest = F.try_element_at(F.from_json("body", "collection array<struct<doi:string>>")["collection"], F.lit(-1))["doi"]
    return answers.select(F.get("ids", F.lit(0)).alias("id"), F.concat(F.lit(f"https://www.{server}.org/content/"), latest, F.lit(".full.pdf")).alias("url")).where("url is not null")


def crossref_urls(answers: DataFrame) -> DataFrame:
    """id, url: the first link that is a PDF by its type or its address."""
    links = F.from_json("body", "message struct<link:array<struct<URL:string,`content-type`:string>>>")["message"]["link"]
    first = F.get(F.filter(links, lambda x: (x["content-type"] == "application/pdf") | F.lower(x["URL"]).contains("pdf")), F.lit(0))["URL"]
    return answers.select(F.get("ids", F.lit(0)).alias("id"), first.alias("url")).where("url is not null")


def article_xml(found: DataFrame, answers: DataFrame) -> DataFrame:
    """doi, pmcid, xml: europe_pmc_results beside the full texts that europe_pmc_xml answers for their pmcid."""
    return found.where("pmcid is not null").join(answers.select(F.get("ids", F.lit(0)).alias("pmcid"), F.col("body").alias("xml")).where("xml is not null"), "pmcid").select("doi", "pmcid", "xml")


def download_pdfs(urls: DataFrame, spacing: float = 2.0, lanes: int = 1) -> DataFrame:
    """doi, kind `pdf`, content of urls(doi, url) that answer with a PDF, for Store.save_content, which puts all of them in place at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def get(url: str) -> bytes | None:
            time.sleep(spacing * lanes)
            try:
                with urlopen(Request(url, headers={"User-Agent": "citeloom"}), timeout=60) as r:
                    return r.read()
            except (OSError, ValueError):
                return None

        for frame in frames:
            for doi, url in zip(frame["doi"], frame["url"], strict=True):  # one at a time: contents are large
                yield pd.DataFrame({"doi": [doi], "kind": ["pdf"], "content": [get(url)]})

    return urls.select("doi", "url").repartition(lanes).mapInPandas(run, "doi string, kind string, content binary").where(is_pdf(F.col("content")))


def is_pdf(content):
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded files that begin as PDFs do."""
    return spark.read.format("binaryFile").load(path).where(is_pdf(F.col("content"))).select("path", "length", "content")


def sample_answer(works_: list[dict], cursor: str | None = None) -> str:
    return json.dumps({"meta": {"next_cursor": cursor}, "results": works_})
