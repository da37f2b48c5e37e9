"""Sections of articles in JATS XML, TEI XML and markdown. Parsing is one pass of events, Arrow-batched.

The pass lays an article out as a list of text pieces in document order and a list of elements, each with its
parent and the range of pieces under it. Everything else is selection: sections are (name, text) rows over
those lists, and rows of one name are merged."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

# Title words and section types of the three groups.
GROUPS = {
    "methods_text": (["method", "material", "experiment", "procedure"], ["methods", "materials", "materials|methods", "materials-methods"]),
    "results_text": (["result", "finding"], ["results", "results|discussion"]),
    "discussion_text": (["discussion", "conclusion"], ["discussion", "conclusions"]),
}
# Names of section types without a title.
TYPE_NAMES = {
    "intro": "Introduction", "introduction": "Introduction", "background": "Background", "methods": "Methods", "materials": "Methods", "materials|methods": "Methods", "results": "Results",
    "discussion": "Discussion", "conclusions": "Conclusions", "conclusion": "Conclusions", "supplementary-material": "Supplementary", "acknowledgments": "Acknowledgments", "references": "References",
}
# Fixed value: headers of markdown sections.
HEADER = re.compile(r"(?:^|\n)#+\s*(\d*\.?\s*(?:Abstract|Introduction|Background|Methods|Materials|Results|Discussion|Conclusions?|Acknowledgments?|References))\s*\n", re.IGNORECASE)
TEI = "{http://www.tei-c.org/ns/1.0}"
NUMBERING = re.compile(r"^\d+\.\s*")


@dataclass
class Element:
    tag: str
    kind: str
    parent: int
    first: int
    last: int = -1
    #: The text before the first child, as it stands.
    lead: str = ""


@dataclass
class Layout:
    """Receives a parser's events; afterwards holds the elements and the text pieces."""

    elements: list[Element] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    _open: list[int] = field(default_factory=list)
    _text: list[str] = field(default_factory=list)
    _fresh: bool = False

    def _settle(self) -> None:
        text = "".join(self._text)
        self._text.clear()
        if self._fresh:
            self.elements[self._open[-1]].lead = text
        if piece := text.strip():
            self.pieces.append(piece)

    def start(self, tag: str, attributes: dict) -> None:
        self._settle()
        self.elements.append(Element(tag, attributes.get("sec-type", "").lower(), self._open[-1] if self._open else -1, len(self.pieces)))
        self._open.append(len(self.elements) - 1)
        self._fresh = True

    def data(self, text: str) -> None:
        self._text.append(text)

    def end(self, tag: str) -> None:
        self._settle()
        self.elements[self._open.pop()].last = len(self.pieces)
        self._fresh = False

    def close(self) -> Layout:
        return self

    def text(self, at: int | None) -> str:
        """All text under an element, stripped pieces joined by single spaces."""
        return "" if at is None else " ".join(self.pieces[self.elements[at].first : self.elements[at].last])

    def under(self, at: int, tag: str) -> Iterator[int]:
        """Elements of a tag anywhere under another, in document order."""
        inside = {at}
        for k in range(at + 1, len(self.elements)):
            if self.elements[k].parent not in inside:
                break
            inside.add(k)
            if self.elements[k].tag == tag:
                yield k

    def children(self, at: int, tag: str) -> list[int]:
        return [k for k in self.under(at, tag) if self.elements[k].parent == at]

    def title(self, at: int, tag: str = "title") -> str:
        own = self.children(at, tag)
        return self.elements[own[0]].lead if own else ""

    def paragraphs(self, at: int, tag: str = "p") -> str:
        return "\n\n".join(filter(None, map(self.text, self.children(at, tag))))


def layout(xml: str | None) -> Layout | None:
    """None for nothing and for what isn't well-formed."""
    try:
        parser = ET.XMLParser(target=Layout())
        parser.feed(xml or "")
        return parser.close()
    except ET.ParseError:
        return None


def merged(rows: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Texts by name in order of appearance; texts of one name follow each other, empty ones are left out."""
    out: dict[str, list[str]] = {}
    for name, text in rows:
        if text:
            out.setdefault(name, []).append(text)
    return {name: "\n\n".join(texts) for name, texts in out.items()}


def section_text(xml: str | None, titles: list[str], kinds: list[str]) -> str:
    """The sections whose type holds one of the kinds or whose title one of the words, nested ones again by themselves."""
    page = layout(xml)
    if page is None:
        return ""
    wanted = (k for k, e in enumerate(page.elements) if e.tag == "sec" and (any(x in e.kind for x in kinds) or any(x in page.title(k).lower() for x in titles)))
    return "\n\n".join(map(page.text, wanted))


def body_text(xml: str | None) -> str:
    page = layout(xml)
    return "" if page is None else page.text(next((k for k, e in enumerate(page.elements) if e.tag == "body"), None))


def jats_groups(xml: str | None) -> dict[str, str]:
    return {name: section_text(xml, *words) for name, words in GROUPS.items()} | {"full_body_text": body_text(xml)}


def jats_article(xml: str | None) -> dict:
    """abstract, sections (by name, in order), tables and figures (captions), full_text (markdown)."""
    page = layout(xml)
    if page is None or not page.elements:
        return {"abstract": "", "sections": {}, "tables": [], "figures": [], "full_text": ""}
    top = next((k for k, e in enumerate(page.elements) if e.tag == "article"), 0)
    abstract = page.text(next(page.under(top, "abstract"), None))
    body = next(page.under(top, "body"), None)
    found = page.under(body, "sec") if body is not None else ()
    sections = merged((page.title(k).strip() if page.title(k) else TYPE_NAMES.get(page.elements[k].kind, "Section"), page.paragraphs(k)) for k in found)
    captions = {tag: [page.text(c) for k in page.under(top, tag) if (c := next(page.under(k, "caption"), None)) is not None] for tag in ("table-wrap", "fig")}
    parts = [(name, text) for name, text in [("Abstract", abstract), *sections.items()] if text]
    return {"abstract": abstract, "sections": sections, "tables": captions["table-wrap"], "figures": captions["fig"], "full_text": "\n\n".join(f"## {name}\n\n{text}" for name, text in parts)}


def tei_sections(xml: str | None) -> dict[str, str]:
    page = layout(xml)
    body = None if page is None else next((k for k, e in enumerate(page.elements) if e.tag == f"{TEI}body"), None)
    if body is None:
        return {}
    names = {k: page.title(k, f"{TEI}head") for k in page.children(body, f"{TEI}div")}
    return merged((NUMBERING.sub("", name.strip()) if name else "Section", page.paragraphs(k, f"{TEI}p")) for k, name in names.items())


def markdown_sections(text: str | None) -> dict[str, str]:
    """Texts between known headers, the last of one name; the whole text as `Content` where there are none."""
    pieces = HEADER.split(text or "")
    found = {NUMBERING.sub("", name.strip()).title(): content.strip() for name, content in zip(pieces[1::2], pieces[2::2], strict=True) if content.strip()}
    return found or {"Content": t for t in [(text or "").strip()] if t}


def _udf(parse, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(parse)

    return run


def _struct(parse, kind: str):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(x.map(parse).tolist(), columns=[c.split()[0] for c in kind.split(", ")])

    return run


def parse_jats(xml):
    return _struct(jats_groups, "methods_text string, results_text string, discussion_text string, full_body_text string")(xml)


def parse_article(xml):
    return _struct(jats_article, "abstract string, sections map<string,string>, tables array<string>, figures array<string>, full_text string")(xml)


def parse_sections(xml, titles: list[str], kinds: list[str]):
    """Text of the sections with these title words or types."""
    return _udf(lambda x: section_text(x, titles, kinds), "string")(xml)


def parse_body(xml):
    return _udf(body_text, "string")(xml)


def parse_tei(xml):
    return _udf(tei_sections, "map<string,string>")(xml)


def parse_markdown(text):
    return _udf(markdown_sections, "map<string,string>")(text)


def pdf_text(content):
    """The text of PDF bytes where a PDF library is installed, else null; what isn't a PDF gives null."""

    def read(b: bytes | None) -> str | None:
        try:
            import fitz
        except ImportError:
            return None
        return "\n".join(page.get_text() for page in fitz.open(stream=b, filetype="pdf")) if b and b.startswith(b"%PDF") else None

    return _udf(read, "string")(content)
