"""Text functions: generic limitations, keywords, signals, model answers, actions, abstracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of texts that say nothing of their own.
GENERIC = [
    r"more data", r"more research", r"further (study|studies|research|investigation|work)", r"larger (dataset|sample|cohort)",
    r"additional (data|experiments|validation)", r"limited (data|sample size)", r"computational(ly)? (expensive|costly|intensive)",
    r"not (yet |fully )?(validated|verified|tested)",
]
# Further such patterns of the expanded test.
GENERIC_MORE = [
    r"further research is needed", r"more studies are (required|needed|necessary)", r"limitations? (include|of (this|the) (study|work|approach|model))",
    r"future work should", r"future (studies|research|work) (should|could|may|might|will)", r"this (study|work|paper|model) (is |has )?(limited|constrained)",
    r"(remains?|remain) (to be|an) (open|challenging|difficult|unsolved|unclear)", r"(needs?|requires?) (further|additional|more) (investigation|validation|testing|study)",
    r"(broader|wider) (applicability|generalization|validation)", r"long[- ]term (impact|effect|consequence|outcome)",
    r"(more|additional) (experimental|empirical) (validation|evidence|data)", r"(lack|absence) of (sufficient|enough|adequate) (data|evidence)",
    r"(scalability|generalizability) (remains?|is) (a|an) (challenge|concern|issue|limitation)", r"(real[- ]world|in vivo|clinical) (validation|testing|application)",
    r"(further|additional) (work|effort|investigation) (is|are) (needed|required|necessary)", r"investigation needed", r"(unclear|unknown) (whether|how|if|what)",
    r"(need|require)s? validation", r"(applied|tested) (only |primarily )?(in|to|on) (a |the )?(limited|small|single)",
]
# Words that aren't keywords of a limitation.
KEYWORD_STOP = [
    "this", "that", "with", "from", "have", "been", "which", "their", "these", "those", "also", "into", "only", "such", "does", "would", "could", "should", "more",
    "most", "some", "other", "than", "very", "will", "each", "both", "well", "still", "however", "while", "when", "where", "about", "between", "through", "during",
    "after", "before", "being", "over", "under", "same", "different", "specific", "particular", "model", "models", "approach", "method", "methods", "study", "work",
    "based", "using", "used", "results", "limited", "limitations",
]
# Words of comparisons, and phrases of failed work.
COMPARISON = ["outperform", "state-of-the-art", "sota", "better than", "improve", "improvement", "compared to", "superior", "exceeds", "surpass", "best", "competitive"]
FAILED = [
    "failed", "unsuccessful", "negative result", "no significant", "inconclusive", "not validated", "could not", "unable to", "did not", "lack of", "insufficient",
    "limitation", "overestimate", "underestimate", "overfit", "artifact",
]
# Fields of an extraction, in order.
EXTRACTION_FIELDS = ["problem", "method", "finding", "dataset", "metric", "baseline", "result", "enables", "limits", "open_questions"]

# What parts key phrases, and articles before them.
PHRASE_BREAK, PHRASE_START = r"[;]|,\s+(?:and|or)\s+|,\s+(?=[a-z])", r"^(the|a|an|this|that|whether|if|how|what)\s+"
# Fences around a model's answer, and the answer's array.
FENCE_OPEN, FENCE_CLOSE, OUTER_ARRAY = r"(?m)^```json\s*", r"(?m)^```\s*$", r"(?s)\[.*\]"


def _any(text: Column, patterns: list[str]) -> Column:
    return F.lower(text).rlike("|".join(patterns))


def is_generic(text: Column, expanded: bool = False) -> Column:
    """Null, under ten characters without outer white space, or a generic phrase."""
    return F.coalesce((F.length(F.trim(text)) < 10) | _any(text, GENERIC + GENERIC_MORE * expanded), F.lit(True))


def keywords(text: Column) -> Column:
    """Distinct words of four letters a-z or more that aren't stop words, in order of appearance."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in KEYWORD_STOP]))


def key_phrases(text: Column) -> Column:
    """Parts between semicolons and list commas, without a leading article and a final dot, of 6 to 199 characters; else the whole text."""
    low = F.lower(text)
    parts = F.transform(F.split(low, PHRASE_BREAK), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"\.+$", ""), PHRASE_START, ""))
    kept = F.filter(parts, lambda p: (F.length(p) > 5) & (F.length(p) < 200))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(kept) > 0, kept).otherwise(F.array(F.regexp_replace(F.trim(low), r"\.+$", "")))


def has_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\d+\.?\d*%?"), F.lit(False))


def has_comparison(text: Column) -> Column:
    return F.coalesce(_any(text, COMPARISON), F.lit(False))


def tells_failure(text: Column) -> Column:
    return F.coalesce(_any(text, FAILED), F.lit(False))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index (word -> positions); words of one position are ordered by name."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " ")


def open_pdf_url(primary: Column, oa_url: Column, pdf_urls: Column) -> Column:
    """The main location's PDF, an open address that ends in .pdf, any location's PDF, any open address."""
    given = lambda c: F.when(c != "", c)
    return F.coalesce(given(primary), F.when(oa_url.endswith(".pdf"), oa_url), F.get(F.filter(pdf_urls, lambda u: u.isNotNull() & (u != "")), F.lit(0)), given(oa_url))


def parse_answer(text: Column) -> Column:
    """A model's answer as an array of extractions: fences off, the outermost array, objects with an identifier; missing fields are empty."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), FENCE_OPEN, ""), FENCE_CLOSE, "")
    found = F.regexp_extract(plain, OUTER_ARRAY, 0)
    kind = "array<struct<doi:string," + ",".join(f"{f}:string" for f in EXTRACTION_FIELDS) + ">>"
    rows = F.filter(F.from_json(found, kind), lambda x: x["doi"].isNotNull())
    full = F.transform(rows, lambda x: F.struct(x["doi"].alias("doi"), *[F.coalesce(x[f], F.lit("")).alias(f) for f in EXTRACTION_FIELDS]))
    return F.coalesce(full, F.array().cast(kind))


def shorten_field(text: Column, n: int = 200) -> Column:
    """Over n characters: cut at the last space within them, with dots."""
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), r" [^ ]*$", ""), F.lit("..."))).otherwise(text)


def checked_fields(extractions, fields: list[str], n: int = 200):
    """The extractions with fields over n characters shortened, and quality_flags: `{field}_truncated` of each of them, in order."""
    flags = F.array_compact(F.array(*[F.when(F.length(f) > n, F.lit(f"{f}_truncated")) for f in fields]))
    return extractions.withColumns({"quality_flags": flags} | {f: shorten_field(F.col(f), n) for f in fields})


def parse_actions(text: Column) -> Column:
    """struct(text, actions): what stands before the marker, and the JSON list `actions` behind it."""
    parts = F.split(text, "---ACTIONS---", 2)
    actions = F.from_json(F.trim(F.get(parts, F.lit(1))), "actions array<map<string,string>>")["actions"]
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("text"), F.coalesce(actions, F.array().cast("array<map<string,string>>")).alias("actions"))


def parse_pair(text: Column) -> Column:
    """struct(a, b) of `C0 <-> C2`, the smaller number first; null if it isn't a pair."""
    a, b = (F.regexp_extract(text, r"^C?(\d+)\s*<->\s*C?(\d+)", k) for k in (1, 2))
    swap = a.try_cast("int") > b.try_cast("int")
    return F.when(a != "", F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b")))
