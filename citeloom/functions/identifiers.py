"""Paper identifiers: normal forms, kinds, safe names; title words and title matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and patterns that tell the kinds of identifiers apart, all on lower case.
SUPPLEMENT = r"\.s\d{3,4}$|_suppl\d*$|\.supp\d*$|(?<=[a-z\d])s\d{1,2}$"
EDITORIAL_SUFFIX = r"\.sa\d+$"
EDITORIAL_PREFIXES = ["10.3410/f.", "10.5256/f1000research.", "10.7490/f1000research."]
DATASET_PREFIXES = [
    "10.5281/zenodo.", "10.6084/m9.figshare.", "10.17632/", "10.17605/osf.io/", "10.5061/dryad.", "10.5523/bris.", "10.5518/", "10.4233/uuid:",
    "10.24355/dbbs.", "10.7910/dvn/", "10.5282/edm/", "10.15468/", "10.48321/", "10.22032/dbt.", "10.26153/tsw/", "10.14264/",
]
BIORXIV = r"^10\.1101/(?:\d{4}\.\d{2}\.\d{2}\.\d+|\d{6,})$"
PREPRINT_PREFIXES = [
    "10.48550/arxiv.", "10.2139/ssrn.", "10.26434/chemrxiv", "10.26434/chemrxiv-", "10.21203/rs.", "10.31219/osf.io/", "10.7287/peerj.preprints.",
    "10.20944/preprints", "10.31223/", "10.31235/osf.io/", "10.31224/osf.io/", "10.26226/morressier.",
]
SUB_ARTICLE = r"^10\.7554/elife\.\d+\.\d{3,}$"
BOOK_CHAPTER = r"^10\.1007/978-|^10\.1016/b978-|^10\.1201/|^10\.1002/978|^10\.1515/978|^10\.4018/978-"
LONG_REGISTRAR = r"^10\.\d{5,}/"
RESEARCH_KINDS = ["journal", "preprint", "book_chapter"]
TITLE_NOISE = ["preprint", "published", "version", "revised", "updated", "v1", "v2", "v3", "v4"]


def normalize_doi(doi: Column) -> Column:
    """Without the resolver's address; the case stays."""
    return F.regexp_replace(doi, r"^https?://doi\.org/", "")


def normalize_doi_lower(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(doi)), r"^https?://doi\.org/", "")


def doi_kind(doi: Column) -> Column:
    """One of supplementary, editorial, dataset, preprint, book_chapter, other, journal: the first rule that fits."""
    d = F.lower(F.trim(normalize_doi(doi)))

    def any_prefix(prefixes: list[str]) -> Column:
        return d.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")

    cold_spring = d.startswith("10.1101/")
    return (
        F.when(doi.isNull() | (doi == ""), "other")
        .when(d.rlike(SUPPLEMENT), "supplementary")
        .when(d.rlike(EDITORIAL_SUFFIX) | any_prefix(EDITORIAL_PREFIXES), "editorial")
        .when(any_prefix(DATASET_PREFIXES), "dataset")
        .when(cold_spring & d.rlike(BIORXIV), "preprint")
        .when(~cold_spring & any_prefix(PREPRINT_PREFIXES), "preprint")
        .when(d.rlike(SUB_ARTICLE), "editorial")
        .when(d.rlike(BOOK_CHAPTER), "book_chapter")
        .when(d.rlike(LONG_REGISTRAR), "other")
        .otherwise("journal")
    )


def is_research(doi: Column) -> Column:
    return doi_kind(doi).isin(RESEARCH_KINDS)


def safe_name(doi: Column) -> Column:
    """A directory name: no resolver address, `/` as `__`, other special characters as `_hex_` of their code."""
    plain = F.replace(F.replace(F.replace(doi, F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit("")), F.lit("/"), F.lit("__"))
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    code = lambda c: F.lower(F.hex(F.ascii(c).cast("long")))
    return F.array_join(F.transform(letters, lambda c: F.when(c.rlike(r"[a-zA-Z0-9._\-]"), c).otherwise(F.concat(F.lit("_"), F.lpad(code(c), F.greatest(F.lit(2), F.length(code(c))), F.lit("0")), F.lit("_")))), "")


def title_words(title: Column) -> Column:
    """Lower-case words without punctuation and noise words, in order."""
    clean = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)[^\w\s]", "")
    return F.filter(F.split(clean, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(TITLE_NOISE))


def same_title(words_a: Column, words_b: Column, threshold: float = 0.85) -> Column:
    """Whether two arrays of distinct title words are of one work: two words or more shared, and enough of the union or of the smaller."""
    shared = F.size(F.array_intersect(words_a, words_b))
    return (shared >= 2) & ((shared / F.size(F.array_union(words_a, words_b)) >= threshold) | (shared / F.least(F.size(words_a), F.size(words_b)) >= threshold))
