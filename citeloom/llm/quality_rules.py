"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document gets counts of its words, characters, symbols, lines and repetitions. Mergeable quantile
sketches of four measures, per language and source, give each group its own fences: a quartile plus or minus
some spreads. A group's quartiles are drawn towards its language's, and a language's towards those of all, by
as much as SHRINK documents weigh beside its own: the same rule at every size. The fences are joined back, and
documents outside of them, or that fail the fixed base rule, aren't kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Words of a window whose repetition counts.
WINDOW = 8
#: Documents that a group's parent weighs as in the group's quartiles.
SHRINK = 50
#: Relative error of the sketches is one in so many.
ACCURACY = 10_000
#: measure -> (spreads below the first quartile or None, spreads above the third, least spread).
RULES = {
    "word_length": (6.0, 6.0, 0.35),
    "symbol_share": (None, 4.0, 0.01),
    "dup_line_share": (None, 4.0, 0.07),
    "repeat_share": (None, 4.0, 0.04),
}


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's variable stands for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """The number of words inside windows that the text has twice or more. Windows are told apart by 64-bit hashes."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def found(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, twice))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        return F.when(F.size(w) <= WINDOW, 0).otherwise(let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))), found))

    return let(words, windows)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each row of docs. A null text has no words, lines or symbols."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    pieces = F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " ", -1)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = base.select("doc_id", "lang", "source", F.length("text").alias("n_chars"), F.length(F.translate("text", "#*$%&|<>", "")).alias("plain"), pieces.alias("pieces"), lines.alias("lines"))
    words = F.array_remove("pieces", "")
    return found.select(
        "doc_id", "lang", "source",
        F.size(words).cast("long").alias("n_words"),
        (F.col("n_chars") - F.size("pieces") + 1).cast("long").alias("word_chars"),
        (F.col("n_chars") - F.col("plain")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
    )


def _shares() -> dict[str, Column]:
    whole = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / whole,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / whole,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quartiles(measured: DataFrame) -> DataFrame:
    """f_lang, f_source, level, n and each measure's quartiles, of the documents that pass the base rule.

    level 0 is a group's own, level 1 (source null) a language's, level 3 all documents'."""
    good = measured.where(~base_failed()).select("lang", "source", *[c.alias(k) for k, c in _shares().items()])
    sketches = good.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *[F.percentile_approx(k, [0.25, 0.75], ACCURACY).alias(k) for k in RULES])
    return sketches.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "level", "n", *[F.element_at(k, q).alias(f"{k}_q{q}") for k in RULES for q in (1, 2)])


def fences(sketches: DataFrame) -> DataFrame:
    """f_lang, f_source and each measure's low and high fence for every group of quartiles."""
    names = [f"{k}_q{q}" for k in RULES for q in (1, 2)]
    level = lambda k, tag: sketches.where(F.col("level") == k).select("f_lang", "f_source", *[F.col(c).alias(f"{tag}{c}") for c in ("n", *names)])
    whole, language, own = level(3, "w_").drop("f_lang", "f_source"), level(1, "l_").drop("f_source").withColumnRenamed("f_lang", "l_lang"), level(0, "")
    rows = own.join(language, F.col("f_lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(whole))  # all documents' is one row
    drawn = lambda x, n, parent: (F.col(x) * F.col(n) + parent * SHRINK) / (F.col(n) + SHRINK)
    rows = rows.select("f_lang", "f_source", *[drawn(c, "n", drawn(f"l_{c}", "l_n", F.col(f"w_{c}"))).alias(c) for c in names])
    out = [F.col("f_lang"), F.col("f_source")]
    for k, (below, above, least) in RULES.items():
        q1, q3 = F.col(f"{k}_q1"), F.col(f"{k}_q2")
        spread = F.greatest(q3 - q1, F.lit(least))
        out += [(F.lit(None).cast("double") if below is None else q1 - below * spread).alias(f"{k}_low"), (q3 + above * spread).alias(f"{k}_high")]
    return rows.select(*out)


def _inside() -> Column:
    ok = F.lit(True)
    for k, share in _shares().items():
        ok = ok & (share <= F.col(f"{k}_high")) & (F.lit(True) if RULES[k][0] is None else share >= F.col(f"{k}_low"))
    return ok


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed and kept.

    Null languages and sources are groups of their own. A null or empty text fails the base rule. Repeated rows
    count as they come; where no document passes the base rule, none is kept; extra columns are not read."""
    measured = materialize(measures(docs, id_col, text_col, lang_col, source_col), "measures")
    sketches = materialize(quartiles(measured), "quartiles")
    chosen = materialize(fences(sketches), "fences")
    discard(sketches)
    both = measured.join(chosen, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    failed = base_failed()
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(_inside(), F.lit(False))).alias("kept"))


def _sql() -> str:
    """The same in DuckDB. A sketch of fewer than ACCURACY values is exact: the value whose rank is the quantile's share of n, rounded up."""
    shares = {
        "word_length": "word_chars / greatest(n_words, 1)", "symbol_share": "n_symbols / greatest(word_chars, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    }
    pick = ", ".join(f"list_sort(list({k}))[CAST(greatest(1, ceil({q} * count(*))) AS BIGINT)] AS {k}_q{n}" for k in shares for n, q in ((1, 0.25), (3, 0.75)))
    names = [f"{k}_q{n}" for k in shares for n in (1, 3)]
    drawn = lambda c: f"({c} * n + {SHRINK} * l_{c}) / (n + {SHRINK})"
    fence = ", ".join(f"{k}_q3 + {a} * greatest({k}_q3 - {k}_q1, {s}) AS {k}_high" + (f", {k}_q1 - {b} * greatest({k}_q3 - {k}_q1, {s}) AS {k}_low" if b is not None else "") for k, (b, a, s) in RULES.items())
    inside = " AND ".join(f"{k} <= {k}_high" + (f" AND {k} >= {k}_low" if RULES[k][0] is not None else "") for k in RULES)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS w FROM (SELECT *, unnest(generate_series(1, len(words) - 7)) AS i FROM t WHERE len(words) > 7)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.c, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in shares.items())} FROM m),
w AS (SELECT count(*) AS n, {pick} FROM b WHERE NOT base_failed),
l0 AS (SELECT lang, count(*) AS n, {pick} FROM b WHERE NOT base_failed GROUP BY ALL),
l AS (SELECT l0.lang, {", ".join(f"(l0.{c} * l0.n + {SHRINK} * w.{c}) / (l0.n + {SHRINK}) AS l_{c}" for c in names)} FROM l0, w),
q AS (SELECT lang, source, count(*) AS n, {pick} FROM b WHERE NOT base_failed GROUP BY ALL),
d AS (SELECT q.lang, q.source, {", ".join(f"{drawn(c)} AS {c}" for c in names)} FROM q JOIN l ON q.lang IS NOT DISTINCT FROM l.lang),
c AS (SELECT lang, source, {fence} FROM d)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_lines, b.n_dup_lines, b.n_repeat_words, b.base_failed, NOT b.base_failed AND coalesce({inside}, false) AS kept
FROM b LEFT JOIN c ON b.lang IS NOT DISTINCT FROM c.lang AND b.source IS NOT DISTINCT FROM c.source
"""


SQL = _sql()
