"""Line dedup by overlapping windows of three consecutive lines.

Lines are compared by their words, parted by single spaces; a line of more than WRAP words counts as several, as if
it were wrapped, so that long passages of one or two lines make windows too. Blank lines are skipped over. Every
window of three is hashed to 128 bits. Windows that occur more than once anywhere keep their first occurrence, by
document id and place; later occurrences cover their lines, overlapping windows together, and a line whose wrapped
lines are all covered is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, id_and_text, pieces, raw_bytes

#: Words of a wrapped line, and lines of a window.
WRAP, WIDTH = 20, 3


def wrapped(text: bytes) -> list[bytes]:
    """The text's lines by their words, longer ones wrapped, without blank ones."""
    out = []
    for line in text.split(b"\n"):
        words = line.split()
        out += [b" ".join(words[i : i + WRAP]) for i in range(0, len(words), WRAP)]
    return out


def windows(text: bytes) -> list[bytes]:
    """Hashes of the windows that begin at each wrapped line but the last two."""
    lines = wrapped(text)
    return [blake2b(b"\n".join(lines[i : i + WIDTH]), digest_size=16).digest() for i in range(len(lines) - WIDTH + 1)]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("lines")
    for batch in pieces(batches):
        found = [windows(t) for t in raw_bytes(batch.column(1))]
        sizes = np.array([len(x) for x in found])
        h = np.frombuffer(b"".join(x for w in found for x in w), "<i8").reshape(-1, 2)
        rows = pa.array(np.repeat(np.arange(len(found)), sizes))
        places = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(places.astype(np.int32))], names=["h1", "h2", "doc_id", "tie", "first"]
        )


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (hash of the text), places: the wrapped lines that later occurrences of repeated windows cover, counted from 0."""
    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    found = rows.mapInArrow(_emit, "h1 long, h2 long, doc_id long, tie long, first int")
    kept = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tie", "first")).alias("kept")).where("n > 1").select("h1", "h2", "kept")
    # The extra key deals the repeated windows out anew, so that Spark may split a window that very many documents hold.
    key = F.col("h1").bitwiseXOR(F.col("h2"))
    later = found.withColumn("k", key).join(kept.withColumn("k", key), ["k", "h1", "h2"]).where(~F.struct("doc_id", "tie", "first").eqNullSafe(F.col("kept")))
    return later.select("doc_id", "tie", F.explode(F.sequence("first", F.col("first") + WIDTH - 1)).alias("place")).groupBy("doc_id", "tie").agg(F.collect_set("place").alias("places"))


def _rest(text: Column, places: Column) -> Column:
    """struct(at, lines, removed): the lines that stay. A line takes as many places as it has wrapped lines."""
    blanks = "     "
    size = lambda line: F.ceil(F.size(F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", blanks), " ", -1), "")) / WRAP).cast("int")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), size(x).alias("n")))

    def step(a: Column, x: Column) -> Column:
        gone = (x["n"] > 0) & F.forall(F.sequence(a["at"], a["at"] + F.greatest(x["n"] - 1, F.lit(0))), lambda p: F.array_contains(places, p))
        return F.struct((a["at"] + x["n"]).alias("at"), F.when(gone, a["lines"]).otherwise(F.concat(a["lines"], F.array(x["line"]))).alias("lines"), (a["removed"] + gone.cast("int")).alias("removed"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("lines"), F.lit(0).alias("removed")), step)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of the text column, and long columns n_lines and n_removed.

    One row for each row of docs, all columns kept (n_lines and n_removed replace columns of these names).
    Null texts stay null with 0 lines; an empty text has one line. Rows of equal id and text are one
    document and get one result; documents of equal id are ordered by the hash of their texts. A null id
    comes first; ids that aren't whole numbers raise. Blank lines stay; very long texts are hashed by themselves."""
    gone = covered(docs, id_col, text_col).select(F.col("doc_id").alias("_cl_id"), F.col("tie").alias("_cl_tie"), F.col("places").alias("_cl_places"))
    text = F.col(f"`{text_col}`")
    base = docs.drop("n_lines", "n_removed").withColumn("_cl_key", F.col(f"`{id_col}`").cast("long")).withColumn("_cl_own", F.xxhash64(text.cast("string")))
    both = base.join(gone, base["_cl_key"].eqNullSafe(gone["_cl_id"]) & (base["_cl_own"] == gone["_cl_tie"]), "left")
    both = both.withColumn("_cl_rest", F.when(F.col("_cl_places").isNotNull(), _rest(text, F.col("_cl_places"))))
    return both.withColumns({
        "n_lines": F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.coalesce(F.col("_cl_rest.removed"), F.lit(0)).cast("long"),
        text_col: F.when(F.col("_cl_rest.removed") > 0, F.array_join(F.col("_cl_rest.lines"), "\n")).otherwise(text),
    }).drop("_cl_key", "_cl_own", "_cl_id", "_cl_tie", "_cl_places", "_cl_rest")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs after line_dedup, without the rows that it left no word; the columns of docs, with n_chars (if it's one) counted anew."""
    done = line_dedup(docs, id_col, text_col).where(~((F.col("n_removed") > 0) & ~F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(F.col(f"`{text_col}`"))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM raw),
c AS (SELECT doc_id, pos, k, array_to_string(words[k * {WRAP} + 1 : k * {WRAP} + {WRAP}], ' ') AS part FROM (SELECT *, unnest(range(0, CAST(ceil(len(words) / {WRAP}) AS BIGINT))) AS k FROM l WHERE len(words) > 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS place FROM c),
w AS (SELECT doc_id, place, part || chr(10) || lead(part, 1) OVER o || chr(10) || lead(part, 2) OVER o AS t FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, place) AS i FROM w WHERE t IS NOT NULL),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(place, place + 2)) AS place FROM r WHERE i > 1),
gone AS (SELECT n.doc_id, n.pos FROM n LEFT JOIN hit ON n.doc_id = hit.doc_id AND n.place = hit.place GROUP BY n.doc_id, n.pos HAVING count(*) = count(hit.doc_id)),
kept AS (SELECT raw.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, coalesce(string_agg(raw.line, chr(10) ORDER BY raw.pos) FILTER (WHERE gone.pos IS NULL), '') AS text
         FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.pos = gone.pos GROUP BY raw.doc_id)
SELECT doc_id, kept.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN kept USING (doc_id)
"""
