"""Benchmark decontamination: one Aho-Corasick automaton over the test items, one scan of each text.

Test items are normalised to words parted by single spaces and cut into windows of consecutive words.
The automaton holds every window as a sequence of words, so it matches at word borders only. Matches are
word positions, which are mapped to character offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, hold, materialize, pieces, raw_bytes

#: Bytes of words: ASCII letters and digits and everything beyond ASCII; letters in lower case, the rest a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORDS = re.compile(rb"[^ ]+")
#: Words of windows that one automaton takes, about 100 bytes of memory each; more are shared out over further passes, a stage each.
ONE_AUTOMATON = 3_000_000
STATE = "doc_id long, text string, spans array<struct<first:int,last:int>>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"

def windows(text: bytes, width: int) -> set[bytes]:
    """The windows of an item: every run of `width` words, or all its words if it has fewer."""
    words = text.translate(NORMAL).split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def automaton(items: list[tuple[str, bytes]], width: int):
    """(automaton, numbers of its words, its shortest window): windows are sequences of word numbers, so that a word is one step; a match tells its length and items."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text, width):
            owners.setdefault(w, set()).add(item)
    number: dict[bytes, int] = {}
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, who in owners.items():
        key = tuple(number.setdefault(x, len(number) + 1) for x in w.split(b" "))
        found.add_word(key, (len(key), sorted(who)))
    if len(found):
        found.make_automaton()
    return found, number, min((w.count(b" ") + 1 for w in owners), default=1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed intervals, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _scan(found, text: bytes) -> tuple[list[tuple[int, int]], set[str]]:
    machine, number, shortest = found
    words = text.translate(NORMAL).split()
    spans, items = [], set()
    if words and len(machine):
        ids = tuple(map(number.get, words, repeat(0)))  # 0 is no window's word
        # A match lies in a run of the windows' words; only runs of the shortest window's length or more go through the automaton.
        known = bytes(map(bool, ids))
        at = known.find(b"\x01" * shortest)
        while at >= 0:
            end = known.find(0, at)
            end = len(ids) if end < 0 else end
            for last, (n, who) in machine.iter(ids[at:end]):
                spans.append((at + last - n + 1, at + last))
                items.update(who)
            at = known.find(b"\x01" * shortest, end)
    return merged(spans), items


def _offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Character offsets [start, end) of word spans."""
    at = [m.span() for m in WORDS.finditer(text.translate(NORMAL))]
    out, seen, chars = [], 0, 0
    for first, last in spans:
        begin, end = at[first][0], at[last][1]
        chars += len(text[seen:begin].decode("utf-8", "replace"))
        n = len(text[begin:end].decode("utf-8", "replace"))
        out.append({"start": chars, "end": chars + n})
        seen, chars = end, chars + n
    return out


def _passes(benchmark: DataFrame, width: int) -> list[DataFrame]:
    """The items in as many parts as the words of their windows ask for; a part is what one pass broadcasts. A word is in `width` windows at most."""
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " "))
    size = (benchmark.where("text is not null").agg(F.sum(words)).first()[0] or 0) * width
    n = 1 + size // ONE_AUTOMATON
    part = F.pmod(F.xxhash64("text"), F.lit(n)) if n > 1 else F.lit(0)
    return [benchmark.where((part == k) & F.col("text").isNotNull()) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, spans (character offsets, merged), items (sorted ids).
    With whole_rows also `row`, a struct of all columns of docs.

    A span runs over the words of overlapping or touching windows. Null ids stay and ids that aren't whole numbers raise;
    null or empty texts have no words and no hits; very long texts are scanned by themselves; null or wordless items have no windows; a null item id
    reads as an empty string; repeated items and rows count as they come; other columns are not read."""
    items = benchmark.select(F.col(f"`{item_id_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    state = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(None).cast("array<struct<first:int,last:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * whole_rows)
    rest = [StructField("row", docs.schema)] * whole_rows

    def one_pass(shared, last: bool):
        key = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = hold(f"automaton {key}", "automaton", lambda: automaton(shared.value, width))
            for batch in pieces(batches):
                texts = raw_bytes(batch.column(1))
                spans = [[(x["first"], x["last"]) for x in s or []] for s in batch.column(2).to_pylist()]
                names = [x or [] for x in batch.column(3).to_pylist()]
                for i, text in enumerate(texts):
                    got, who = _scan(found, text)
                    if got:
                        spans[i], names[i] = merged(got + spans[i]), sorted(who | set(names[i]))
                yield (_result if last else _state)(batch, texts, spans, pa.array(names, pa.list_(pa.string())))

        return scan

    parts = _passes(items, width)
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        shared = sc.broadcast([(r.item_id if r.item_id is not None else "", r.text.encode()) for r in part.collect()])
        before, state = state, state.mapInArrow(one_pass(shared, last), StructType([*StructType.fromDDL(RESULT if last else STATE).fields, *rest]))
        if not last:  # a stage a pass: one automaton at a time in a worker
            state = materialize(state, "scanned")
            shared.unpersist()
            if k:
                discard(before)
    return state


def _state(batch: pa.RecordBatch, texts: list[bytes], spans: list, items: pa.Array) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    found = pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, items, *batch.columns[4:]], names=batch.schema.names)


def _result(batch: pa.RecordBatch, texts: list[bytes], spans: list, items: pa.Array) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    words = pa.array([len(t.translate(NORMAL).split()) for t in texts], pa.int64())
    hits = pa.array([sum(b - a + 1 for a, b in s) for s in spans], pa.int64())
    offsets = pa.array([_offsets(t, s) if s else [] for t, s in zip(texts, spans, strict=True)], kind)
    return pa.RecordBatch.from_arrays([batch.column(0), words, hits, offsets, items, *batch.columns[4:]], names=["doc_id", "n_words", "n_hit", "spans", "items", *batch.schema.names[4:]])


def contaminated(n_hit, n_words):
    """At least one hit word, and a twentieth of the words or more hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; all columns."""
    return contamination(docs, benchmark, whole_rows=True).where(~contaminated(F.col("n_hit"), F.col("n_words"))).select("row.*")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') AS win
       FROM (SELECT *, unnest(generate_series(1, greatest(1, len(words) - 12))) AS i FROM b WHERE len(words) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS win
       FROM (SELECT w.doc_id, w.words, l.n, unnest(generate_series(1, len(w.words) - l.n + 1)) AS i FROM w, (SELECT DISTINCT n FROM bw) l WHERE len(w.words) >= l.n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.words) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
