"""Byte-level BPE encoding and decoding by DuckDB queries in each partition.

A recursive query lays out a row for each token position of each word, joins neighbours to the merge table and
contracts every word's leftmost pair of minimum rank, until no word has a pair that merges. A word is a match of
the splitting pattern. Workers remember the words that they have met in arrays of bounded size (64-bit hash of
the word's bytes, place and number of its ids), so a word goes through the query once for as long as it is
remembered. Decoding joins ids to the vocabulary's bytes and puts them together by an ordered aggregation.

Texts are cut into words with numpy where the pattern's classes can be told by single bytes; stretches with
apostrophes or rarer characters go through the pattern itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import hold, pieces, raw_bytes
from .pretokens import CLASS, HARD, SPACE, Grown, Places, hashes

#: Words and ids that a worker remembers before it starts anew: about 50 MB.
REMEMBERED, IDS = 500_000, 4_000_000
#: Words that one query takes, and about how many list entries it may pile up before it hands over what it has.
TOGETHER, PILED_UP = 8_000, 1_000_000
#: Ids that one decoding query takes, if a text hasn't more.
DECODED = 150_000
#: Memory of a worker's DuckDB connection. It spills nowhere: queries are cut to fit.
DUCKDB_MEMORY = "250MB"
#: Texts, and bytes of them, encoded or decoded together.
ROWS, SIZE = 512, 1 << 20
# Fixed value: the pattern whose words the numpy cutter knows.
CUTTER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII's six; texts that hold some go through the pattern as a whole.
ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
BETWEEN = 5

_SPLIT = """
WITH RECURSIVE s AS (
  SELECT 0 AS step, w, toks FROM start
  UNION ALL
  (WITH place AS (SELECT w, unnest(range(1, len(toks))) AS pos, (unnest(toks[:-2])::BIGINT << 20) | unnest(toks[2:]) AS pair FROM s WHERE len(toks) > 1 AND step < $steps),
        best AS (SELECT w, min((rank::BIGINT << 32) | pos) AS key FROM place JOIN merges USING (pair) GROUP BY w)
   SELECT step + 1, w, toks[:(key & 4294967295) - 1] || [(key >> 32)::INT] || toks[(key & 4294967295) + 2:] FROM s JOIN best USING (w))
)
SELECT w, arg_max(toks, step) AS ids, max(step) AS last FROM s GROUP BY w
"""
_JOIN = "SELECT d, string_agg(hex, '' ORDER BY p) AS hex FROM ids JOIN vocabulary USING (tok) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def cut_words(texts: list[bytes], pattern) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(numbers of texts, all bytes, starts, ends) of the matches of a compiled pattern in all texts.

    A space run before a word parts in two: all but its last character, and that one, which a word takes on if it
    is a blank. A word begins wherever the class of characters changes. Between a word and white space behind it
    there is always a border, so stretches of white space and a word can be cut by themselves."""
    buffer = b"\x00".join(texts) + b"\x00"
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    a = np.frombuffer(buffer, np.uint8)
    kind = CLASS[a]
    kind[begins[1:] - 1] = BETWEEN
    known = pattern.pattern == CUTTER_PATTERN
    whole = np.array([not known or bool(ODD_SPACE.search(t)) for t in texts], bool)
    before = np.concatenate([[np.uint8(BETWEEN)], kind[:-1]])
    # A stretch is the white space before a word and the word: it begins where white space follows none, or a text begins.
    opens = (before == BETWEEN) | (kind == BETWEEN) | (kind == SPACE) & (before != SPACE)
    hard = HARD[a] & (kind != SPACE) & (kind != BETWEEN)
    hard[:-1] |= (a[:-1] == 0xC3) & ((a[1:] == 0x97) | (a[1:] == 0xB7))
    stretch = np.cumsum(opens) - 1
    starts = np.flatnonzero(opens)
    by_pattern = np.zeros(len(starts), bool)
    by_pattern[stretch[hard]] = True
    text_of = np.searchsorted(begins, starts, "right") - 1
    by_pattern &= ~whole[text_of]
    by_pattern &= kind[starts] != BETWEEN
    last_space = (kind == SPACE) & (np.append(kind[1:], np.uint8(BETWEEN)) != SPACE) & (np.append(kind[1:], np.uint8(BETWEEN)) != BETWEEN)
    blank_before = np.concatenate([[False], (last_space & (a == 32))[:-1]])
    border = (kind != before) & ~blank_before | last_space
    border &= ~(by_pattern | whole[text_of])[stretch] | (kind == BETWEEN)
    at = np.flatnonzero(border | opens)
    ends = np.append(at[1:], len(a))
    easy = (kind[at] != BETWEEN) & ~by_pattern[stretch[at]] & ~whole[text_of[stretch[at]]]
    firsts, lasts = [at[easy]], [ends[easy]]
    stops = np.append(starts[1:], len(a))
    slow = [(int(starts[k]), int(stops[k])) for k in np.flatnonzero(by_pattern)] + [(int(begins[k]), int(begins[k + 1]) - 1) for k in np.flatnonzero(whole)]
    for first, last in slow:
        sizes = np.array([len(w.encode()) for w in pattern.findall(buffer[first:last].decode("utf-8", "replace"))], np.int64)
        firsts.append(first + np.cumsum(sizes) - sizes)
        lasts.append(first + np.cumsum(sizes))
    firsts, lasts = np.concatenate(firsts), np.concatenate(lasts)
    if slow:
        order = np.argsort(firsts, kind="stable")
        firsts, lasts = firsts[order], lasts[order]
    return np.searchsorted(begins, firsts, "right") - 1, buffer, firsts, lasts


class _Engine:
    """A worker's DuckDB connection with the merge table and the vocabulary, and the words it has met."""

    def __init__(self, path: str):
        import duckdb

        ranks = read_ranks(path)
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({"pair": pa.array([left << 20 | right for left, right, _ in pairs], pa.int64()), "rank": pa.array([r for _, _, r in pairs], pa.int32())})
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db.register("m", merges)
        self.db.register("v", vocabulary)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.db.unregister("m")
        self.db.unregister("v")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._clear()

    def _clear(self) -> None:
        self.places, self.starts, self.lengths, self.ids = Places(), Grown(np.int64), Grown(np.int32), Grown(np.int32)

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. Runs of the recursion are cut so that the rows piled up stay bounded, and go on where they stopped."""
        done: list = [None] * len(words)
        keys = np.arange(len(words), dtype=np.int32)
        ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
        tokens = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        while len(keys):
            steps = max(16, PILED_UP // max(1, len(tokens)))
            self.db.register("start", pa.table({"w": keys, "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))}))
            found = self.db.sql(_SPLIT, params={"steps": steps}).to_arrow_table().combine_chunks()
            self.db.unregister("start")
            lists, w, last = found.column("ids").combine_chunks(), found.column("w").to_numpy(), found.column("last").to_numpy()
            flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            bounds = cuts.tolist()
            for k, word in enumerate(w.tolist()):
                done[word] = flat[bounds[k] : bounds[k + 1]]
            more = np.flatnonzero(last == steps)
            keys = w[more].astype(np.int32)
            ends = np.cumsum([0, *(cuts[more + 1] - cuts[more])]).astype(np.int32)
            tokens = np.concatenate([flat[cuts[k] : cuts[k + 1]] for k in more]) if len(more) else flat[:0]
        return done

    def learn(self, keys: np.ndarray, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the words with these hashes, after encoding those that weren't known."""
        if self.places.n > REMEMBERED or self.ids.n > IDS:
            self._clear()
        at = self.places.find(keys)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new, first = np.unique(keys[unknown], return_index=True)
            first = unknown[first]
            order = np.argsort(ends[first] - starts[first], kind="stable")  # words of like lengths take like numbers of steps
            first = first[order]
            size = np.cumsum(ends[first] - starts[first])
            k = 0
            while k < len(first):
                stop = min(k + TOGETHER, max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + PILED_UP // 16, "right"))))
                done = self.contract([buffer[i:j] for i, j in zip(starts[first[k:stop]].tolist(), ends[first[k:stop]].tolist(), strict=True)])
                lengths = np.fromiter(map(len, done), np.int64, len(done))
                self.starts.extend(self.ids.n + np.cumsum(lengths) - lengths)
                self.lengths.extend(lengths)
                self.ids.extend(np.concatenate(done))
                self.places.add(new[order[k:stop]])
                k = stop
            at[unknown] = self.places.find(keys[unknown])
        return at

    def encode(self, texts: list[bytes], pattern) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        owner, buffer, starts, ends = cut_words(texts, pattern)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        at = self.learn(hashes(np.frombuffer(buffer, np.uint8), starts, ends), buffer, starts, ends)
        lengths = self.lengths[at].astype(np.int64)
        upto = np.cumsum(lengths)
        return self.ids[np.arange(upto[-1]) + np.repeat(self.starts[at] - upto + lengths, lengths)], np.bincount(owner, lengths, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of rows of ids that lie one after the other."""
        out, cuts, k = [b""] * len(lengths), np.concatenate([[0], np.cumsum(lengths)]), 0
        while k < len(lengths):
            stop = max(k + 1, int(np.searchsorted(cuts, cuts[k] + DECODED, "right")) - 1)
            part = ids[cuts[k] : cuts[stop]]
            if len(part):
                rows = np.repeat(np.arange(k, stop, dtype=np.int32), lengths[k:stop])
                self.db.register("ids", pa.table({"d": rows, "p": np.arange(len(part), dtype=np.int32), "tok": part.astype(np.int32, copy=False)}))
                for d, hexed in self.db.execute(_JOIN).fetchall():
                    out[d] = bytes.fromhex(hexed)
                self.db.unregister("ids")
            k = stop
        return out


def _engine(path: str) -> _Engine:
    return hold(f"byte BPE {path}", "engine", lambda: _Engine(path))


def _lists(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded_col: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, the columns in `keep`, ids array<int>. Every match of the pattern is encoded by itself.

    With decoded_col also the bytes that the ids decode to, by the same worker. Null and empty texts have no ids;
    null ids stay; ids that aren't whole numbers raise; repeated rows are encoded each; very long texts are a group
    of their own; an empty table gives no rows; other columns are not read. A column of `keep` that would double a
    result column's name raises. There are no ties: the leftmost pair of least rank is one."""
    made = ["doc_id", "ids", *[decoded_col] * bool(decoded_col)]
    if clash := [c for c in (*keep, *made) if (*keep, *made).count(c) > 1]:
        raise ValueError(f"columns {sorted(set(clash))} would be in the result twice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        engine, pat = _engine(ranks_path), regex.compile(pattern)
        for batch in pieces(batches, ROWS, SIZE):
            ids, lengths = engine.encode(raw_bytes(batch.column(1)), pat)
            back = [pa.array(engine.decode(ids, lengths), pa.binary())] if decoded_col else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], _lists(ids, lengths), *back], names=["doc_id", *keep, "ids", *[decoded_col] * len(back)])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep])
    kept = [docs.schema[c] for c in keep]
    back = [StructField(decoded_col, BinaryType())] if decoded_col else []
    return rows.mapInArrow(run, StructType([StructField("doc_id", LongType()), *kept, StructField("ids", ArrayType(IntegerType())), *back]))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the ids' bytes in out_col (in place of a column of that name); null ids decode to no bytes."""
    kept = [f for f in encoded.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(ranks_path)
        for batch in pieces(batches, ROWS, SIZE):
            ids = batch.column(batch.schema.get_field_index(ids_col))
            rows = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32) for x in ids]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            back = pa.array(engine.decode(np.concatenate(rows) if rows else np.empty(0, np.int32), lengths), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, back], names=[*batch.schema.names, out_col])

    return encoded.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, StructType([*kept, StructField(out_col, BinaryType())]))


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    both = encode(docs, ranks_path, pattern, decoded_col="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
