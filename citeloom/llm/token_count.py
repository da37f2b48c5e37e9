"""Token counts by a map-side two-tier lookup.

A first pass counts the corpus's pre-tokens in each map task; every task hands on a summary of bounded size,
the summaries are added up, and the most frequent pre-tokens of the whole corpus become tier one: a broadcast
table of 64-bit hashes and token counts, two numpy arrays. Tier two is a bounded memory in each Python worker
that encodes a miss with the library once. Pre-tokens themselves are never shuffled, texts neither.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, id_and_text, pieces, raw_bytes
from .pretokens import WHOLE, Encoder, Grown, Memory, Places

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_pretokens long, n_frequent long"
#: Pre-tokens in tier one; entries of a task's summary; different pre-tokens at which a counting task drops the rarest.
FREQUENT, SUMMARY, HELD = 65_536, 16_384, 400_000
#: Texts whose pre-tokens are looked up together.
GROUP = 512


class _Summary:
    """Counts of a task's pre-tokens in bounded memory: beyond HELD different ones only the more frequent half stays."""

    def __init__(self):
        self._make([], np.empty(0, np.uint64), np.empty(0, np.int64))

    def _make(self, names: list[tuple[bytes, bool]], keys: np.ndarray, counts: np.ndarray) -> None:
        self.places, self.names, self.keys, self.counts = Places(), names, Grown(np.uint64), Grown(np.int64)
        self.places.add(keys)
        self.keys.extend(keys)
        self.counts.extend(counts)

    def add(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, keys: np.ndarray) -> None:
        found, first, counts = np.unique(keys, return_index=True, return_counts=True)
        at = self.places.find(found)
        self.counts.held[at[at >= 0]] += counts[at >= 0]
        new = at < 0
        first = first[new]
        self.names += [(buffer[i:j], k) for i, j, k in zip(starts[first].tolist(), ends[first].tolist(), (kinds[first] == WHOLE).tolist(), strict=True)]
        self.places.add(found[new])
        self.keys.extend(found[new])
        self.counts.extend(counts[new])
        if len(self.names) > HELD:
            self._make(*self.top(HELD // 2))

    def top(self, n: int) -> tuple[list[tuple[bytes, bool]], np.ndarray, np.ndarray]:
        order = np.argsort(-self.counts[:], kind="stable")[:n]
        return [self.names[i] for i in order], self.keys[order], self.counts[order]


def frequent_pretokens(docs: DataFrame, tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, numbers of tokens) of the most frequent pre-tokens, FREQUENT at most; they only decide what is looked up where."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, summary = Memory(tokenizer_path, False), _Summary()
        for part in pieces(batches, GROUP):
            for _, buffer, *piece in memory.pieces(raw_bytes(part.column(1))):
                summary.add(buffer, *piece)
        names, keys, counts = summary.top(SUMMARY)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([n for n, _ in names], pa.binary()), pa.array([w for _, w in names], pa.bool_()), pa.array(counts)], names=["key", "piece", "whole", "c"])

    rows = docs.mapInArrow(summarise, "key long, piece binary, whole boolean, c long").groupBy("key").agg(F.min("piece").alias("piece"), F.min("whole").alias("whole"), F.sum("c").alias("c"))
    top = rows.orderBy(F.desc("c"), "key").limit(FREQUENT).select("key", "piece", "whole").toArrow()
    _, lengths = Encoder(tokenizer_path).encode(top.column("piece").to_pylist(), ~np.array(top.column("whole").to_pylist(), bool))
    return top.column("key").to_numpy().view(np.uint64), lengths.astype(np.uint16 if lengths.max(initial=0) < 1 << 16 else np.int64)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_pretokens, n_frequent (those found in tier one).

    Null and empty texts count 0 tokens; null ids stay null; ids that aren't whole numbers raise; repeated rows are
    counted each; pre-tokens of one count go into tier one by their hash; very long texts are cut at white space and
    counted whole; other columns of docs, of whatever name, are neither read nor returned; an empty table gives no
    rows. The tokenizer must be one that drops white space."""
    rows = id_and_text(docs, id_col, text_col)
    frequent, key = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(rows, tokenizer_path)), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = hold(f"counts {key}", "memory", lambda: Memory(tokenizer_path, False, frequent=frequent.value))
        for part in pieces(batches, GROUP):
            texts = raw_bytes(part.column(1))
            n, all_pieces, known = memory.count(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit), pa.array(all_pieces), pa.array(known)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_pretokens", "n_frequent"],
            )

    return rows.mapInArrow(count, SCHEMA)
