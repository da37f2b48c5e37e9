"""Token ids in Arrow IPC files of fixed-size lists.

A shard is an Arrow stream-file (IPC file) whose record batches hold two fixed-size-list columns:
`ids` (sequences of equal length, 16-bit where the vocabulary allows it) and `mask` (true where a
position holds a token). Uncompressed fixed-size lists can be memory-mapped and sliced without a copy.
Beside each shard lies an index file with a row for each document: its id, its first position and its
length. Shards follow each other in ascending doc_id order, documents lie back to back within a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, hold, id_and_text, pieces, raw_bytes
from .pretokens import Memory, library_tokenizer

#: Tokens in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 1024, 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


# Hadoop's names of stores that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _store(uri: str):
    """Arrow's file system and path of a URI; Hadoop's schemes for S3 and Azure are mapped, others that Arrow lacks raise."""
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except pa.ArrowInvalid as e:
        raise ValueError(f"token files can't be kept under {uri}: Arrow has no file system {scheme}") from e


class _ShardWriter:
    """Streams tokens into a shard under a temporary name; `close` puts both files in place."""

    def __init__(self, uri: str, shard: int, attempt: int, kind: pa.DataType, sequence: int):
        self.fs, self.top = _store(uri)
        self.fs.create_dir(self.top, recursive=True)
        self.names = [(f"{self.top}/.{shard:06d}-{attempt}.{x}", f"{self.top}/shard-{shard:06d}.{x}") for x in ("arrow", "index.arrow")]
        self.kind, self.sequence = kind, sequence
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.files = [self.fs.open_output_stream(tmp) for tmp, _ in self.names]
        self.tokens = pa.ipc.new_file(self.files[0], self.schema)
        self.index = pa.ipc.new_file(self.files[1], INDEX)
        self.rest, self.start = bytearray(), 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of some documents, one after the other, and each one's number of them."""
        width = self.kind.bit_width // 8
        starts = self.start + np.cumsum(lengths) - lengths
        self.start += int(lengths.sum())
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], schema=INDEX))
        step = BATCH * self.sequence
        for at in range(0, len(ids), step):
            self.rest += ids[at : at + step].tobytes()
            if len(self.rest) >= step * width:
                self._flush(len(self.rest) // width // self.sequence)

    def _flush(self, rows: int, filled: int | None = None) -> None:
        size = rows * self.sequence * (self.kind.bit_width // 8)
        filled = rows * self.sequence if filled is None else filled
        ids = pa.Array.from_buffers(self.kind, rows * self.sequence, [None, pa.py_buffer(bytes(self.rest[:size]))])
        mask = pa.array(np.arange(rows * self.sequence) < filled)
        self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(ids, self.sequence), pa.FixedSizeListArray.from_arrays(mask, self.sequence)], schema=self.schema))
        del self.rest[:size]

    def close(self) -> None:
        width = self.kind.bit_width // 8
        if self.rest:
            held = len(self.rest) // width
            rows = -(-held // self.sequence)
            self.rest += bytes(rows * self.sequence * width - len(self.rest))
            self._flush(rows, held)
        for writer, file, (tmp, name) in zip((self.tokens, self.index), self.files, self.names, strict=True):
            writer.close()
            file.close()
            self.fs.move(tmp, name)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, uri: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int]]:
    """Encode docs and write them to shards under uri; gives (shard, tokens) of each shard, in order.

    Null texts are empty: they hold the end id alone. Null ids come first; equal ids are ordered by their
    texts and kept each; extra columns are not read; an empty table writes no shard. A task that runs
    again writes the same shard under a name of its own and puts it in place at the end."""
    kind = pa.uint16() if max(end_id, library_tokenizer(tokenizer_path).get_vocab_size() - 1) < 1 << 16 else pa.uint32()
    dtype = np.dtype("<u2" if kind == pa.uint16() else "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out = TaskContext.get(), None
        memory = hold(f"ids {tokenizer_path}", "memory", lambda: Memory(tokenizer_path, True, dtype))
        for part in pieces(batches, 512):
            ids, lengths = memory.encode(raw_bytes(part.column(1)), end_id)
            out = out or _ShardWriter(uri, context.partitionId(), context.taskAttemptId(), kind, sequence)
            out.add(part.column(0), ids, lengths)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([out.start], pa.int64())], names=["shard", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text").select("doc_id", "text")
    return sorted((r.shard, r.n_tokens) for r in ordered.mapInArrow(write, "shard int, n_tokens long").collect())


def shard_sequences(uri: str, shard: int) -> pa.Table:
    """A shard's sequences and masks; memory-mapped, so without a copy, where the store is a local path."""
    fs, top = _store(uri)
    name = f"{top}/shard-{shard:06d}.arrow"
    file = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
    return pa.ipc.open_file(file).read_all()


def read_token_files(spark: SparkSession, uri: str, shards: list[tuple[int, int]]) -> DataFrame:
    """The documents of the shards: doc_id, start (over all shards), n_tokens, ids_crc32 (of 32-bit little-endian ids).

    A task reads one shard. The list of shards is as long as the job that wrote them had tasks."""
    base, before = {}, 0
    for shard, n in shards:
        base[shard], before = before, before + n
    order = [shard for shard, _ in shards]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                shard = order[at]
                fs, top = _store(uri)
                index = pa.ipc.open_file(fs.open_input_file(f"{top}/shard-{shard:06d}.index.arrow"))
                sequences = shard_sequences(uri, shard).column("ids")
                parts = [c.flatten().to_numpy() for c in sequences.chunks]
                firsts = np.cumsum([0, *map(len, parts)])
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    crcs = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                        crc, end = 0, start + n
                        i = int(np.searchsorted(firsts, start, "right")) - 1
                        while start < end:
                            piece = parts[i][start - firsts[i] : end - firsts[i]]
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            start, i = start + len(piece), i + 1
                        crcs.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + base[shard], pa.int64())
                    yield pa.RecordBatch.from_arrays([docs.column(0), starts, docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(order), 1, max(1, len(order))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write docs to files in the shared folder and return what the files say of each document."""
    spark = docs.sparkSession
    uri = fresh_path(spark, "token-files")
    return read_token_files(spark, uri, write_token_files(docs, tokenizer_path, end_id, uri))
