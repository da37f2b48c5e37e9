"""What the training-data operators share: table access, shared storage, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 class of the characters that part words: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all of them; larger scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in local mode, where all is one machine, is one made and set if the session names none; elsewhere that raises."""
    known = spark.conf.get("spark.checkpoint.dir", "")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='citeloom-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/citeloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut, no executor's loss undoes it."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialized frame that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/citeloom/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


@functools.cache
def one_blas_thread() -> None:
    """numpy's matrix products on one thread: a worker has one core, and further threads would only wait for it, at full load."""
    for lib in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if setter := getattr(ctypes.CDLL(str(lib)), name, None):
                setter(1)


#: What a Python worker keeps between tasks: the state of one operator at a time.
_held: dict = {"family": None}


def hold(family: str, key=None, make=None):
    """State that later tasks of this worker use again. Another family's state goes first, so that operators' caches don't add up."""
    one_blas_thread()
    if _held["family"] != family:
        _held.clear()
        _held["family"] = family
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)
    if make is None:
        return None
    if key not in _held:
        _held[key] = make()
    return _held[key]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and about so many bytes of text (a longer text alone), so that what a task makes of one stays small."""
    for whole in batches:
        lengths = np.zeros(whole.num_rows, np.int64)
        for column in whole.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(lengths), 0
        while at < whole.num_rows:
            before = upto[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))))
            yield whole.slice(at, end - at)
            at = end


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
