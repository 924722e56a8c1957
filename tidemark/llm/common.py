"""Helpers that the corpus operators share: written intermediate tables, folds and word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table; ``discard_written`` removes it."""
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again.

    This cuts the lineage: what stands in the table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_written(spark: SparkSession) -> None:
    """Remove every intermediate table of this process. Results that still read one must be done with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _discard_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        try:
            discard_written(spark)
        except Exception:  # noqa: BLE001  the session may be going; the folder is scratch space
            pass
    for path in _written:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)  # without a session: if it is a plain path


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def texts_as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that only so many texts stand in Python at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def ascii_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased; other letters stay."""
    return text.lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to ``limit`` words of a worker."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word, 42)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of two, in this order."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b) if np.isscalar(b) else (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))
