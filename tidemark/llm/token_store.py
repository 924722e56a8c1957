"""Token-id output as directly addressable codes, and its readers.

A store is a folder of Parquet files whose rows are segments. A segment holds the ids of some whole
documents, in ascending doc_id order, as the levels, bitmaps and rank directories of ``dac``. Segments
are numbered by (part, seq) in that same order. Spark writes and commits the files, so a lost executor
costs a repeated task only, and any file system that Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.dac import Levels
from tidemark.llm.tokens import word_tokenizer

_STREAMS = ("chunks", "bitmaps", "ranks")


def _segment_type(doc_id: T.DataType) -> T.StructType:
    fields = [
        ("part", T.IntegerType()), ("seq", T.IntegerType()), ("tokens", T.LongType()), ("chunk_bits", T.IntegerType()),
        ("doc_ids", T.ArrayType(doc_id)), ("lengths", T.ArrayType(T.LongType())),
    ]
    return T.StructType([T.StructField(n, t) for n, t in [*fields, *((s, T.ArrayType(T.BinaryType())) for s in _STREAMS)]])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, chunk_bits: int = 8, segment_tokens: int = 1 << 18, white_space_splits: bool = True) -> None:
    """Encode whole texts of ``docs`` (doc_id, text, ...) and write a store to the new folder ``path``.

    Each document's ids end with ``end_id``; null and empty texts are that id alone. Rows with the same
    doc_id stand side by side, by a hash of their text; a null doc_id comes first. Other columns are not read. An
    empty table gives an empty store. A segment ends with the first document that fills it, so its size
    is bounded by segment_tokens plus one document.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = word_tokenizer(tokenizer, white_space_splits), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def segment() -> pa.RecordBatch:
            levels = Levels.of(np.concatenate(held), chunk_bits)
            row = {"part": part, "seq": seq, "tokens": size, "chunk_bits": chunk_bits, "doc_ids": names, "lengths": [len(x) for x in held]}
            return pa.RecordBatch.from_pylist([row | {s: [x.tobytes() for x in getattr(levels, s)] for s in _STREAMS}], schema)

        for batch in batches:
            doc_ids = batch.column(0)
            schema = pa.schema(
                [
                    ("part", pa.int32()), ("seq", pa.int32()), ("tokens", pa.int64()), ("chunk_bits", pa.int32()),
                    ("doc_ids", pa.list_(doc_ids.type)), ("lengths", pa.list_(pa.int64())), *((s, pa.list_(pa.binary())) for s in _STREAMS),
                ]
            )
            for at in range(0, len(batch), 256):
                texts = [x or "" for x in batch.column(1).slice(at, 256).to_pylist()]
                for name, ids in zip(doc_ids.slice(at, 256).to_pylist(), words.ids(texts), strict=True):
                    held.append(np.append(ids, np.uint32(end_id)))
                    names.append(name)
                    size += len(held[-1])
                    if size >= segment_tokens:
                        yield segment()
                        held, names, size, seq = [], [], 0, seq + 1
        if held:
            yield segment()

    # no number given: small inputs come together in fewer partitions, which stay in order
    # the hash splits rows of one doc_id, or of none, over tasks if there are too many for one
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(encode, _segment_type(docs.schema["doc_id"].dataType)).write.option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The store's segments, each with ``start``: the number of ids in all segments before it.

    Only the small columns are summed: per part in parallel, then over one row a part.
    """
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    heads = rows.select("part", "seq", "tokens").withColumn(
        "before", F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens"),
    ).join(base, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("start"))
    return rows.join(heads, ["part", "seq"])


def _levels(batch: pa.RecordBatch, row: int) -> Levels:
    names = batch.schema.names
    return Levels.from_bytes(batch.column(names.index("chunk_bits"))[row].as_py(), *(batch.column(names.index(s))[row].as_py() for s in _STREAMS))


def read_documents(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (unless ``digest_only``) ids of every document of a store.

    ids are little-endian unsigned 32-bit integers in one binary value; ids_crc32 is their unsigned crc32.
    """
    stored = spark.read.parquet(path)
    doc_id = stored.schema["doc_ids"].dataType.elementType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for row in range(len(batch)):
                levels, lengths = _levels(batch, row), np.array(batch.column(names.index("lengths"))[row].as_py(), np.int64)
                starts = np.cumsum(lengths) - lengths
                ids = [levels.slice(a, a + n).astype("<u4").tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array([batch.column(names.index(k))[row].as_py()] * len(ids), pa.int32()) for k in ("part", "seq")]
                columns += [batch.column(names.index("doc_ids"))[row].values, pa.array(starts), pa.array(lengths), pa.array([crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * (not digest_only), names=out.fieldNames())

    out = T.StructType([T.StructField(n, t) for n, t in [("part", T.IntegerType()), ("seq", T.IntegerType()), ("doc_id", doc_id), ("within", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), *[("ids", T.BinaryType())] * (not digest_only)]])
    heads = segments(spark, path).select("part", "seq", "start")
    read = stored.mapInArrow(decode, out).join(heads, ["part", "seq"])
    return read.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * (not digest_only))


def token_at(spark: SparkSession, path: str, positions: DataFrame, stride: int = 1 << 18) -> DataFrame:
    """(pos, id) for each row of ``positions`` (pos: place of a token in the whole store, from 0).

    Positions meet the segments that cover their stretch of ``stride`` tokens; each id is then read by
    the rank directories alone. Positions outside the store, and null ones, give no row.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for row in range(len(batch)):
                levels = _levels(batch, row)
                at = batch.column(names.index("at"))[row].as_py()
                start = batch.column(names.index("start"))[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([levels[x - start] for x in at], pa.int64())], names=["pos", "id"])

    held = segments(spark, path).withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / stride), F.floor((F.col("start") + F.col("tokens") - 1) / stride))))
    wanted = positions.select(F.col("pos").cast("long")).where("pos >= 0").withColumn(
        "stretch", F.floor(F.col("pos") / stride),
    ).withColumn("lot", F.floor(F.rand(7) * 16))
    spans = held.select("part", "seq", "start", "tokens", "stretch")
    hits = wanted.join(spans, (wanted["stretch"] == spans["stretch"]) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("tokens")))
    lots = hits.groupBy("part", "seq", "start", "lot").agg(F.collect_list("pos").alias("at"))
    return lots.join(spark.read.parquet(path), ["part", "seq"]).mapInArrow(look, "pos long, id long")
