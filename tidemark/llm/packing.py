"""Best-fit packing of documents into fixed-length training sequences, by large-item matching.

Lengths are small integers, so the plan is made over the histogram of lengths, which has at most
``capacity`` entries however many documents there are. The plan says, for runs of equally long pieces,
which sequences and offsets they get; the pieces then look up their place by their rank among those
of the same length. Ranks come from counts per written file, so no length's pieces are ever gathered.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written
from tidemark.llm.tokens import word_tokenizer


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (number of alike sequences, [(length, how many of it in each)]) that hold all pieces.

    Pieces above a third of the capacity stand at most twice in a sequence: from the longest down, each
    is matched with the longest other one that still fits. The shorter pieces, from the longest down,
    go where the gap is smallest that takes them; a new sequence opens only when no gap does.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    groups: list[tuple[int, int, list[tuple[int, int]]]] = []  # gap, number, contents
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            groups.append((capacity - a, left.pop(a), [(a, 1)]))
            large.pop()
            continue
        b = large[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if not n:  # one of an own kind is left over: its partner is the next shorter one
            if at:
                b, n = large[at - 1], 1
            else:
                groups.append((capacity - a, left.pop(a), [(a, 1)]))
                large.pop()
                continue
        groups.append((capacity - a - b, n, [(a, 2)] if a == b else [(a, 1), (b, 1)]))
        left[a] -= n
        left[b] -= n
        for x in {a, b}:
            if not left[x]:
                del left[x]
                large.remove(x)
    gaps: list[int] = []
    waiting: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)

    def put(gap: int, n: int, held: list[tuple[int, int]]) -> None:
        if n:
            if not waiting[gap]:
                insort(gaps, gap)
            waiting[gap].append((n, held))

    for gap, n, held in groups:
        put(gap, n, held)
    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                n, held = waiting[gap].pop()
                if not waiting[gap]:
                    gaps.pop(at)
            else:
                gap, n, held = capacity, -(-todo // (capacity // length)), []
            each = gap // length
            full = min(n, todo // each)
            put(gap - each * length, full, [*held, (length, each)])
            todo -= full * each
            n -= full
            if n and todo:
                put(gap - todo * length, 1, [*held, (length, todo)])
                todo, n = 0, n - 1
            if held:
                put(gap, n, held)
    return [(n, held) for gap in sorted(waiting) for n, held in waiting[gap]]


def plan_runs(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) sorted by length and rank: a run of pieces of one
    length, by rank, goes to consecutive sequences at one offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for n, held in groups:
        offset = 0
        for length, each in held:
            for _ in range(each):
                rows.append((length, taken[length], base, offset))
                taken[length] += n
                offset += length
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, white_space_splits: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids of whole texts: each document's ids and ``end_id``, cut only where
    they exceed the capacity; part and local_rank count the pieces of a length within a task's output."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = word_tokenizer(tokenizer, white_space_splits), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows: list[list] = [[] for _ in range(6)]
                texts = [x or "" for x in batch.column(1).slice(at, 256).to_pylist()]
                for k, ids in enumerate(words.ids(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        n = min(capacity, len(ids) - start)
                        for column, value in zip(rows, (k, piece, start, n, ids[start : start + n].tobytes(), seen[n]), strict=True):
                            column.append(value)
                        seen[n] += 1
                k, piece, start, n, ids, rank = rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 256).take(pa.array(k, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(n), pa.int32()), pa.array(rank, pa.int64()),
                    ],
                    names=out.fieldNames(),
                )

    out = T.StructType([T.StructField(n, t) for n, t in [("doc_id", docs.schema["doc_id"].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("part", T.IntegerType()), ("local_rank", T.LongType())]])
    return docs.select("doc_id", "text").mapInArrow(cut, out)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; rows that share a doc_id are packed each for itself; other
    columns are not read; an empty table gives no rows. ``packed_sequences`` has the ids in place.
    """
    return _placed(written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` must be a written table: part and local_rank are those of its files."""
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length: at most `capacity`
    runs = plan_runs(pack_histogram(histogram, capacity))
    edges = np.searchsorted(runs[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(n)).to_numpy() for n in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                at[own] = edges[n] + np.searchsorted(runs[edges[n] : edges[n + 1], 1], rank[own], side="right") - 1
            columns = [batch.column(batch.schema.names.index(n)) for n in out.fieldNames()[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])], names=out.fieldNames())

    out = T.StructType([T.StructField("doc_id", pieces.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())])])
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "local_rank")
    # never broadcast: the counts grow with the number of files
    ranked = narrow.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, out)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian unsigned 32-bit) of every packed sequence."""
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    # the same text under the same doc_id has the same ids, so any of its rows may fill any of its places
    order = Window.partitionBy("doc_id", "piece", "start", "length", "ids_crc32").orderBy("tie")
    places = _placed(pieces, capacity).withColumn("tie", F.struct("sequence_id", "offset")).withColumn("nth", F.row_number().over(order)).drop("tie")
    bodies = pieces.withColumn("ids_crc32", F.crc32("ids")).withColumn("tie", F.struct("part", "local_rank")).withColumn("nth", F.row_number().over(order)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids",
    )
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "nth")]
    joined = places.alias("p").join(bodies.alias("b"), same).select("p.sequence_id", "p.offset", "b.ids", "p.length")
    return joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held")).select(
        "sequence_id", "n_tokens", F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
