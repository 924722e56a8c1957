"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The benchmark's word n-grams are counted over all documents. An item's seeds are the rarer half of its
n-grams, and all others that are not much more frequent than its middle one: measured against the item
itself, so that one which is common in the corpus keeps its seeds, and so do the parts that edited
copies leave as they were. Where a seed stands in a document, the words around it are aligned with the item;
edited and paraphrased copies still align over most of their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_slices, written

_WORD = re.compile(r"\w+")
Gram = tuple[str, ...]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(words: list[str], n: int) -> list[Gram]:
    """The n-grams of an item; one of fewer words is a single gram of all of them."""
    if len(words) < n:
        return [tuple(words)] if words else []
    return list(zip(*(words[k:] for k in range(n)), strict=False))


def align(item: np.ndarray, window: np.ndarray, match: int = 1, mismatch: int = 1, gap: int = 1) -> tuple[int, int, int]:
    """Smith-Waterman local alignment: best score, first and last word of the window in it.

    Row by row over the item. Within a row, a gap run that starts at k costs gap * (j - k), so the best
    one at each j is a running maximum. The start is the end of the same search on the reversed parts.
    """

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        slope = gap * np.arange(len(b) + 1)
        row, found = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
        for i, word in enumerate(a):
            up = row - gap
            up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == word, match, -mismatch))
            row = np.maximum(np.maximum.accumulate(np.maximum(up, 0) + slope) - slope, 0)
            j = int(row.argmax())
            if row[j] > found[0]:
                found = int(row[j]), i, j - 1
        return found

    score, i, end = best(item, window)
    if not score:
        return 0, 0, -1
    _, _, back = best(item[i::-1], window[end::-1])
    return score, end - back, end


class Matcher:
    """Finds the items in whole texts. seeds: gram -> [(item number, place of the gram in the item)]."""

    def __init__(self, items: list[list[str]], seeds: dict[Gram, list[tuple[int, int]]], least: float):
        self.items, self.seeds, self.least = items, seeds, least
        self.sizes = sorted({len(g) for g in seeds})
        self.codes: dict[str, int] = {w: k for k, w in enumerate(sorted({w for words in items for w in words}))}
        self.coded = [np.array([self.codes[w] for w in words], np.int64) for words in items]
        self.memory: dict[tuple[int, bytes], tuple[int, int, int]] = {}

    def find(self, text: str | None) -> list[tuple[int, float, int, int, int, int]]:
        """(item, score, first word, last word + 1, first character, end) of every passage at or over the threshold."""
        words, hits = words_of(text), {}
        for n in self.sizes:
            grams = words if n == 1 else zip(*(words[k:] for k in range(n)), strict=False)
            met = self.seeds.keys() & (set(zip(words)) if n == 1 else set(grams))
            if not met:
                continue
            for at in range(len(words) - n + 1):
                gram = tuple(words[at : at + n])
                if gram in met:
                    for item, place in self.seeds[gram]:
                        hits.setdefault(item, []).append(at - place)
        out, spans = [], None
        for item, starts in sorted(hits.items()):
            size = len(self.items[item])
            slack = size // 2 + 1
            windows: list[list[int]] = []
            for s in sorted(set(starts)):
                lo, hi = max(0, s - slack), min(len(words), s + size + slack)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], hi)
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                for score, first, last in self._passages(item, words, lo, hi):
                    spans = spans or [m.span() for m in _WORD.finditer((text or "").lower())]
                    out.append((item, score, first, last + 1, spans[first][0], spans[last][1]))
        return out

    def _passages(self, item: int, words: list[str], lo: int, hi: int) -> Iterator[tuple[float, int, int]]:
        """The best passage of words lo..hi-1, and those left and right of it."""
        codes, own = self.codes, self.coded[item]
        todo = [(lo, np.array([codes.get(w, -1) for w in words[lo:hi]], np.int64))]
        while todo:
            at, window = todo.pop()
            if np.isin(window, own).sum() < self.least * len(own):
                continue
            key = item, window.tobytes()
            if key not in self.memory:
                if len(self.memory) > 5_000:
                    self.memory.clear()
                self.memory[key] = align(own, window)
            score, first, last = self.memory[key]
            if score >= self.least * len(own):
                yield score / len(own), at + first, at + last
                todo += [(at, window[:first]), (at + last + 1, window[last + 1 :])]


def _gram_counts(docs: DataFrame, grams: list[Gram]) -> dict[int, int]:
    """How many documents hold each gram: one row a gram and task before the sum, one a gram after it."""
    number = {g: k for k, g in enumerate(grams)}
    sizes = sorted({len(g) for g in grams})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), np.int64)
        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                for n in sizes:
                    for gram in number.keys() & set(zip(*(words[k:] for k in range(n)), strict=False)):
                        total[number[gram]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: r["n"] for r in rows}


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, seed_share: float = 0.5, rare: float = 4.0, least: float = 0.36, items_a_pass: int = 20_000, words_a_pass: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word, start_char, end_char: passages of ``docs`` (doc_id, text)
    that copy an item of ``benchmark`` (item_id, text), exactly or edited.

    score is the alignment's score (a match 1, a mismatch or gap -1) over the item's words; passages from
    ``least`` up are returned, all of them: an item with three words in ten replaced scores about 0.4, one
    of which half is copied 0.5, and unrelated texts stay under 0.2. Words are compared in lower case without punctuation. Null and
    empty texts, and items without words, match nothing; repeated items and documents are reported each.
    Items shorter than n words are one seed. The benchmark is worked off in passes of at most items_a_pass
    items and, but for a single longer item, words_a_pass words, which bounds what the driver and every worker hold,
    whatever its size; an empty one gives no rows.
    """
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", benchmark.schema["item_id"].dataType), *(T.StructField(c, t) for c, t in [("score", T.DoubleType()), *((c, T.IntegerType()) for c in ("start_word", "end_word", "start_char", "end_char"))])])
    out, items, names, size = spark.createDataFrame([], schema), [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if items and (len(items) == items_a_pass or size + len(words) > words_a_pass):
            out, items, names, size = out.unionByName(_pass(docs, items, names, schema, n, seed_share, rare, least)), [], [], 0
        if words:
            items.append(words)
            names.append(row["item_id"])
            size += len(words)
    return out.unionByName(_pass(docs, items, names, schema, n, seed_share, rare, least)) if items else out


def _pass(docs: DataFrame, items: list[list[str]], names: list, schema: T.StructType, n: int, seed_share: float, rare: float, least: float) -> DataFrame:
    grams = sorted({g for words in items for g in grams_of(words, n)})
    counts, number = _gram_counts(docs, grams), {g: k for k, g in enumerate(grams)}
    seeds: dict[Gram, list[tuple[int, int]]] = {}
    for item, words in enumerate(items):
        placed = sorted((counts.get(number[g], 0), place, g) for place, g in enumerate(grams_of(words, n)))
        usual = placed[len(placed) // 2][0]
        for rank, (held, place, gram) in enumerate(placed):
            if rank < len(placed) * seed_share or held <= rare * usual + 8:
                seeds.setdefault(gram, []).append((item, place))
    shared = docs.sparkSession.sparkContext.broadcast((items, seeds))  # bounded by words_a_pass
    item_type = pa.array(names).type

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value, least)
        for batch in in_slices(batches):
            rows = [(k, *hit) for k, text in enumerate(batch.column(1).to_pylist()) for hit in matcher.find(text)]
            k, item, *rest = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(k, pa.int64())), pa.array([names[i] for i in item], item_type), pa.array(rest[0], pa.float64()),
                    *(pa.array(x, pa.int32()) for x in rest[1:]),
                ],
                names=schema.fieldNames(),
            )

    return docs.select("doc_id", "text").mapInArrow(find, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose text copies no benchmark item; rows with a null doc_id are judged by text too."""
    key = lambda: F.md5(F.coalesce(docs["text"], F.lit("")))
    bad = written(contaminated(docs.select(key().alias("doc_id"), "text"), benchmark, **settings).select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return docs.join(bad, key() == bad["__key"], "left_anti")
