"""Repeated passages by a sparse suffix array over the words of all documents.

Suffixes are kept only where the document's content picks them: at the places whose hash of ``gram`` words
is the least of ``window`` neighbouring ones (minimisers). Two copies of a passage pick the same places,
wherever they stand. A passage of ``least`` words has a kept suffix among its first ``window``
places, so at least ``reach = least - window + 1`` of its words follow that place.

1. Each kept suffix is known by a hash of its first ``reach`` words; suffixes whose hash stands alone
   in the corpus repeat nowhere and go.
2. Where two suffixes share that hash, they are sorted over all partitions by it and the words after it,
   so that they stand beside each other, and the match is extended word by word, right and left. Both
   together say whether the passage is long enough.
3. Where three or more share it, neighbours in one order do not show all matches: the best partner may be
   any of them. Each window of ``least`` words that holds the suffix's first ``reach`` is hashed, and windows
   counted twice or more are repeated. Suffixes with the same words all around have the same
   windows, which are made once.
4. Overlapping passages of a document are joined.

Documents with the same words throughout are one class: their suffixes are sorted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import WordHashes, ascii_words, mix, texts_as_bytes, written

_hashes = WordHashes()


def windowed_hash(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words (fewer words: none), by doubling."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    powers, out, at, n = words, None, 0, size
    step = 1
    while n:
        if n & 1:
            part = powers[at : at + len(words) - size + 1]
            out = part if out is None else mix(out, part)
            at += step
        n >>= 1
        if n:
            powers = mix(powers[:-step], powers[step:])
            step *= 2
    return out


def minimisers(words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Places, ascending, that hold the least gram hash of some ``window`` neighbouring places (leftmost of
    equals). A text with fewer places than a window gives its least one."""
    grams = windowed_hash(words, gram)
    if not len(grams):
        return np.zeros(0, np.int64)
    if len(grams) <= window:
        return np.array([int(grams.argmin())])
    # window minima from the minima of two overlapping power-of-two runs
    place, span = np.arange(len(grams)), 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] < grams[a], b, a)

    while 2 * span <= window:
        place = lesser(place[:-span], place[span:])
        span *= 2
    rest = window - span
    return np.unique(lesser(place[: len(place) - rest], place[rest:]) if rest else place)


def _keep_suffixes(doc_id: pa.DataType, least: int, gram: int, window: int):
    """doc_id, text_hash, row (a number of its own), cls (hash of all words), n_words, places and keys of the kept suffixes of texts
    that are long enough."""
    reach = least - window + 1
    schema = pa.schema(
        [
            ("doc_id", doc_id), ("text_hash", pa.int64()), ("row", pa.int64()), ("cls", pa.int64()), ("n_words", pa.int32()),
            ("places", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.slice(at, 512), []
                for k, text in enumerate(texts_as_bytes(part)):
                    split = ascii_words(text)
                    if len(split) < least:
                        continue
                    words = _hashes.of(split)
                    whole, places = windowed_hash(words, reach), minimisers(words, gram, window)
                    places = places[places < len(whole)]
                    number += 1
                    rows.append((k, number, class_of(split), len(split), places.astype(np.int32), whole[places].view(np.int64)))
                k, *columns = zip(*rows, strict=True) if rows else [()] * 6
                at_rows = pa.array(k, pa.int64())
                kept = [part.column(0).take(at_rows), part.column(2).take(at_rows)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(columns, schema.types[2:], strict=True))], schema=schema)

    return run


def class_of(words: list[bytes]) -> int:
    """A signed 64-bit hash of all words in order."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(b" ".join(words), 7)
    return value - (1 << 64) if value >> 63 else value


_SUFFIX = "cls long, place int, key long, before binary, after binary"


def _with_words(least: int, window: int):
    """The kept suffixes with the ``window - 1`` words before them (nearest first) and after their first ``reach``,
    as 32-bit hashes."""
    reach, side = least - window + 1, window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in range(5)]
                for text, cls, places, keys in zip(texts_as_bytes(part), *(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    split = ascii_words(text)
                    if class_of(split) != cls:  # another row with the same doc_id
                        continue
                    words = (_hashes.of(split) >> np.uint64(32)).astype(">u4")
                    for place, key in zip(places, keys, strict=True):
                        end = place + reach
                        for column, value in zip(rows, (cls, place, key, words[max(0, place - side) : place][::-1].tobytes(), words[end : end + side].tobytes()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                    names=[x.split()[0] for x in _SUFFIX.split(", ")],
                )

    return run


_CONTEXT = "cls long, place int, context long, least_left int, windows array<long>"


def windows_around(words: np.ndarray, places: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each place: a hash of the ``window - 1`` words before it to those after its first ``least - window + 1``, as
    far as the text goes; how many words before it the window of ``least`` words that starts last and the one
    that starts first hold; and, by words before it, the hashes of all windows between those two."""
    whole, left = windowed_hash(words, least), np.arange(window)
    first, last = np.maximum(places - window + 1, 0), np.minimum(places, len(whole) - 1)
    # the two outermost windows overlap, so that they hold all the words
    context = mix(mix(whole[first], whole[last]), ((places - first) * window + places - last).astype(np.uint64))
    # with the words before the place: two places of a document may hold the same window
    hashes = mix(whole[np.clip(places[:, None] - left, 0, len(whole) - 1)], left.astype(np.uint64)[None, :])
    return context, places - last, places - first, hashes


def _with_windows(least: int, window: int):
    """The kept suffixes with a hash of the words around them, and the hashes of the windows that hold them where a
    task meets those words for the first time."""
    schema = to_arrow_schema(T.StructType.fromDDL(_CONTEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in schema.types]
                for text, cls, places in zip(texts_as_bytes(part), *(part.column(k).to_pylist() for k in (2, 3)), strict=True):
                    split = ascii_words(text)
                    if class_of(split) != cls:  # another row with the same doc_id
                        continue
                    context, low, high, hashes = windows_around(_hashes.of(split), np.array(places, np.int64), least, window)
                    for c, place, lo, hi, own in zip(context.view(np.int64).tolist(), places, low.tolist(), high.tolist(), hashes.view(np.int64), strict=True):
                        for column, value in zip(rows, (cls, place, c, lo, None if c in met else own[lo : hi + 1]), strict=True):
                            column.append(value)
                        met.add(c)
                    if len(met) > 200_000:
                        met.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)

    return run


def _words_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of 4-byte words as a matrix of ``size`` columns, padded with zeros, and how many words each row has."""
    if not len(column):
        return np.zeros((0, size), np.uint32), np.zeros(0, np.int64)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lengths = np.diff(offsets) // 4
    matrix = np.zeros((len(column), size), np.uint32)
    data = column.buffers()[2]
    if data is not None:
        matrix[np.arange(size) < lengths[:, None]] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint32)
    return matrix, lengths


def _common(words: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """How many leading words each row shares with that ``k`` rows before it, from row ``k`` on."""
    same = (words[k:] == words[:-k]) & (np.arange(words.shape[1]) < np.minimum(lengths[k:], lengths[:-k])[:, None])
    return np.where(same.all(1), words.shape[1], same.argmin(1))


def longest_matches(rows: pa.Table, least: int, window: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """The most words to the left and to the right of each suffix that a long enough match with one of the
    ``back`` rows before or after it has; -1 where there is none.

    All matches of a suffix hold its place, so that together they are one span: nothing else is needed of them.
    """
    cls, place, key = (rows.column(k).to_numpy() for k in range(3))
    (before, n_before), (after, n_after) = (_words_of(rows.column(k).combine_chunks(), max(1, window - 1)) for k in (3, 4))
    left, right = np.full(len(cls), -1, np.int32), np.full(len(cls), -1, np.int32)
    for k in range(1, min(back, len(cls) - 1) + 1):
        most_left, most_right = _common(before, n_before, k), least - window + 1 + _common(after, n_after, k)
        alike = (key[k:] == key[:-k]) & ((cls[k:] != cls[:-k]) | (place[k:] != place[:-k])) & (most_left + most_right >= least)
        for part in (slice(k, None), slice(None, -k)):
            left[part] = np.maximum(left[part], np.where(alike, most_left, -1))
            right[part] = np.maximum(right[part], np.where(alike, most_right, -1))
    return left, right


_FOUND = "part int, side int, cls long, place int, left int, right int, key long, before binary, after binary"


def _compare(least: int, window: int, back: int = 3):
    """Compare each sorted suffix with the ``back`` before it. The partition's first and last, whose other neighbour is
    elsewhere, come along with side 0 and 1."""
    schema = to_arrow_schema(T.StructType.fromDDL(_FOUND))

    def end(row: pa.Table, part: int, side: int) -> pa.RecordBatch:
        cls, place, *words = (row.column(k).combine_chunks() for k in range(5))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (part, side)] + [cls, place] + [pa.array([0], pa.int32())] * 2 + words, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = TaskContext.get().partitionId(), None
        for batch in batches:
            if not len(batch):
                continue
            if kept is None:
                yield end(pa.Table.from_batches([batch.slice(0, 1)]), part, 0)
            rows = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
            left, right = longest_matches(rows, least, window, back)
            at = np.flatnonzero(right >= 0)
            found = [np.full(len(at), part, np.int32), np.full(len(at), -1, np.int32), rows.column(0).to_numpy()[at], rows.column(1).to_numpy()[at], left[at], right[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(found, schema.types[:6], strict=True)] + [pa.nulls(len(at), t) for t in schema.types[6:]],
                schema=schema,
            )
            kept = rows.slice(max(0, len(rows) - back))
        if kept is not None:
            yield end(kept.slice(len(kept) - 1), part, 1)

    return run


def repeated_passages(docs: DataFrame, least: int = 50, gram: int = 5, window: int = 20) -> DataFrame:
    """doc_id, start_word, end_word, n_words, n_copies: passages of ``least`` or more words of ``docs`` (doc_id,
    text) that stand elsewhere too, in another document or in the same one.

    Words are split at ASCII white space, A-Z in lower case; start_word counts from 0, end_word is the first
    after the passage. n_copies counts the rows whose words are all the same, this one included: with
    more than one, the whole text is the passage. Null, empty and shorter texts give no row, nor do
    rows without a doc_id; an empty table gives none; a doc_id that stands in several rows is reported
    for each. Nothing is dropped for being frequent: the windows of a common passage are counted in each task
    before the sum. Keys that two suffixes share are matched by the sorted neighbours; where three or more share one, the
    counted windows decide.
    """
    return _passages(docs, least, gram, window).drop("text_hash")


def _passages(docs: DataFrame, least: int, gram: int, window: int) -> DataFrame:
    """``repeated_passages`` with the text_hash of each row's text, which tells apart texts of one doc_id."""
    if least < window + gram:
        raise ValueError("least must be window + gram or more")
    doc_id = docs.schema["doc_id"].dataType
    # by doc_id and text hash, so that texts of one doc_id do not all meet each other below
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("doc_id is not null and text is not null")
    numbers = [("text_hash", T.LongType()), ("row", T.LongType()), ("cls", T.LongType()), ("n_words", T.IntegerType())]
    kept = T.StructType(
        [
            T.StructField("doc_id", doc_id), *(T.StructField(n, t) for n, t in numbers), T.StructField("places", T.ArrayType(T.IntegerType())),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )
    own_type = to_arrow_schema(T.StructType([docs.schema["doc_id"]])).field(0).type
    per_doc = written(texts.mapInArrow(_keep_suffixes(own_type, least, gram, window), kept), "kept-suffixes")
    # the smallest doc_id stands for a class, by one of its rows
    classes = written(per_doc.groupBy("cls").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"), F.count("*").alias("n_copies")), "word-classes")
    suffixes = per_doc.join(classes, ["cls", "row"], "left_semi").select(
        "cls", "doc_id", "text_hash", F.inline(F.arrays_zip("places", "keys")),
    ).toDF("cls", "doc_id", "text_hash", "place", "key")
    shared = written(suffixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    met = suffixes.join(shared, "key")
    # of three and more, a neighbour need not be the partner that completes the passage
    matches = _matches(texts, met.where("n = 2"), least, window).unionByName(_window_matches(texts, met.where("n > 2"), least, window))
    inside = _joined(matches)
    own = per_doc.select("doc_id", "text_hash", "cls", "n_words").join(classes.select("cls", "n_copies"), "cls")
    copies = own.where("n_copies > 1").select("doc_id", "text_hash", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), "n_copies")
    single = own.where("n_copies = 1").join(inside, "cls").select("doc_id", "text_hash", "start_word", "end_word", "n_copies")
    return copies.unionByName(single).select("doc_id", "text_hash", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "n_copies")


_TEXT = ["doc_id", "text_hash"]


def _wanted(suffixes: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_hash, cls, places and keys of ``suffixes`` (the same, by place and key)."""
    rows = suffixes.groupBy(*_TEXT, "cls").agg(F.collect_list(F.struct("place", "key")).alias("at"))
    return rows.select(*_TEXT, "cls", F.col("at.place").alias("places"), F.col("at.key").alias("keys"))


def _window_matches(texts: DataFrame, suffixes: DataFrame, least: int, window: int) -> DataFrame:
    """The most words to the left and to the right of suffixes (cls, doc_id, place, key) in windows of ``least`` words that
    stand elsewhere too, whichever suffix they are shared with. All hold the place, so that together they are one span."""
    around = written(texts.join(_wanted(suffixes), _TEXT).select("doc_id", "text", "cls", "places").mapInArrow(_with_windows(least, window), _CONTEXT), "contexts")
    contexts = written(
        around.groupBy("context").agg(
            F.count("*").alias("n"), F.first("least_left").alias("least_left"), F.first("windows", ignorenulls=True).alias("windows"),
        ),
        "windows",
    )
    each = lambda some: some.select("context", "n", "least_left", F.posexplode("windows").alias("more", "hash"))
    shared = written(each(contexts).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"), "shared-windows")
    single = each(contexts.where("n = 1")).join(shared, "hash", "left_semi").groupBy("context").agg(
        F.max(F.col("least_left") + F.col("more")).alias("left"), (least - F.min(F.col("least_left") + F.col("more"))).alias("right"),
    )
    several = contexts.where("n > 1").select("context", (F.col("least_left") + F.size("windows") - 1).alias("left"), (least - F.col("least_left")).alias("right"))
    return around.select("cls", "place", "context").join(single.unionByName(several), "context").select("cls", "place", "left", "right")


def _matches(texts: DataFrame, suffixes: DataFrame, least: int, window: int) -> DataFrame:
    """Long enough matches of neighbouring suffixes (cls, doc_id, place, key), sorted by key and the words after it."""
    order = ["key", "after", "cls", "place"]
    sorted_ = texts.join(_wanted(suffixes), _TEXT).select(
        "doc_id", "text", "cls", "places", "keys",
    ).mapInArrow(_with_words(least, window), _SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(sorted_.mapInArrow(_compare(least, window), _FOUND), "matches")
    ends = found.where("side >= 0").orderBy("part", "side").select("cls", "place", "key", "before", "after").toArrow()  # two rows a partition
    left, right = longest_matches(ends, least, window, 1)
    across = [(c, p, int(x), int(y)) for c, p, x, y in zip(ends.column(0).to_pylist(), ends.column(1).to_pylist(), left, right, strict=True) if y >= 0]
    return found.where("side = -1").select("cls", "place", "left", "right").unionByName(
        texts.sparkSession.createDataFrame(across, "cls long, place int, left int, right int")
    )


def _joined(matches: DataFrame) -> DataFrame:
    """Overlapping or touching matches of a class as one span: (cls, start_word, end_word)."""
    spans = matches.select(
        "cls", (F.col("place") - F.col("left")).alias("s"), (F.col("place") + F.col("right")).alias("e"),
    ).groupBy("cls", "s").agg(F.max("e").alias("e"))
    order = Window.partitionBy("cls").orderBy("s")
    fresh = F.coalesce(F.col("s") > F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = spans.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order))
    return numbered.groupBy("cls", "run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).drop("run")


def without_repeats(docs: DataFrame, least: int = 50, gram: int = 5, window: int = 20) -> DataFrame:
    """``docs`` with every word of a repeated passage taken out of ``text``, all occurrences alike; the words left stand
    single-spaced, in their own case. Rows without repeats stay as they are, each text of a doc_id is cut at its own
    places, and other columns stay in any case."""
    found = _passages(docs, least, gram, window).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start_word", "end_word")).alias("__cut"))
    found = found.withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"})
    joined = docs.join(found, (docs["doc_id"] == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left")
    # a space on either side, so that the first and the last part are empty and places count from 1
    words = F.split(F.concat(F.lit(" "), "text", F.lit(" ")), "[ \\t-\\r]+")
    left = F.filter(words, lambda w, k: (w != "") & ~F.exists("__cut", lambda c: (k > c["start_word"]) & (k <= c["end_word"])))
    return joined.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(left, " "))).select(docs.columns)
