"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint becomes a point: the number of set bits in each of its 32 two-bit segments.
The Manhattan distance of two points never exceeds the Hamming distance of their fingerprints, so
fingerprints within ``max_bits`` bits are points within that radius. The points are dealt to a grid
by groups of segments: if groups g1..gn have radii r1..rn with sum(r) = max_bits - n + 1, then some
group of a near pair lies within its own radius (else the distance would be max_bits + 1 or more).
Radii of 0 and 1 suffice for max_bits // 2 + 1 groups; a cell of radius 1 is met by listing a
point's direct neighbours on one side of the join. Every pair that meets is verified by its
exact Hamming distance, inside the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_words, in_slices, texts_as_bytes, written
from tidemark.llm.components import components

SEGMENTS = 32


def shingle_hashes(words: list[bytes], words_per_shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included. Fewer words: the whole sequence is one; none: none."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half the XXH64 values of the text's word shingles.

    Words are split at ASCII white space after lower-casing A-Z. Fewer words than a shingle: the whole
    sequence is one shingle. No words: 0.
    """
    return majority_bits(shingle_hashes(ascii_words(text), words_per_shingle, seed))


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            fps = np.array([fingerprint(t, words_per_shingle, seed) for t in texts_as_bytes(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def popcount_embedding(fp: Column) -> Column:
    """The 32 segment counts (0, 1 or 2), two bits each, as one long."""
    half, low = F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    one, two = fp.bitwiseXOR(half).bitwiseAND(low), fp.bitwiseAND(half).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _groups(max_bits: int) -> list[tuple[list[int], int]]:
    n = max_bits // 2 + 1
    ones = max_bits - n + 1
    return [([int(s) for s in part], int(k < ones)) for k, part in enumerate(np.array_split(np.arange(SEGMENTS), n))]


def near_pairs(fps: DataFrame, max_bits: int = 4, alike: float | None = None) -> DataFrame:
    """Rows (fp_a, fp_b, bits), fp_a < fp_b, of distinct fingerprints ``fps`` (fp) within max_bits bits.

    With ``alike``, ``fps`` has a positive ``size`` too, and the lesser of a pair's sizes is at least that share of the
    other: the size's logarithm is one more coordinate of the grid. With a column ``part``, pairs of one part are left out.
    """
    if not 0 <= max_bits <= 32:
        raise ValueError("max_bits must lie between 0 and 32")
    size = F.col("size").cast("double") if alike else F.lit(1.0)
    # two units a cell; sizes that are alike are at most one apart, so the next cell on the nearer side is enough
    spot = F.log(size) / (2.0001 * math.log(1 / alike)) if alike else F.lit(0.0)
    part = F.col("part") if "part" in fps.columns else F.lit(None).cast("string")
    points = fps.select(
        part.alias("part"), "fp", popcount_embedding(F.col("fp")).alias("point"), size.alias("size"), F.floor(spot).alias("level"),
        (F.round(spot) * 2 - F.floor(spot) - 1).cast("long").alias("next"),
    )
    own, met = [], []
    for g, (segments, radius) in enumerate(_groups(max_bits)):
        cell = F.col("point").bitwiseAND(F.lit(_signed(sum(3 << 2 * s for s in segments))))
        own.append(F.struct(F.lit(g).alias("g"), cell.alias("cell")))
        met.append(own[-1])
        for s in segments if radius else ():
            # one more or one less in this segment: 0 <-> 1 flips its low bit, 1 <-> 2 flips both
            count = F.shiftrightunsigned("point", 2 * s).bitwiseAND(F.lit(3))
            for flip, other in ((1, 2), (3, 0)):
                met.append(F.when(count != other, F.struct(F.lit(g).alias("g"), cell.bitwiseXOR(F.lit(_signed(flip << 2 * s))).alias("cell"))))
    a = points.select(F.col("fp").alias("fp_a"), F.col("size").alias("size_a"), F.col("part").alias("part_a"), "level", F.inline(F.array(*own)))
    levels = F.explode(F.array("level", "next") if alike else F.array("level"))
    b = points.select("fp", "size", "part", "point", levels.alias("level")).select(
        F.col("fp").alias("fp_b"), F.col("size").alias("size_b"), F.col("part").alias("part_b"), "level", F.inline(F.array_compact(F.array(*met))),
    )
    bits = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    same = (a["g"] == b["g"]) & (a["cell"] == b["cell"]) & (a["level"] == b["level"])
    near = (F.col("fp_a") < F.col("fp_b")) & (bits <= max_bits)
    if "part" in fps.columns:
        near = near & (F.col("part_a") != F.col("part_b"))
    if alike:
        near = near & (F.least("size_a", "size_b") >= alike * F.greatest("size_a", "size_b"))
    # Spark takes either side for as small as its source, before the listing of cells, and would broadcast tens of rows a fingerprint
    return a.join(b.hint("merge"), same & near).select("fp_a", "fp_b", bits.alias("bits")).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, fingerprint, component_id, n_links.

    Texts with the same fingerprint are one class and meet once, as a class; n_links counts the other
    classes within ``max_bits`` bits. component_id is the smallest doc_id reachable over such links.
    Null and empty texts have fingerprint zero, which links like any other. Other columns of ``docs``
    play no part. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, words_per_shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    pairs = written(near_pairs(classes, max_bits), "pairs")
    a, b = classes.select(F.col("fp").alias("fp_a"), F.col("rep").alias("u")), classes.select(F.col("fp").alias("fp_b"), F.col("rep").alias("v"))
    linked = components(pairs.join(a, "fp_a").join(b, "fp_b").select("u", "v"))
    links = pairs.select(F.col("fp_a").alias("fp")).unionByName(pairs.select(F.col("fp_b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    classes = classes.join(linked, classes["rep"] == linked["node"], "left").join(links, "fp", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    # written first: both sides of the last join are then plain shuffles, whose hot keys Spark can split
    return fps.join(written(classes, "classes"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


#: Band keys of a text: in each band the least values of so many hash functions.
BANDS, BAND_ROWS = 20, 5
#: Bits of the sketch that estimates a similarity before the texts' shingles are compared.
SKETCH = 1024
_CLASS = "text_hash long, cls binary, fp long, size long, bands array<long>"


def least_hashes(hashes: np.ndarray, count: int, seed: int) -> np.ndarray:
    """The least value of each of ``count`` hash functions over a set of 64-bit hashes."""
    r = np.random.default_rng(seed)
    flip, factor = r.integers(0, 1 << 64, count, dtype=np.uint64), r.integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    rows = max(1, 100_000 // count)  # as many as a core's cache holds
    for at in range(0, len(hashes), rows):
        np.minimum(least, ((hashes[at : at + rows, None] ^ flip) * factor).min(0), out=least)
    return least


def text_classes(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """doc_id, text_hash, cls (a 128-bit hash of all words), fp, size (number of different shingles) and bands of every row.

    Two texts of Jaccard similarity s share a band with probability 1 - (1 - s^5)^20: 0.9996 at 0.8. Texts without words
    have no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        for batch in in_slices(batches):
            cls, fps, sizes, bands = [], [], [], []
            for text in texts_as_bytes(batch):
                words = ascii_words(text)
                hashes = shingle_hashes(words, words_per_shingle)
                own = np.unique(hashes)
                cls.append(xxh3_128_digest(b" ".join(words)))
                fps.append(majority_bits(hashes))
                sizes.append(len(own))
                least = least_hashes(own, BANDS * BAND_ROWS, 1).reshape(BANDS, BAND_ROWS)
                bands.append(np.array([xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least)] if len(own) else [], np.uint64).view(np.int64))
            columns = [pa.array(cls, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "text_hash", "cls", "fp", "size", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_CLASS}")


#: Bits of the bitmap that tells which texts are wanted, for each of them: one text in 16 of the others passes, too.
_BITS = 16


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose (doc_id, text_hash) is not in ``wanted``, so that few texts are shuffled. What is
    broadcast are ``_BITS`` bits a wanted text."""
    buckets = max(1, -(-wanted.count() * _BITS // 32768))
    place = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets << 15))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(32767)).cast("int")
    marked = wanted.select(bucket.alias("bucket"), bit.cast("long").alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("marked"))
    byte = F.conv(F.hex(F.substring("marked", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1
    return rows.withColumn("bucket", bucket).join(F.broadcast(marked), "bucket").where(found).drop("bucket", "marked")


def _shingle_sets(docs: DataFrame, classes: DataFrame, words_per_shingle: int) -> DataFrame:
    """(cls, shingles) of ``classes`` (rep, text_hash, cls), from the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in in_slices(batches, 64):
            words = [ascii_words(t) for t in texts_as_bytes(batch)]
            # another text of the same doc_id and hash has another class
            own = [k for k, (w, cls) in enumerate(zip(words, batch.column(0).to_pylist(), strict=True)) if xxh3_128_digest(b" ".join(w)) == cls]
            sets = [np.unique(shingle_hashes(words[k], words_per_shingle)).view(np.int64) for k in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "shingles"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    wanted = classes.withColumnRenamed("rep", "doc_id")
    texts = _likely(hashed, wanted).join(wanted, ["doc_id", "text_hash"]).select("cls", "text")
    return texts.mapInArrow(run, "cls binary, shingles array<long>").dropDuplicates(["cls"])


def _sketches(sets: DataFrame) -> DataFrame:
    """(cls, sketch) of ``sets``: one bit of each of many least hashes. Of two texts, (1 - s) / 2 of the bits differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            least = [least_hashes(np.array(x, np.int64).view(np.uint64), SKETCH, 2) for x in batch.column(1).to_pylist()]
            bits = [np.packbits((x >> np.uint64(17) & np.uint64(1)).astype(np.uint8)).view(np.int64) for x in least]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["cls", "sketch"])

    return sets.select("cls", "shingles").mapInArrow(run, "cls binary, sketch array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (u, v) among ``pairs`` (a and b: structs of rep and cls) whose texts are alike."""
    flat = (F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("rep", "cls"))
    pairs = written(pairs.select(*flat), "candidates")
    both = pairs.join(sets.toDF("cls_a", "a"), "cls_a").join(sets.toDF("cls_b", "b"), "cls_b")
    shared = F.size(F.array_intersect("a", "b"))
    least = similarity * (F.size("a") + F.size("b") - shared) - 1e-9
    return both.where(shared >= least).select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))


def similar_groups(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, max_bits: int = 3) -> DataFrame:
    """(doc_id, group) of every row with a doc_id: the smallest doc_id reachable over links between texts whose sets of
    word shingles have that Jaccard similarity or more.

    Equal texts are one class. Classes meet in three ways, and every meeting is verified on the shingles themselves:

    1. Fingerprints within ``max_bits`` bits, by the grid of ``near_pairs``: nearly equal texts, which join here at once.
    2. Classes that share three bands or more with the least or the greatest of a band's classes.
    3. Whatever shares a band and is not joined yet. The join compares the sketches of both texts and keeps pairs that
       differ in no more bits than four standard deviations above what the similarity expects (one link in 30,000 at the
       very edge differs in more), so that large groups of texts that are just not alike enough give few rows. A pair
       that shares several bands is one row: it meets in the least of them.

    Texts that are joined already do not meet again, so that a group of edited copies does not give all its pairs. At the
    least similarity 0.9996 of the links share a band, above it more.
    """
    rows = written(text_classes(docs.where("doc_id is not null"), words_per_shingle), "texts")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = rows.groupBy("cls").agg(first, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes.select("cls", F.col("first.doc_id").alias("rep"), "first.text_hash", "fp", F.greatest("size", F.lit(1)).alias("size"), "bands"), "classes")

    # classes that share a band with another: nothing else can be alike
    banded = classes.select("cls", "rep", "text_hash", "fp", "size", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count("*").alias("held")).where("held > 1").select("band"), "bands")
    met = written(banded.join(shared, "band"), "met")
    alone = met.select("cls", "rep", "text_hash", "fp", "size").distinct()
    classes_met = written(alone, "classes-met")
    sets = written(_shingle_sets(docs, classes_met.select("rep", "text_hash", "cls"), words_per_shingle), "shingles")
    side = lambda rows, x: rows.select(F.col("fp").alias(f"fp_{x}"), F.struct("rep", "cls").alias(x))

    lead = F.min(F.struct("rep", "cls", "size")).alias("lead")
    leads = written(classes_met.groupBy("fp").agg(lead).select("fp", "lead.*"), "leads")
    same = side(classes_met, "b").join(side(leads, "a"), F.col("fp_a") == F.col("fp_b")).where("a.cls <> b.cls").select("a", "b")
    near = near_pairs(leads.select("fp", "size"), max_bits, similarity)
    near = near.join(side(leads, "a"), "fp_a").join(side(leads, "b"), "fp_b").select("a", "b")
    links = written(_alike(same.unionByName(near), sets, similarity), "links")

    alike_sizes = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size")
    joined = written(components(links), "joined")
    own = _with_parts(met, joined).select("band", F.struct("part", "rep", "cls", "size").alias("b"))
    ends = own.groupBy("band").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low.part <> high.part")
    leaders = ends.select("band", F.explode(F.array("low", "high")).alias("a"))
    pairs = own.join(leaders, "band").where((F.col("a.part") != F.col("b.part")) & alike_sizes)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared > 2").select("a", "b")
    links = written(_stars(joined).unionByName(_alike(pairs, sets, similarity)), "links")

    joined = written(components(links), "joined")
    own = written(_with_parts(met, joined), "own")
    apart = own.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("band")
    own = written(own.join(apart, "band"), "apart")
    sketches = _sketches(sets.join(own.select("cls").distinct(), "cls", "left_semi"))
    bands = own.groupBy("cls").agg(F.collect_set("band").alias("bands"))
    own = own.join(written(sketches.join(bands, "cls"), "sketches"), "cls").select("band", F.struct("part", "rep", "cls", "size", "sketch", "bands").alias("a"))
    differ = sum((F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(SKETCH // 64)), F.lit(0))
    share = (1 - similarity) / 2
    most = int(SKETCH * share + 4 * math.sqrt(SKETCH * share * (1 - share)))
    other = own.select(F.col("band").alias("band_b"), F.col("a").alias("b"))
    first_met = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("band")
    pairs = own.join(other, (F.col("band") == F.col("band_b")) & (F.col("a.part") < F.col("b.part")) & alike_sizes & (differ <= most) & first_met)
    pairs = pairs.select(F.struct("a.rep", "a.cls").alias("a"), F.struct("b.rep", "b.cls").alias("b"))
    links = written(_stars(joined).unionByName(_alike(pairs, sets, similarity)), "links")

    linked = components(links)
    named = classes.join(linked, classes["rep"] == linked["node"], "left").select("cls", F.coalesce("component", "rep").alias("group"))
    return rows.select("doc_id", "cls").join(written(named, "groups"), "cls").select("doc_id", "group")


def _stars(joined: DataFrame) -> DataFrame:
    """What is joined already as one link a node: the links that made it are not followed again."""
    return joined.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def _with_parts(met: DataFrame, joined: DataFrame) -> DataFrame:
    """``met`` (band, cls, rep, size) with part: the smallest rep reachable, by ``joined`` (node, component)."""
    return met.select("band", "cls", "rep", "size").join(joined, met["rep"] == joined["node"], "left").withColumn("part", F.coalesce("component", "rep")).drop("node", "component")


def keep_one_each(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of similar texts; all columns stay.

    Rows that repeat that doc_id stay too, and so do all rows without one. Null and empty texts are alike. An empty
    table gives an empty one.
    """
    found = similar_groups(docs, similarity, words_per_shingle, max_bits).where(F.col("doc_id") == F.col("group")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
