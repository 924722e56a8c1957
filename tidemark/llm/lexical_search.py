"""Ranked lexical search as a threshold-seeded join.

Every term of a query has, stored with its postings, the k highest impacts that any document gives it (per unit of the
term's weight). They serve three times:

1. k documents reach a term's stored k-th impact, so the greatest of an item's k-th impacts bounds its k-th score from
   below; the documents behind the stored impacts are scored exactly, and the k-th of those scores raises that bound.
2. An item's terms are ordered from rare to frequent. A document that holds only terms of a suffix scores at most the sum
   of their highest impacts; the suffix whose sum lies below the bound makes no candidates.
3. The other terms' postings are joined and added up by item and document. The documents with the highest sums are scored
   exactly, which raises the bound again. A sum plus the bound of the suffix, and the suffix sum of the document's rarest term,
   must both reach the item's bound; the documents left are scored exactly.

Nothing is lost: a document is left out only if its score is provably less than that of k others.
All arithmetic of scores is in 64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_slices, texts_as_bytes, written

#: Bytes of terms stay, A-Z become a-z; every other ASCII byte parts terms.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def term_counts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, n (terms with repeats), terms and counts (of each different term) of every row; null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            counted = [Counter(terms(t)) for t in texts_as_bytes(batch, text)]
            columns = [
                pa.array([c.total() for c in counted], pa.int64()),
                pa.array([list(c) for c in counted], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in counted], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n", "terms", "counts"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n long, terms array<binary>, counts array<long>")


def _exact(pairs: DataFrame, forward: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item, doc, doc_id, score) of ``pairs`` (item, doc): the sum of all impacts of the item's terms in the document.

    Each pair meets its document's terms and its item's once; the addition is made in place.
    """

    def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column(batch.schema.get_field_index(name))
        found = lists.flatten()
        return np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())), found.field(0).to_numpy(), found.field(1).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (row, held, share), (asking, asked, weight) = flat(batch, "held"), flat(batch, "asked")
            ids, number = np.unique(np.concatenate((held, asked)), return_inverse=True)
            own, wish = row * len(ids) + number[: len(held)], asking * len(ids) + number[len(held) :]
            order = np.argsort(own)
            at = np.minimum(np.searchsorted(own, wish, sorter=order), max(len(own) - 1, 0))
            score = np.zeros(len(batch), np.int64)
            if len(own):
                hit = own[order[at]] == wish
                np.add.at(score, asking[hit], weight[hit] * share[order[at[hit]]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["item", "doc", "doc_id", "score"])

    asked = wanted.groupBy("item").agg(F.collect_list(F.struct("term_id", "weight")).alias("asked"))
    both = pairs.join(forward, "doc").join(asked, "item").select("item", "doc", "doc_id", "held", "asked")
    return both.mapInArrow(run, f"item long, doc long, doc_id {forward.schema['doc_id'].dataType.simpleString()}, score long")


def _kth(scored: DataFrame, k: int, by: str) -> DataFrame:
    """(item, bound): the k-th highest ``score`` of each item that has k of them."""
    ranked = scored.select("item", "score", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))).alias("place"))
    return ranked.where(F.col("place") == k).select("item", F.col("score").alias(by))


def search(items: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents above 0 of each row of ``items`` (item_id, text).

    ``docs`` has doc_id and text. Scores are integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a
    document's length measure m is 75 + (25 n N) div L, and a document scores, over the item's terms with repeats, the sum of
    weight * ((10^9 tf) div (1000 tf + 12 m)). N and L count documents with a term and all their terms.

    Each row is a document or an item of its own: rows that repeat a doc_id are ranked each, and so are items of one item_id.
    Equal scores are ranked by doc_id, null last. Null, empty and term-less texts hold no term: as documents they count
    in no statistic, as items they give no row. Empty tables give an empty result. Other columns play no part.

    Documents are read and split into terms once. The join with the items' terms is left to Spark, which broadcasts them
    only if they are small and deals out hot terms anew if they are not.
    """
    asked = written(term_counts(items.select("item_id", "text").withColumn("item", F.struct("item_id", F.monotonically_increasing_id().alias("item"))), "item"), "items")
    asked = asked.select(F.col("item.item_id").alias("item_id"), F.col("item.item").alias("item"), "terms", "counts")
    flat = F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("repeats")))
    wanted = asked.select("item", flat).toDF("item", "term", "repeats")
    vocabulary = written(wanted.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")

    counted = written(term_counts(docs, "doc_id").withColumn("doc", F.monotonically_increasing_id()), "documents")
    n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    share = F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)")
    met = counted.select("doc", "doc_id", m.alias("m"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf")))).toDF("doc", "doc_id", "m", "term", "tf")
    postings = met.join(vocabulary, "term").select("doc", "doc_id", "term_id", share.alias("share"))
    forward = written(postings.groupBy("doc", "doc_id").agg(F.collect_list(F.struct("term_id", "share")).alias("held")), "forward")
    postings = forward.select("doc", F.inline("held"))

    # the stored impacts: the k highest shares of each term, with their documents
    place = F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("share"), "doc"))
    stored = written(postings.withColumn("place", place).where(F.col("place") <= k), "impacts")
    df = postings.groupBy("term_id").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    tops = stored.groupBy("term_id").agg(F.max("share").alias("highest"), F.max(F.when(F.col("place") == k, F.col("share"))).alias("kth"))
    terms_of = vocabulary.join(df, "term_id").join(tops, "term_id").select("term", "term_id", "df", weight.alias("weight"), "highest", "kth")
    wanted = wanted.join(terms_of, "term").select("item", "term_id", "df", (F.col("repeats") * F.col("weight")).alias("weight"), "highest", "kth")
    wanted = written(wanted, "wanted")

    seeds = wanted.join(stored.select("term_id", "doc"), "term_id").select("item", "doc").distinct()
    seeded = written(_exact(seeds, forward, wanted), "seeds")
    bounds = wanted.groupBy("item").agg(F.max(F.col("weight") * F.col("kth")).alias("least")).join(_kth(seeded, k, "reached"), "item", "left")
    bounds = bounds.select("item", F.greatest(F.coalesce("least", F.lit(0)), F.coalesce("reached", F.lit(0))).alias("bound"))

    # suffix sums from rare to frequent; a suffix below the bound makes no candidates
    onward = Window.partitionBy("item").orderBy("df", "term_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    summed = wanted.withColumn("suffix", F.sum(F.col("weight") * F.col("highest")).over(onward)).join(bounds, "item")
    leading = summed.withColumn("leads", F.col("suffix") >= F.col("bound"))
    rest = leading.groupBy("item").agg(F.coalesce(F.max(F.when(~F.col("leads"), F.col("suffix"))), F.lit(0)).alias("rest"), F.first("bound").alias("bound"))
    leading = written(leading.where("leads").select("item", "term_id", "weight", "suffix"), "leading")
    impact = F.col("weight") * F.col("share")
    reached = written(leading.join(postings, "term_id").groupBy("item", "doc").agg(F.sum(impact).alias("part"), F.max("suffix").alias("most")), "reached")

    # the documents with the highest parts raise the bound once more; a document's rarest term bounds its score as well
    leaders = reached.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part"), "doc"))).where(F.col("place") <= 4 * k)
    again = written(_exact(leaders.select("item", "doc"), forward, wanted), "leaders")
    rest = rest.join(_kth(again, k, "raised"), "item", "left").select("item", "rest", F.greatest("bound", F.coalesce("raised", F.lit(0))).alias("bound"))
    candidates = reached.join(rest, "item").where("part + rest >= bound and most >= bound").select("item", "doc")
    scored = written(_exact(candidates, forward, wanted).where("score > 0"), "scored")

    ranks = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    best = scored.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

