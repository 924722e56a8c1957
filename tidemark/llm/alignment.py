"""Alignment of two tokenizers over the same bytes.

Python tokenises a text and marks, over arrays of its tokens' ends, the bytes where tokens of both end together: they cut
both into groups, and at each of them one token of A and one of B are linked. What concerns the corpus is Spark's: how often
a pair of ids is linked is counted over all links and looked up again. Pairs of at least a ``1 / frequent_pairs`` share of
all links, of which there can be no more than ``frequent_pairs``, are broadcast, the others are joined.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_slices, texts_as_bytes, written

#: Tabs, control characters, spaces of other kinds and the sign that pieces use for a space: such texts go whole, and so do
#: texts with white space beside white space or at an end. In all others no pre-token and no piece crosses a space.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u2060\u2581\u3000\ufeff]")


def _by_word(text: str) -> bool:
    return not (_ODD.search(text) or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace())


def _byte_values() -> dict[str, int]:
    """character -> byte of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Tokens of a text under a byte-level file of ``tokenizers`` (A) and a ``sentencepiece`` model (B)."""

    def __init__(self, a_path: str, b_path: str, limit: int = 250_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        a.encode_special_tokens = True
        self.a, values = a, _byte_values()
        special = {i for i, t in a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = {i: bytes(values[c] for c in t) for t, i in a.get_vocab().items() if i not in special}
        self.ranked = self._ranked(a_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in parts], np.int32) for parts in ([self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)], self.b_bytes))
        #: whether pieces only begin with spaces, so that words can be encoded by themselves
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known, self.limit = {}, limit

    def _ranked(self, path: str):
        """The same file as ranks for ``tiktoken``, which reads faster, if its ids are in the order of its merges."""
        import json
        from pathlib import Path

        import public_tokenizers
        import tiktoken

        model = json.loads(Path(path).read_text())["model"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {v: i for i, v in self.a_bytes.items()}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        """Token ids of a text under A, with a space before it, and under B, which adds that space."""
        a = self.ranked(" " + text) if self.ranked else self.a.encode(" " + text, add_special_tokens=False).ids
        return a, self.b.encode(text)

    def _encode(self, words: Sequence[str]) -> list[tuple[bytes, bytes] | None]:
        """Token ids of each word under A and under B, as bytes; None for a word whose joined bytes differ.

        The words are encoded as one text and cut where each ends; halves are tried apart where that text is altered.
        """
        found, stops = [], np.cumsum([len(w.encode()) + 1 for w in words])
        text = " ".join(words)
        whole = b" " + text.encode()
        for ids, part, sizes in zip(self._ids(text), (self.a_bytes.__getitem__, self.b_bytes.__getitem__), (self.a_sizes, self.b_sizes), strict=True):
            if same := bool(text) and b"".join(map(part, ids)) == whole:
                held = np.array(ids, np.int32)
                ends = np.cumsum(sizes[held])
                last = np.searchsorted(ends, stops)
                same, held, cuts = bool((ends[last] == stops).all()), held.tobytes(), [0, *(4 * last + 4).tolist()]
            if not same:
                half = len(words) // 2
                return self._encode(words[:half]) + self._encode(words[half:]) if half else [None]
            found.append([held[x:y] for x, y in itertools.pairwise(cuts)])
        return list(zip(*found, strict=True))

    def tokens(self, texts: list[str]) -> Iterator[list[np.ndarray] | None]:
        """a_ids, a_ends, b_ids and b_ends of each text, or None where it has no tokens."""
        few, size = [], 0
        for text in texts:
            if few and size + len(text) > 1_000_000:  # so many characters stand in words at once
                yield from self._together(few)
                few, size = [], 0
            few.append(text)
            size += len(text)
        yield from self._together(few)

    def _together(self, texts: list[str]) -> Iterator[list[np.ndarray] | None]:
        """``tokens`` of texts whose new words are encoded together."""
        rows = []
        for text in texts:
            words = text.split(" ") if text and self.by_word and _by_word(text) else None
            rows.append((words, list(map(self.known.get, words)) if words else self._encode([text])))
        new = list(dict.fromkeys(w for words, own in rows if words and None in own for w, x in zip(words, own, strict=True) if x is None))
        found = {w: x for part in itertools.batched(new, 2000) for w, x in zip(part, self._encode(part), strict=True)}
        for w in new[: max(self.limit - len(self.known), 0)]:  # the words met first stay, being the common ones
            if len(w) < 24 and found[w] is not None:
                self.known[w] = found[w]
        for words, own in rows:
            if words and None in own:
                own = [found[w] if x is None else x for w, x in zip(words, own, strict=True)]
            if None in own:
                yield None
                continue
            out = []
            for x, sizes in zip(zip(*own, strict=True), (self.a_sizes, self.b_sizes), strict=True):
                ids = np.frombuffer(b"".join(x), np.int32)
                out += [ids, np.cumsum(sizes[ids], dtype=np.int32)]
            yield out

    def decimals(self) -> tuple[np.ndarray, np.ndarray]:
        """What ``group_text`` writes for an id of A and of B: at twice the id, one further for the last of a group."""
        written = [[f"{i}{mark}".encode() for i in range(len(sizes)) for mark in marks] for sizes, marks in ((self.a_sizes, ",|"), (self.b_sizes, ",;"))]
        kind = f"S{max(8, *(len(x[-1]) for x in written))}"
        return np.array(written[0], kind), np.array(written[1], kind)


def last_of_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of A and of B, whether one of the other tokenizer ends at the same byte; both end with the text."""
    out = []
    for own, others in ((a_ends, b_ends), (b_ends, a_ends)):
        ended = np.zeros(int(others[-1]) + 1, bool)
        ended[others] = True
        out.append(ended[own])
    return out[0], out[1]


def links(a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
    """The linked ids at each common end, as one number a pair: A's in the high half, B's in the low."""
    return (a_ids[a_last].astype(np.int64) << 32) | b_ids[b_last]


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, decimals: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""
    a_stops, b_stops = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    a_sizes, b_sizes = np.diff(a_stops, prepend=0), np.diff(b_stops, prepend=0)
    parts = np.empty(len(a_ids) + len(b_ids), decimals[0].dtype)
    # a group's tokens of A stand after B's of the groups before, its tokens of B also after A's of its own
    parts[np.arange(len(a_ids)) + np.repeat(b_stops - b_sizes, a_sizes)] = decimals[0][2 * a_ids + a_last]
    parts[np.arange(len(b_ids)) + np.repeat(a_stops, b_sizes)] = decimals[1][2 * b_ids + b_last]
    return parts.tobytes().translate(None, b"\0")[:-1]


_held: dict[tuple[str, str], tuple[Pair, tuple[np.ndarray, np.ndarray]]] = {}


def grouped(docs: DataFrame, a_path: str, b_path: str, *keep: str) -> DataFrame:
    """Columns ``keep``, n_a and n_b (numbers of tokens), groups (``group_text``) and links (``links``); 0 and empty without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _held:
            pair = Pair(a_path, b_path)
            _held[a_path, b_path] = pair, pair.decimals()
        pair, decimals = _held[a_path, b_path]
        for batch in in_slices(batches, 32):
            n_a, n_b, texts, linked = [], [], [], []
            for x in pair.tokens([t.decode() for t in texts_as_bytes(batch)]):
                a_ids, a_ends, b_ids, b_ends = x or [np.zeros(0, np.int32)] * 4
                last = last_of_groups(a_ends, b_ends) if x else (np.zeros(0, bool),) * 2
                n_a.append(len(a_ids))
                n_b.append(len(b_ids))
                texts.append(group_text(a_ids, b_ids, *last, decimals))
                linked.append(links(a_ids, b_ids, *last))
            offsets = np.cumsum([0, *map(len, linked)])
            columns = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(linked)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, "n_a", "n_b", "groups", "links"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, n_a long, n_b long, groups string, links array<long>")


def align(docs: DataFrame, a_path: str, b_path: str, frequent_pairs: int = 200_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds that space itself; neither adds special tokens, and their
    strings in a text are plain text. A text that is null, empty or that either tokenizer alters has no tokens: zeros and ''.
    n_best counts the links whose pair of ids is linked as often as any pair with that B id in the corpus, count_sum adds up
    how often each link's pair is linked. Rows that repeat a doc_id count each; other columns play no part; an empty table
    gives an empty result.

    Links are written once. Only counts of pairs are shuffled, added up in each task before, and rare pairs' links; no row
    is as wide as a pair's documents. Of the pairs broadcast there are ``frequent_pairs`` at most, whatever the corpus.
    """
    n_links = F.size("links").cast("long")
    aligned = grouped(docs, a_path, b_path, "doc_id").select(
        "doc_id", F.monotonically_increasing_id().alias("doc"), "n_a", "n_b", n_links.alias("n_groups"), F.when(n_links > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256"), "links"
    )
    aligned = written(aligned, "aligned")
    pairs = written(aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = pairs.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("highest"))
    pairs = written(pairs.join(highest, b_id == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")), "counts")
    least = (pairs.agg(F.sum("count")).first()[0] or 0) // frequent_pairs + 1
    frequent, rare = pairs.where(F.col("count") >= least), pairs.where(F.col("count") < least)
    met = aligned.select("doc", F.explode("links").alias("pair")).join(F.broadcast(frequent), "pair", "left")
    # a document's frequent links become one row, its rare ones a row for each pair
    met = met.groupBy("doc", F.when(F.col("count").isNull(), F.col("pair")).alias("pair")).agg(F.sum("count").alias("sum"), F.sum("best").alias("n_best"), F.count("*").alias("times"))
    met = written(met, "met")
    looked_up = met.where("pair is not null").join(rare, "pair").select("doc", (F.col("count") * F.col("times")).alias("sum"), (F.col("best") * F.col("times")).alias("n_best"))
    sums = met.where("pair is null").select("doc", "sum", "n_best").unionByName(looked_up).groupBy("doc").agg(F.sum("sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return aligned.drop("links").join(sums, "doc", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), none("n_best"), none("count_sum"), "groups_sha256")


def default_tokenizers() -> tuple[str, str]:
    """Paths of the public byte-level and piece vocabularies; any files of their kinds will do instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
