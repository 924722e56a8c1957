"""Language-model scoring by deleted interpolation of n-gram estimates.

A token's probability mixes the maximum-likelihood estimates of all orders with a uniform one. The mixture
weights depend on how often the token's context was seen, and are learnt by expectation-maximisation on
a part of the training documents that is left out of the counts meanwhile ("deleted"); the final
counts have that part too.

Counts cover the whole corpus and nobody holds them whole. Documents become blocks of bounded
size, each with its own sorted vocabulary. A block asks for the counts of its distinct n-grams, one
request per range of n-gram hashes; a range gathers the requests of all blocks, adds them up and answers
each in the order asked, so that answers carry no keys. As every block names an n-gram once,
a frequent one weighs no more than a rare one. There are half as many ranges as blocks, each worked off by
order, and both are dealt to tasks by their number, so that a range and a task stay the same size however
many texts there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import WordHashes, ascii_words, fold, in_slices, mix, texts_as_bytes, written

_hashes = WordHashes()
#: Hash of the start of a text (b" ") and of its end (b""); no word is either.
_BOUNDS = (b" ", b"")
#: Context frequencies fall into buckets of doubling width.
CONTEXT_BUCKETS = 24


def _narrow(hashes: np.ndarray) -> np.ndarray:
    """The upper 48 bits."""
    return hashes >> np.uint64(16)


def planes(values: np.ndarray) -> bytes:
    """32-bit integers, lowest bytes first, then the next bytes: the empty upper ones compress to nothing."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


# ---- blocks


def _block_type(doc_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("tuning", T.BooleanType()), T.StructField("doc_ids", T.ArrayType(doc_id)),
            *(T.StructField(n, T.BinaryType()) for n in ("folds", "lengths", "vocabulary", "tokens")),
        ]
    )


def token_blocks(docs: DataFrame, folds: int, tuning: int, block_tokens: int) -> DataFrame:
    """Documents as token numbers into their block's sorted vocabulary of 48-bit word hashes. Documents of the
    ``tuning`` fold stand in blocks of their own."""
    out = _block_type(docs.schema["doc_id"].dataType)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, part, seq = np.uint64(_hashes[_BOUNDS[1]]), TaskContext.get().partitionId(), 0
        held: dict[bool, tuple[list, list, list]] = {False: ([], [], []), True: ([], [], [])}
        sizes = {False: 0, True: 0}

        def flush(kind: bool) -> pa.RecordBatch:
            nonlocal seq
            names, fold_of, words = held[kind]
            vocabulary, tokens = np.unique(_narrow(np.concatenate(words)), return_inverse=True)
            row = {
                "block": (part << 24) + seq, "tuning": kind, "doc_ids": list(names), "folds": np.array(fold_of, np.uint8).tobytes(),
                "lengths": np.array([len(w) for w in words], "<u4").tobytes(), "vocabulary": vocabulary.astype("<u8").tobytes(),
                "tokens": planes(tokens),
            }
            seq += 1
            for x in held[kind]:
                x.clear()
            sizes[kind] = 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in in_slices(batches):
            for name, fold_, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_as_bytes(batch), strict=True):
                kind = fold_ == tuning
                words = np.append(_hashes.of(ascii_words(text)), end)
                for x, value in zip(held[kind], (name, fold_, words), strict=True):
                    x.append(value)
                sizes[kind] += len(words)
                if sizes[kind] >= block_tokens:
                    yield flush(kind)
        for kind in (False, True):
            if held[kind][0]:
                yield flush(kind)

    return docs.select("doc_id", "text", fold("doc_id", folds).cast("int").alias("fold")).mapInArrow(run, out)


class Block:
    """A block's n-grams: for each order the distinct keys, sorted, and which one stands at each token."""

    def __init__(self, row: dict, order: int, held_out: int, tuning: int):
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.folds = np.frombuffer(row["folds"], np.uint8)
        vocabulary = np.frombuffer(row["vocabulary"], "<u8").astype(np.uint64)
        tokens = from_planes(row["tokens"]).astype(np.int32)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        fold_of = self.folds[self.doc]
        self.base, self.tuned = (fold_of != held_out) & (fold_of != tuning), fold_of == tuning
        self.keys, self.at = [vocabulary], [tokens]
        starts = np.cumsum(self.lengths) - self.lengths
        begin, words = np.uint64(_hashes[_BOUNDS[0]]), vocabulary[tokens]
        grams, self.context = words, [None]
        for n in range(2, order + 1):
            # the key of order n at a token: that of order n - 1 at the token before, and the word itself
            before = np.concatenate(([begin], grams[:-1]))
            before[starts] = begin
            grams = _narrow(mix(before, words))
            del before
            own, place = np.unique(grams, return_inverse=True)
            self.keys.append(own)
            self.at.append(place.astype(np.int32))
            ahead = np.roll(self.at[n - 2], 1)
            ahead[starts] = -1
            self.context.append(ahead)

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.keys[n])
        return np.bincount(self.at[n][self.base], minlength=size), np.bincount(self.at[n][self.tuned], minlength=size)


# ---- requests and answers

_REQUEST = "range int, block long, tuning boolean, n int, low binary, high binary, base binary, tuned binary"
_ANSWER = "block long, tuning boolean, n int, range int, base binary, tuned binary, distinct long, distinct_base long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_REQUEST_ARROW = pa.schema(list(zip(_names(_REQUEST), (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 4), strict=True)))
_ANSWER_ARROW = pa.schema(list(zip(_names(_ANSWER), (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)))


def _requests(order: int, held_out: int, tuning: int, ranges: int):
    edges = np.array([(k << 48) // ranges for k in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(row, order, held_out, tuning)
                for n in range(order):
                    keys, (base, tuned), out = block.keys[n], block.counts(n), []
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    for r in range(ranges):
                        a, b = cuts[r], cuts[r + 1]
                        if a < b:
                            out.append(
                                {
                                    "range": r, "block": row["block"], "tuning": row["tuning"], "n": n, "low": keys[a:b].astype("<u4").tobytes(),
                                    "high": (keys[a:b] >> np.uint64(32)).astype("<u2").tobytes(), "base": planes(base[a:b]),
                                    "tuned": planes(tuned[a:b]),
                                }
                            )
                    yield pa.RecordBatch.from_pylist(out, _REQUEST_ARROW)

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Add up the counts of one range and order, and answer each request in its own order."""
    range_, n = (x.as_py() for x in key)
    rows, out = table.to_pylist(), []
    keys = np.concatenate([np.frombuffer(r["low"], "<u4").astype(np.uint64) | np.frombuffer(r["high"], "<u2").astype(np.uint64) << np.uint64(32) for r in rows])
    own, place = np.unique(keys, return_inverse=True)
    base, tuned = (np.bincount(place, np.concatenate([from_planes(r[c]) for r in rows]), len(own)).astype(np.int64) for c in ("base", "tuned"))
    cut = 0
    for r in rows:
        at = place[cut : cut + len(r["low"]) // 4]
        cut += len(at)
        out.append(
            {
                "block": r["block"], "tuning": r["tuning"], "n": n, "range": range_, "base": planes(base[at]), "tuned": planes(tuned[at]),
                "distinct": None, "distinct_base": None,
            }
        )
    out.append(
        {
            "block": -1, "tuning": False, "n": n, "range": range_, "base": None, "tuned": None, "distinct": int((base + tuned > 0).sum()),
            "distinct_base": int((base > 0).sum()),
        }
    )
    return pa.Table.from_pylist(out, _ANSWER_ARROW)


# ---- the model

def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXT_BUCKETS - 1, np.log2(count + 1.0).astype(np.int8))


def estimates(block: Block, counts: list[np.ndarray], tokens: int, texts: int, distinct: int) -> tuple[list[np.ndarray], np.ndarray]:
    """By token: the estimates from the uniform one up to the highest order, and the bucket of its context. An
    order whose context was never seen repeats the order below."""
    out = [np.full(len(block.doc), 1.0 / (distinct + 1)), counts[0][block.at[0]] / max(1, tokens)]
    seen = np.full(len(block.doc), float(tokens))
    for n in range(1, len(counts)):
        ahead = block.context[n]
        seen = np.where(ahead < 0, texts, counts[n - 1][ahead])
        out.append(np.where(seen > 0, counts[n][block.at[n]] / np.maximum(seen, 1), out[-1]))
    return out, context_bucket(seen)


def shares(cells: np.ndarray, numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How many of the tokens each order accounts for, by bucket, under ``weights``: the sums of one round of EM."""
    bucket = cells[:, 0].astype(np.int64)
    part = cells[:, 1:] * weights[bucket]
    part *= (numbers / np.maximum(part.sum(1), 1e-300))[:, None]
    return np.column_stack([np.bincount(bucket, x, CONTEXT_BUCKETS) for x in part.T])


def learn_weights(cells: np.ndarray | Callable[[np.ndarray], np.ndarray], numbers: np.ndarray | None, orders: int, rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """Mixture weights by bucket from (bucket, estimates...) cells and how many tokens fall into each, or from a
    function that gives the ``shares`` of cells that stand elsewhere; all that comes here then is its sums.

    All buckets together come first; their weights, worth ``prior`` tokens, steady the rare buckets.
    """
    shared = cells if callable(cells) else lambda weights: shares(cells, numbers, weights)
    weights = np.full((CONTEXT_BUCKETS, orders), 1.0 / orders)
    for k in range(rounds):
        total = shared(weights).sum(0)
        if not k and not total.any():
            return weights
        weights = np.tile((total + 1e-3) / (total + 1e-3).sum(), (CONTEXT_BUCKETS, 1))
    belief = prior * weights
    for _ in range(rounds):
        total = shared(weights) + belief
        weights = total / total.sum(1, keepdims=True)
    return weights


_STEP = 8  # cells a doubling of an estimate


def _cells(p: list[np.ndarray], bucket: np.ndarray) -> np.ndarray:
    """One integer a token: its bucket and its estimates above the uniform one, to an eighth of a doubling."""
    code = bucket.astype(np.int64)
    for x in p[1:]:
        code = code * 1024 + np.where(x > 0, np.minimum(1022, np.round(-_STEP * np.log2(np.maximum(x, 1e-300))).astype(np.int64)), 1023)
    return code


_ESTIMATE = np.append(2.0 ** (-np.arange(1023) / _STEP), 0.0)


def _decoded(codes: np.ndarray, order: int, uniform: float) -> np.ndarray:
    columns = [_ESTIMATE[codes >> 10 * k & 1023] for k in reversed(range(order))]
    return np.column_stack([codes >> 10 * order, np.full(len(codes), uniform), *columns])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (cell, n) rows of a batch as one row of two arrays."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x.to_numpy().astype("<i8").tobytes()]) for x in batch.columns], names=["cell", "n"])


def _shares_of(cells: DataFrame, order: int, uniform: float) -> Callable[[np.ndarray], np.ndarray]:
    """``shares`` over a table (cell, n), summed in Spark: of each round one small array a task reaches the driver."""
    rows = written(cells.mapInArrow(_packed, "cell binary, n binary"), "tuning-cells")

    def shared(weights: np.ndarray) -> np.ndarray:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(weights.shape)
            for batch in batches:
                for codes, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    total += shares(_decoded(np.frombuffer(codes, "<i8"), order, uniform), np.frombuffer(n, "<i8"), weights)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

        sums = [np.frombuffer(r["total"]).reshape(weights.shape) for r in rows.mapInArrow(own, "total binary").collect()]
        return sum(sums, np.zeros(weights.shape))

    return shared


def _gathered(table: pa.Table, order: int, *columns: str) -> list[np.ndarray]:
    """A block's answers put together again, by order: the sum of the named counts."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["range"]))
    return [np.concatenate([sum(from_planes(r[c]) for c in columns) for r in rows if r["n"] == n]) for n in range(order)]


def score_texts(docs: DataFrame, order: int = 3, folds: int = 10, held_out: int = 0, tuning: int = 1, block_tokens: int = 1 << 20, smoothing: float = 0.1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Training documents are those whose crc32(doc_id as text) mod ``folds`` is not ``held_out``; of them, the
    ``tuning`` fold learns the mixture weights while its own counts are left out. Tokens are words
    between ASCII white space, A-Z in lower case, and one end; null and empty texts are the end alone.
    n_known: tokens seen in training. base_score: add-``smoothing`` unigram log10 probability. score: that
    of the interpolated model of ``order``. Repeated rows count and are scored each; other columns are not
    read; an empty table gives no rows; with no training tokens at all every estimate but the uniform
    one is zero.
    """
    blocks = written(token_blocks(docs, folds, tuning, block_tokens), "token-blocks")
    # one order of a range is about as large as a block, and a task works off about two of either, whatever the size of the corpus
    n_blocks = max(16, blocks.count())
    ranges, tasks = max(16, n_blocks // 2), -(-n_blocks // 2)
    asked = blocks.mapInArrow(_requests(order, held_out, tuning, ranges), _REQUEST)
    answers = written(asked.repartition(tasks, "range", "n").groupBy("range", "n").applyInArrow(_answer, _ANSWER), "ngram-counts")
    totals = answers.where("block = -1 and n = 0").agg(F.sum("distinct"), F.sum("distinct_base")).first()
    distinct, distinct_base = totals[0] or 0, totals[1] or 0
    sizes = {
        (r["base"], r["tuned"]): (r["texts"], r["tokens"]) for r in blocks.mapInArrow(
            _sizes(held_out, tuning), "base boolean, tuned boolean, texts long, tokens long",
        ).groupBy("base", "tuned").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).collect()
    }
    (texts, tokens), (more_texts, more_tokens) = sizes.get((True, False), (0, 0)), sizes.get((False, True), (0, 0))

    def tune(key: tuple, block: pa.Table, answer: pa.Table) -> pa.Table:
        own = Block(block.to_pylist()[0], order, held_out, tuning)
        p, bucket = estimates(own, _gathered(answer, order, "base"), tokens, texts, distinct_base)
        codes, n = np.unique(_cells(p, bucket), return_counts=True)
        return pa.table({"cell": pa.array(codes), "n": pa.array(n.astype(np.int64))})

    by_block = lambda some: some.repartition(tasks, "block").groupBy("block")
    own_blocks, own_answers = by_block(blocks.where("tuning")), by_block(answers.where("tuning"))
    cells = own_blocks.cogroup(own_answers).applyInArrow(tune, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    weights = learn_weights(_shares_of(cells, order, 1.0 / (distinct_base + 1)), None, order + 1)

    out = T.StructType(
        [
            docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
            *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    schema, all_tokens, all_texts = to_arrow_schema(out), tokens + more_tokens, texts + more_texts

    def score(key: tuple, block: pa.Table, answer: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        own = Block(row, order, held_out, tuning)
        counts = _gathered(answer, order, "base", "tuned")
        p, bucket = estimates(own, counts, all_tokens, all_texts, distinct)
        mixed = np.zeros(len(bucket))
        for w in reversed(weights.T):  # each estimate goes as soon as it is added
            mixed += w[bucket] * p.pop()
        c = counts[0][own.at[0]]
        add = lambda x: np.bincount(own.doc, x, len(own.lengths))
        base = np.log10((c + smoothing) / (all_tokens + smoothing * (distinct + 1)))
        columns = [
            row["doc_ids"], own.folds == held_out, own.lengths, add(c > 0).astype(np.int64), np.full(len(own.lengths), all_tokens), add(base),
            add(np.log10(np.maximum(mixed, 1e-300))),
        ]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)

    return by_block(blocks).cogroup(by_block(answers.where("block >= 0"))).applyInArrow(score, out)


def _sizes(held_out: int, tuning: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            folds = np.frombuffer(b"".join(batch.column(names.index("folds")).to_pylist()), np.uint8)
            lengths = np.frombuffer(b"".join(batch.column(names.index("lengths")).to_pylist()), "<u4").astype(np.int64)
            rows = [((folds != held_out) & (folds != tuning), True, False), (folds == tuning, False, True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a for _, a, _ in rows]), pa.array([b for *_, b in rows]), pa.array([int(m.sum()) for m, *_ in rows], pa.int64()),
                    pa.array([int(lengths[m].sum()) for m, *_ in rows], pa.int64()),
                ],
                names=["base", "tuned", "texts", "tokens"],
            )

    return run
