"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, toxic and ordinary, give every word a log-likelihood: its characters one by one, each after
up to ``order - 1`` characters of the same word. At the full context a model counts its own class; what
is rare or new there backs off to continuation counts that both classes share, so that only expressions
that one class really prefers tell them apart. Discounts come from the counts of counts. A text is
compared by its log-likelihoods per word, overall and over its strongest words, which a logistic
regression turns into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_slices, mix, written

WORD = r"[^\W_]+"
_FIND = re.compile(WORD).findall
#: Longer words (whole clauses in scripts without blanks) are read in pieces of so many characters.
LONGEST = 40
#: Stands at a piece's end where its word was cut; no word holds it.
CUT = "_"
#: Words that a worker remembers, and those that it looks up at once.
REMEMBERED, AT_ONCE = 100_000, 20_000
FEATURES = 6
#: A log-likelihood ratio from which a word speaks clearly for toxic.
CLEAR = 2.5


def words_of(text: str | None, order: int) -> list[str]:
    """The words; those over ``LONGEST`` characters in pieces that overlap by ``order - 1``, so that each run of
    ``order`` characters stands in just one of them."""
    words = _FIND((text or "").lower())
    return [p for w in words for p in (pieces_of(w, order) if len(w) > LONGEST else (w,))]


def pieces_of(word: str, order: int) -> Iterator[str]:
    for at in range(0, len(word) - order + 1, LONGEST - order + 1):
        yield f"{CUT if at else ''}{word[at : at + LONGEST]}{CUT if at + LONGEST < len(word) else ''}"
        if at + LONGEST >= len(word):
            break


def padded_of(word: str) -> str:
    """A word between ``^`` and ``$``, which do not stand where it was cut."""
    return f"{'' if word[0] == CUT else '^'}{word.strip(CUT)}{'' if word[-1] == CUT else '$'}"


def word_counts(docs: DataFrame, order: int) -> DataFrame:
    """(word, toxic, n): in how many texts of ``docs`` (text, toxic) a word stands, added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for label, c in enumerate(seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())],
                    names=["word", "toxic", "n"],
                )
                c.clear()

        for batch in in_slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(set(words_of(text, order)))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield from flush()
        yield from flush()

    return docs.select(
        "text", F.col("toxic").cast("int").alias("toxic"),
    ).mapInArrow(count, "word string, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def ngram_counts(words: DataFrame, order: int) -> DataFrame:
    """(gram, toxic, n): the ``order`` characters that end at each place of a word between ``^`` and ``$``, fewer at its
    start. Shorter ones inside a word are not counted: they follow from these."""
    mark = lambda cut, c: F.when(cut, F.lit("")).otherwise(F.lit(c))
    padded = F.concat(mark(F.col("word").startswith(CUT), "^"), F.translate("word", CUT, ""), mark(F.col("word").endswith(CUT), "$"))
    first = F.when(F.col("padded").startswith("^"), 2).otherwise(order)
    begin = lambda end: F.greatest(F.lit(1), end - order + 1)
    grams = F.transform(F.sequence(first, F.length("padded")), lambda end: F.substring(F.col("padded"), begin(end), end - begin(end) + 1))
    return words.withColumn("padded", padded).select("toxic", "n", F.explode(grams).alias("gram")).groupBy("gram", "toxic").agg(F.sum("n").alias("n"))


def code_points(grams: pa.ChunkedArray | pa.Array, order: int) -> np.ndarray:
    """A row of ``order`` code points a gram, with zeros after its last."""
    parts = [grams[at : at + 100_000].to_pylist() for at in range(0, len(grams), 100_000)]
    return np.concatenate([np.zeros((0, order), np.uint32), *(np.array(x, f"<U{order}").view(np.uint32).reshape(-1, order) for x in parts)])


def _hashed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's characters, zeros left out."""
    out = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        out = np.where(column > 0, mix(out, column.astype(np.uint64)), out)
    return out


def _without_first(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([codes[:, 1:], np.zeros((len(codes), 1), codes.dtype)], 1)


def _without_last(codes: np.ndarray) -> np.ndarray:
    ahead = _without_first(codes)
    return np.where(ahead > 0, codes, 0)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, and 3 or more, from how many grams n1 to n4 have a count of 1 to 4:
    k - (k + 1) Y n(k+1) / nk with Y = n1 / (n1 + 2 n2). Where that is not between 0 and k, for want of counts, it is Y,
    and Y is a half where no count is 1."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    own = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else -1.0 for k in (1, 2, 3)]
    return np.array([0.0, *(d if 0 < d <= k else y for k, d in enumerate(own, 1))])


def _discounted(counts: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By gram: its discounted share of its context; by context: what is left to the shorter gram, and whether it
    was seen at all."""
    taken = discounts(counts)[np.minimum(counts, 3)]
    total, left = np.bincount(context, counts), np.bincount(context, taken)
    return (counts - taken) / np.maximum(total, 1)[context], np.where(total > 0, left / np.maximum(total, 1), 1.0), total > 0


def shared_estimates(grams: np.ndarray, order: int) -> np.ndarray:
    """P(last character | those between it and the first) of each gram (distinct rows of code points), from continuation
    counts: in how many ways a shorter gram is preceded anywhere, whatever the class."""
    size = (grams > 0).sum(1)
    levels = {order: grams[size == order]}  # all grams of a length, each once
    for n in range(order - 1, 0, -1):
        both = np.concatenate([_without_first(levels[n + 1]), grams[size == n]])
        levels[n] = both[np.unique(_hashed(both), return_index=True)[1]]
    out, below = np.empty(len(grams)), (np.zeros(1, np.uint64), np.array([1.0 / (1 + len(np.unique(_last(grams))))]))
    for n in range(2, order + 1):
        # the estimates of the grams of n - 1 characters, known by those of n
        shorter = _without_first(levels[n])
        keys, first, counts = np.unique(_hashed(shorter), return_index=True, return_counts=True)
        shorter = shorter[first]
        share, left, _ = _discounted(counts, context := np.unique(_hashed(_without_last(shorter)), return_inverse=True)[1])
        rest = below[1][np.searchsorted(below[0], _hashed(_without_first(shorter)))] if n > 2 else below[1]
        below = keys, share + left[context] * rest
        at = size == n
        out[at] = below[1][np.searchsorted(keys, _hashed(_without_first(grams[at])))]
    return out


def _last(codes: np.ndarray) -> np.ndarray:
    return codes[np.arange(len(codes)), np.maximum((codes > 0).sum(1) - 1, 0)] if len(codes) else codes[:, 0]


@dataclass
class WordRatios:
    """log P(word | toxic) - log P(word | ordinary), by two sorted tables of hashes: of all grams that a class has
    counted, and of contexts for other grams (a gram new to both classes gets the same shared estimate in both, which
    cancels; so does all after a context that both have never met)."""

    order: int
    grams: np.ndarray
    gram_ratios: np.ndarray
    contexts: np.ndarray
    context_ratios: np.ndarray
    memory: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, codes: np.ndarray, toxic: np.ndarray, n: np.ndarray, order: int) -> WordRatios:
        """From the counts of grams of ``order`` characters and of shorter ones at the start of words."""
        keys, first, at = np.unique(_hashed(codes), return_index=True, return_inverse=True)
        grams = codes[first]
        contexts, context = np.unique(_hashed(_without_last(grams)), return_inverse=True)
        low, p, unseen = shared_estimates(grams, order), [], []
        for label in (0, 1):
            counts = np.bincount(at[toxic == label], n[toxic == label], len(keys)).astype(np.int64)
            share, left, _ = _discounted(counts, context)
            p.append(share + left[context] * low)
            unseen.append(left)
        return cls(order, keys, np.log(p[1] / p[0]), contexts, np.log(unseen[1] / unseen[0]))

    def ratios(self, words: list[str]) -> np.ndarray:
        """The ratio of each word (or piece of one)."""
        if not words:
            return np.zeros(0)
        padded = [padded_of(w) for w in words]
        size = np.fromiter(map(len, padded), np.int64, len(padded))
        codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
        begin = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(codes)) - begin
        # a piece that was cut at its front is judged from its first whole gram on
        whole = np.repeat(np.fromiter((1 if x[0] == "^" else self.order - 1 for x in padded), np.int64, len(padded)), size)
        ends = np.flatnonzero(place >= whole)
        gram = context = np.zeros(len(ends), np.uint64)
        for back in range(self.order - 1, -1, -1):
            inside = place[ends] >= back
            if not back:
                context = gram
            gram = np.where(inside, mix(gram, codes[np.maximum(ends - back, 0)]), gram)
        found = self._found(self.contexts, self.context_ratios, context)[0]
        own, known = self._found(self.grams, self.gram_ratios, gram)
        word = np.repeat(np.arange(len(padded)), size)[ends]
        return np.bincount(word, np.where(known, own, found), len(padded))

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(asked)), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        known = keys[at] == asked
        return np.where(known, values[at], 0.0), known

    def features(self, texts: list[str | None]) -> list[list[float]]:
        """Of each text: mean log-likelihood ratio a word; the share and mean excess of words that speak clearly for
        toxic; the three clearest of its different words. NaN for a text without words."""
        out, memory = [], self.memory
        split = [words_of(text, self.order) for text in texts]
        new = list({w for words in split for w in words}.difference(memory))
        for at in range(0, len(new), AT_ONCE):
            memory.update(zip(new[at : at + AT_ONCE], self.ratios(new[at : at + AT_ONCE]).tolist(), strict=True))
        for words in split:
            if not words:
                out.append([np.nan] * FEATURES)
                continue
            x = np.fromiter(map(memory.__getitem__, words), np.float64, len(words))
            top = np.sort(np.fromiter(map(memory.__getitem__, set(words)), np.float64))[:-4:-1]
            strong = np.maximum(x - CLEAR, 0.0)
            out.append(
                [
                    float(np.clip(x, -4.0, 12.0).mean()), float(min(1.0, 10 * (strong > 0).mean())), float(strong.mean()),
                    *np.minimum(12.0, top).tolist(), *[0.0] * (3 - len(top)),
                ]
            )
        if len(memory) > REMEMBERED:  # the words met first stay, being the common ones
            for w in new:
                del memory[w]
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}


@dataclass
class ToxicityModel:
    """The two languages and a regression on their features; ``rate`` is for texts that have none."""

    language: WordRatios | None
    weights: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    rate: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.language is None or not texts:
            return np.full(len(texts), self.rate)
        x = np.array(self.language.features(texts))
        p = 1 / (1 + np.exp(-np.clip((x - self.means) / self.scales @ self.weights[:-1] + self.weights[-1], -40, 40)))
        return np.where(np.isnan(p), self.rate, p)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Newton's method on the penalised likelihood; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, order: int = 6, sample_rows: int = 24_000, calibration: float = 0.25) -> ToxicityModel:
    """A model from ``labelled`` (doc_id, text, toxic 0/1); null labels teach nothing, null texts are empty.

    At most about ``sample_rows`` rows are used, drawn by a hash of doc_id: this bounds the tables of
    n-grams that reach the driver and the workers. A ``calibration`` share of them fits the
    regression, which must not see the texts that the language models have counted. These count a text once,
    however often it stands there; the regression counts repeated rows repeatedly. With one class only, the score
    is that class's rate everywhere.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    rows = labelled.where("toxic is not null").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), place.alias("place"))
    share = min(1.0, sample_rows / max(1, rows.count()))
    rows = written(rows.where(F.col("place") < share), "toxicity-sample")
    counting, rest = rows.where(F.col("place") >= share * calibration), rows.where(F.col("place") < share * calibration)
    counted = ngram_counts(word_counts(counting.dropDuplicates(["text", "toxic"]), order), order).toArrow()  # bounded by sample_rows
    language = WordRatios.of(code_points(counted.column("gram"), order), *(counted.column(c).to_numpy() for c in ("toxic", "n")), order)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            x = language.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = rest.select("text", "toxic").mapInArrow(featured, "x array<double>, toxic int").toPandas()  # bounded by sample_rows
    y = got["toxic"].to_numpy(float)
    rate = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    x = np.array(got["x"].tolist(), float).reshape(-1, FEATURES)
    x, y = x[has := ~np.isnan(x[:, 0])], y[has]
    if len(set(y)) < 2:
        return ToxicityModel(None, np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES), rate)
    means, scales = x.mean(0), x.std(0) + 1e-9
    return ToxicityModel(language, fit_logistic((x - means) / scales, y), means, scales, rate)


def score(docs: DataFrame, model: ToxicityModel, *keep: str | Column) -> DataFrame:
    """score (0 to 1) and predicted (1 from 0.5 up) of every whole text, after the kept columns.

    Null and empty texts, and others without words, get the share of toxic texts among those that fitted the
    regression. Only the text is looked at.
    """
    kept = docs.select(*keep, F.col("text").alias("__text"))
    spark, names = docs.sparkSession, kept.columns[:-1]
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by the sample that it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            p = shared.value.scores(batch.column(len(names)).to_pylist())
            own = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns as they were."""
    at, schema = docs.columns.index("text"), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample that it was fitted on

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(keep, schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the documents that have a label; a doc_id labelled twice counts twice."""
    return docs.select("doc_id", "text").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
