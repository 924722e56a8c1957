"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters become hashed n-grams of one to three; a text's weight for an n-gram is its share of the
text's n-grams times the n-gram's inverse document frequency over all training documents. The
classifier is trained by follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) in
parallel copies that are averaged after every round, and its scores are calibrated by one temperature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_slices, written

UNDETERMINED = "und"


def ngram_buckets(text: str, dims: int) -> np.ndarray:
    """Buckets of all character 1-, 2- and 3-grams of the lower-cased text, runs of white space as one blank."""
    chars = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), np.uint32)
    one = chars * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (chars[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (chars[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    return np.concatenate([one, two, three]) >> shift


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text[64:])


@dataclass
class LanguageModel:
    """langs, idf (a weight a bucket), weights (buckets x langs), bias and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at = ngram_buckets(text, len(self.idf))
        return self._by_idf()[at].sum(0, dtype=np.float64) / max(1, len(at)) + self.bias

    def _by_idf(self) -> np.ndarray:
        if not hasattr(self, "_scaled"):
            self._scaled = np.ascontiguousarray((self.idf[:, None] * self.weights).astype(np.float32))
        return self._scaled

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; texts without letters are ``und`` at 0."""
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        return self.langs[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def document_frequencies(docs: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of documents and, by bucket, of those that hold it. At most ``dims`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                held = np.zeros(dims, bool)
                held[ngram_buckets(text or "", dims)] = True
                total += held
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(dims + 1, np.int64)
    df[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return int(df[-1]), df[:-1]


class Ftrl:
    """Follow-the-regularised-leader with elastic-net penalties, a row of classes a bucket."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax((x[:, None] * w).sum(0)[None])[0]
        p[y] -= 1
        g = x[:, None] * p[None]
        n = self.n[at]
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def _vector(text: str, idf: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and scaled TF-IDF weights; the last bucket is the constant of the bias."""
    at = ngram_buckets(text, len(idf))
    buckets, counts = np.unique(at, return_counts=True)
    return np.append(buckets, len(idf)), np.append(scale * counts * idf[buckets] / max(1, len(at)), 1.0)


def _learner(z: np.ndarray, g: np.ndarray, turn: int, idf: np.ndarray, scale: float, code: dict[str, int], rates: tuple):
    """One round of one copy: it starts from the shared state and goes over its rows in random order."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(z.copy(), g.copy(), *rates)
        for k in np.random.default_rng(turn).permutation(len(pdf)):
            model.step(*_vector(pdf["text"].iat[k], idf, scale), code[pdf["lang"].iat[k]])
        return pd.DataFrame({"z": [model.z.astype("<f4").tobytes()], "n": [(model.n - g).astype("<f4").tobytes()]})

    return learn


def sample_by_language(rows: DataFrame, sample_rows: int, least_rows: int) -> DataFrame:
    """``text, lang, place`` of about ``sample_rows`` of ``rows`` (doc_id, text, lang), drawn by a hash of doc_id: of each
    language its share of them, but ``least_rows`` (or all it has) at least, so that every language is learnt
    however rare it is. place, from 0 to 1, is the row's place in its language's sample."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total = counts.agg(F.count("*").alias("languages"), F.sum("n").alias("n")).first()
    share = F.greatest(F.lit(sample_rows / max(1, total["n"] or 0)), least_rows / F.col("n"))
    quota = counts.select("lang", F.least(F.lit(1.0), share).alias("share"))
    few = total["languages"] <= 10_000  # else the table is no small one, and Spark chooses
    return rows.join(F.broadcast(quota) if few else quota, "lang").select("text", "lang", (place / F.col("share")).alias("place")).where("place < 1")


def train(docs: DataFrame, dims: int = 1 << 15, sample_rows: int = 3000, least_rows: int = 200, copies: int = 4, rounds: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, scale: float = 8.0) -> LanguageModel:
    """A model from ``docs`` (doc_id, text, lang); rows with a null text or lang teach nothing.

    Document frequencies come from all rows. The classifier is fitted on about ``sample_rows`` rows, and on ``least_rows``
    of each language or all that it has; its temperature on others, a fifth of that number. No usable row: a
    model that knows no language. One language: always that one.
    """
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    n, df = document_frequencies(rows, dims)
    idf = np.where(df > 0, np.log((1.0 + n) / (1.0 + df)) + 1.0, 0.0)
    taught = written(sample_by_language(rows, round(1.2 * sample_rows), round(1.2 * least_rows)), "language-sample")
    langs = [r["lang"] for r in taught.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return LanguageModel([], idf, np.zeros((dims, 0)), np.zeros(0))
    code, own = {x: k for k, x in enumerate(langs)}, len(langs)
    fit, rest = taught.where(F.col("place") < 1 / 1.2), taught.where(F.col("place") >= 1 / 1.2)
    z, g = np.zeros((dims + 1, own)), np.zeros((dims + 1, own))
    for turn in range(rounds):
        learn = _learner(z, g, turn, idf, scale, code, (alpha, beta, l1, l2))
        back = fit.withColumn("copy", F.floor(F.col("place") * copies * 1.2)).groupBy("copy").applyInPandas(learn, "z binary, n binary").collect()
        if back:
            read = lambda x: np.frombuffer(x, "<f4").reshape(dims + 1, own).astype(np.float64)
            z, g = np.mean([read(r["z"]) for r in back], 0), g + np.mean([read(r["n"]) for r in back], 0)
    w = Ftrl(z, g, alpha, beta, l1, l2).weights()
    model = LanguageModel(langs, idf, scale * w[:-1], w[-1])
    model.temperature = _temperature(rest, model, code)
    return model


def _temperature(rows: DataFrame, model: LanguageModel, code: dict[str, int]) -> float:
    """The temperature at which the rows' true languages are likeliest, by golden-section search of its log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            x = [model.logits(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "lang"])

    got = rows.select("text", "lang").mapInArrow(run, "x array<double>, lang string").toPandas()  # bounded: a fifth of sample_rows
    if got.empty:
        return 1.0
    x, y = np.stack(got["x"].to_numpy()), got["lang"].map(code).to_numpy()

    def loss(t: float) -> float:
        return -np.log(softmax(x / math.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    lo, hi, cut = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def identify(docs: DataFrame, model: LanguageModel, *keep: str | Column) -> DataFrame:
    """lang_pred and score (0 to 1) of every whole text, after the kept columns.

    Null texts and texts without a letter are ``und`` with score 0; nothing but the text is looked at.
    """
    kept = docs.select(*keep, "text")
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [model.predict(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(len(names))), pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                names=[*names, "lang_pred", "score"],
            )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
