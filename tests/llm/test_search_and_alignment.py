"""Lexical search and cross-tokenizer alignment against brute force, with nulls, odd and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import alignment, lexical_search

DOCS = "doc_id long, text string, lang string, item_id string, term string, doc long"
ODD = [
    "  two  spaces ", "tab\there", "line\n\nbreaks \n here", "\n", " ", "", None, "É à ß ſ İ ΣΑΣ 日本語 ünï", "x<|endoftext|>y <s> </s> <unk> [CLS]", "a▁b ▁", "nul\x00byte", "bell\x07 esc\x1b",
    "no\xa0break thin space ideo　graphic ﻿bom ​zero", "emoji 👩‍👩‍👧 flags 🇩🇪", "é combining ẛ̣", "DON'T can't 12.5% 1,000 --- ...", "\r\nwindows\r\n", "word" * 60, " line \u0085next",
]
WORDS = "the of river stone cloud paper light green seven under along winter market bridge silver garden letter window people number".split()


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "x", "y", 1) for k, t in enumerate(texts)], DOCS)


# ---- 11

def brute_search(items, docs, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(split(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n_docs, n_terms, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_is_brute_force(spark, k):
    rare = [f"w{j}" for j in range(60)]
    texts = [prose(i, random.Random(i).randrange(3, 90), WORDS * 6 + rare) for i in range(150)]
    texts += texts[:4] + [texts[5].upper()] + ODD + [prose(9, 9000, WORDS + rare), "silver"] * 2
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id in (3, 4)")).unionByName(frame(spark, ["river silver w3"]).selectExpr("cast(null as long) doc_id", "text", "lang", "item_id", "term", "doc"))
    asked = [("a", prose(1, 12)), ("b", prose(2, 30, WORDS + rare)), ("c", "w1 w2 w2 w3 the the of"), ("c", "silver w3"), ("d", None), ("e", ""), (None, "W7 É 日本語 river"), ("f", "nowhere"), ("g", texts[7])]
    items = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id string, text string, doc_id long")
    got = sorted(map(tuple, lexical_search.search(items, docs, k).collect()), key=repr)
    want = brute_search(asked, [(r.doc_id, r.text) for r in docs.collect()], k)
    assert [(i, r, s) for i, r, _, s in got] == [(i, r, s) for i, r, _, s in want]
    assert got == want


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, ["one two"]), spark.createDataFrame([("a", "one")], "item_id string, text string")
    assert lexical_search.search(items.limit(0), docs).isEmpty()
    assert lexical_search.search(items, docs.limit(0)).isEmpty()
    assert lexical_search.search(items, frame(spark, [None, "", "..."])).isEmpty()


# ---- 12

@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.default_tokenizers())


def whole_tokens(pair, text):
    """Both tokenizers over the whole text, as (id, end) lists; none if either alters it."""
    want, out = (" " + (text or "")).encode(), []
    for ids, parts in ((pair.a.encode(" " + (text or ""), add_special_tokens=False).ids, pair.a_bytes), (pair.b.encode(text or ""), pair.b_bytes)):
        if not text or b"".join(parts[i] for i in ids) != want:
            return None
        out.append(list(zip(ids, itertools.accumulate(len(parts[i]) for i in ids), strict=True)))
    return out


def brute_alignment(pair, rows):
    found = [(d, whole_tokens(pair, t)) for d, t in rows]
    linked = [[(a, b) for a, end in ab[0] for b, other in ab[1] if end == other] if ab else [] for _, ab in found]
    count = Counter(x for own in linked for x in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for (d, ab), own in zip(found, linked, strict=True):
        if not ab:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        text, last = [], 0
        for end in sorted({e for _, e in ab[0]} & {e for _, e in ab[1]}):
            text.append("|".join(",".join(str(i) for i, e in side if last < e <= end) for side in ab))
            last = end
        sha = hashlib.sha256(";".join(text).encode()).hexdigest()
        out.append((d, len(ab[0]), len(ab[1]), len(text), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent_pairs", [5, 200_000])
def test_alignment_is_brute_force(spark, pair, frequent_pairs):
    texts = ODD + [f"{a}{b}" for a, b in itertools.product(ODD[:6], ODD[7:12])] + [prose(k, 40) + ".\nNew Line, (quoted) 'text' 2024-05-06" for k in range(12)]
    docs = frame(spark, texts + [prose(5, 3000, ["ab c d", "ef", "ghi,", "Überzeugung", "naïve"])] + texts[-3:])
    docs = docs.unionByName(docs.where("doc_id = 50")).unionByName(docs.where("doc_id = 60").selectExpr("cast(null as long) doc_id", "text", "lang", "item_id", "term", "doc"))
    got = alignment.align(docs, *alignment.default_tokenizers(), frequent_pairs=frequent_pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_alignment(pair, [(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.align(docs.limit(0), *alignment.default_tokenizers()).isEmpty()


def test_words_are_tokenised_as_in_their_text(spark, pair):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 4000").select("text").limit(150).collect()
    texts = [r.text or "" for r in rows] + [o or "" for o in ODD]
    for text, got in zip(texts, pair.tokens(texts), strict=True):
        want = whole_tokens(pair, text)
        assert (got is None) == (want is None)
        if want:
            assert [list(zip(got[k].tolist(), got[k + 1].tolist(), strict=True)) for k in (0, 2)] == want


def test_new_words_are_encoded_together_and_altered_ones_apart(pair, monkeypatch):
    class Altering:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def encode(self, text, **options):
            self.calls += 1
            change = lambda t: t.replace("alter", "other")
            return self.model.encode(change(text) if isinstance(text, str) else list(map(change, text)), **options)

    monkeypatch.setattr(pair, "b", Altering(pair.b))
    assert None not in list(pair.tokens([prose(k, 30, [f"new{k}x{j}" for j in range(20)]) for k in range(20)]))
    assert pair.b.calls == 1
    texts = [f"plain{k} {'e' * k}x" for k in range(9)] + ["", "it will alter3 this", "ne\u0301e later", "alter4", "x\nlater", "last"]
    found = [x and [list(zip(x[k].tolist(), x[k + 1].tolist(), strict=True)) for k in (0, 2)] for x in pair.tokens(texts)]
    assert [k for k, x in enumerate(found) if x is None] == [9, 10, 12]
    assert found == [whole_tokens(pair, t) for t in texts]


def test_a_document_is_grouped_without_interpreted_functions(spark, pair, monkeypatch):
    plans, put = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or put(df, name))
    assert alignment.align(frame(spark, ["one two", None]), *alignment.default_tokenizers()).count() == 2
    assert "MapInArrow" in plans[0]
    assert not any("lambdafunction" in p or "array_intersect" in p for p in plans)
