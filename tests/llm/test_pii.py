"""Personal data: patterns against plain ones, the tagger's gradients, its held-out accuracy, and rows of all kinds."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import pii

DOCS = "doc_id long, text string, spans string, n_ip long"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(int(d) if n % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for n, d in enumerate(digits[::-1]))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_are_the_plain_ones():
    r = random.Random(4)
    pieces = ["4111111111111111", "5500 0055 5555 5559", "37-8282246310005", "+1 (269) 555-3296", "a.b@c.de", "x@y", "@", "..", "1.2.3.4", "999.1.1.1", "é", " ", "-", "+", "(", ")", ".", "%", "0", "00012.0.0.1", "b@c-d.e.f@g.h", "日本"]
    hits = 0
    for n in range(3000):
        text = "".join(r.choice(pieces) if r.random() < 0.6 else r.choice("0123456789.@+- ()ab_") for _ in range(r.randrange(1, 14)))
        got = pii.base_spans(text)
        assert got == plain_spans(text), text
        hits += len(got)
    assert hits > 1000


def test_long_runs_take_no_square_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "+" + "1 " * 100_000):
        assert all(b > a for a, _, b in pii.base_spans(text))


def test_gradients():
    tagger, r = pii.Tagger.new(6, 5), np.random.default_rng(0)
    tagger.weights = {k: w.astype(np.float64) for k, w in tagger.weights.items()}
    chars = r.integers(0, 131, (3, 12)).astype(np.int32)
    tags = np.stack([pii.tags_of(12, [(2, 1, 5), (5, 0, 8)]), pii.tags_of(12, [(0, 2, 4)]), pii.tags_of(12, [])])
    _, grads = tagger.loss(chars, tags)
    for name, w in tagger.weights.items():
        at = (chars[0, 3], 2) if name == "chars" else tuple(r.integers(0, n) for n in w.shape)
        was, sides = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = was + step
            sides.append(tagger.loss(chars, tags)[0])
        w[at] = was
        assert abs((sides[0] - sides[1]) / 2e-3 - grads[name][at]) < 1e-4


def test_tags_and_spans():
    spans = [(0, 0, 4), (4, 0, 6), (7, 3, 8)]
    assert pii.spans_of(pii.tags_of(10, spans)) == spans
    assert pii.stretches("") == [] and pii.stretches("no digits") == []
    assert pii.codes("aé\U0001f600").tolist() == [98, 129, 130]


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0"))


def test_what_the_patterns_miss(tagger):
    """Held-out values in known and in other forms: found where they stand, and plain numbers left alone."""
    r, texts, want = np.random.default_rng(77), [], []
    for _ in range(300):
        kind = int(r.integers(4))
        value = pii._value(kind, r, [])
        texts.append("garden letters of the river " + value + " under a stone bridge")
        want.append((28, kind, 28 + len(value)))
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(texts, base, tagger)
    missed = [w for w, b in zip(want, base, strict=True) if w not in b]
    assert len(missed) > 80
    assert np.mean([w in a for w, a, b in zip(want, added, base, strict=True) if w not in b]) > 0.9
    calm = ["the river of " + pii._plain(r) + " under stone" for _ in range(300)]
    assert sum(map(len, pii.added_spans(calm, [pii.base_spans(t) for t in calm], tagger))) <= 3


def test_values_that_touch(tagger):
    text = "reach +1 (269) 555-3296 4524132264652876 or 27.204.213.132 4116106959541135 now"
    assert pii.joined(sorted(pii.base_spans(text) + pii.added_spans([text], [pii.base_spans(text)], tagger)[0])) == "phone:6:23,card:24:40,ip:44:58,card:59:75"
    long = " ".join([text] * 40)  # one stretch of many windows
    found = sorted(pii.base_spans(long) + pii.added_spans([long], [pii.base_spans(long)], tagger)[0])
    assert len(found) >= 156 and all(a[2] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_rows_of_all_kinds(spark, tagger):
    texts = [None, "", "nothing here", "mail a.b@c.de and a.b@c.de", "é日本 1.2.3.4 é", "word " * 30_000 + "+1 (269) 555-3296", "7" * 5000, "[at] (dot)", "@", "1"]
    docs = spark.createDataFrame([(k, t, "x", 3) for k, t in enumerate(texts)] + [(3, texts[3], "y", 4), (None, "1.2.3.4", None, None)], DOCS)
    got = pii.find(docs, tagger).collect()
    assert len(got) == docs.count()
    for r in got:
        base = plain_spans(texts[r.doc_id] or "" if r.doc_id is not None else "1.2.3.4")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert {pii.joined([s]) for s in base} <= set(r.spans.split(","))
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)
    assert pii.find(docs.limit(0), tagger).isEmpty()


def test_training_on_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    tagger = pii.train(empty, made_windows=64, epochs=1)
    assert pii.find(empty, tagger).isEmpty()
    assert pii.find(spark.createDataFrame([(1, "a@b.cd", None, None)], DOCS), tagger).first().spans == "email:0:6"
