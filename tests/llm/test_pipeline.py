"""The pipeline's stages against plain checks of what must go and what must stay."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, simhash_dedup
from tidemark.llm.common import written

SF = "/root/testdata/sf0.01"


def similar_pairs(rows):
    """doc_id -> {doc_id: Jaccard similarity over five words} of rows that share any five."""
    sets = {r.doc_id: frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) > 4 else frozenset([tuple(w)]) for r in rows for w in [(r.text or "").lower().split()]}
    holders, out = defaultdict(set), defaultdict(dict)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    for d, s in sets.items():
        for other in {o for x in s if len(holders[x]) < 400 for o in holders[x]} - {d}:
            out[d][other] = len(s & sets[other]) / len(s | sets[other])
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, stages):
    assert [n for n, *_ in stages] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    _, before, after = stages[0]
    gone = before.join(after.select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id")
    kept = after.join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 0.02 * before.count()
    assert kept.where("toxic = 1").count() <= 0.25 * before.join(labels, "doc_id").where("toxic = 1").count()
    _, before, after = stages[1]
    assert after.select("text").distinct().count() == after.count() > 0.8 * before.count()
    kept, alike = {r.doc_id for r in after.collect()}, similar_pairs(before.collect())
    gone = {r.doc_id for r in before.collect()} - kept
    assert all(any(j >= 0.8 for j in alike[d].values()) for d in gone)  # nothing goes without a text like it
    assert not [(a, b) for a in kept for b, j in alike[a].items() if b in kept and j >= 0.8]
    _, before, after = stages[2]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    has = F.lit(False)
    for x in items:
        has = has | F.col("text").contains(x)
    assert after.where(has).isEmpty() and not before.where(has).isEmpty()
    _, before, after = stages[3]
    secret = r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{16}|token = .[0-9a-f]{40}"
    assert after.where(F.col("text").rlike(secret)).isEmpty() and not before.where(F.col("text").rlike(secret)).isEmpty()
    assert after.count() == before.count()
    changed = after.alias("a").join(before.alias("b"), "doc_id").where("a.text <> b.text")
    assert changed.where(~F.col("b.text").rlike(secret)).isEmpty()
    _, before, after = stages[4]
    assert after.select("doc_id").distinct().count() == before.count()


def test_registered_queries():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, len(queries.QUERIES) + 1)] and len(queries.QUERIES) >= 13


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert docs.isEmpty()


def test_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (2, "", "en", "s", 0), (3, " ".join(random.Random(1).choices(["stone", "river", "light"], k=30000)), "en", "s", 1), (4, "one", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
    assert {r.doc_id for r in docs.collect()} >= {1, 3, 4}


def test_likely_texts(spark):
    """All texts that are wanted pass before the shuffle, and few others."""
    rows = spark.range(40_000).selectExpr("id AS doc_id", "xxhash64(id) AS text_hash", "'x' AS text")
    wanted = rows.where("doc_id % 7 = 0").select("doc_id", "text_hash")
    got = simhash_dedup._likely(rows, wanted)
    assert got.columns == rows.columns
    assert got.join(wanted, ["doc_id", "text_hash"]).count() == wanted.count()
    assert got.count() < wanted.count() + 0.1 * 40_000
    assert simhash_dedup._likely(rows, wanted.where("false")).isEmpty()


def test_candidates_are_listed_once(spark, monkeypatch):
    """Texts that are not quite alike share several bands, and are compared once."""
    seen, alike = [], simhash_dedup._alike
    monkeypatch.setattr(simhash_dedup, "_alike", lambda pairs, *more: seen.append(pairs) or alike(pairs, *more))
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(w if k % 12 != i or k > 200 else f"{w}x{i}" for k, w in enumerate(base)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    simhash_dedup.similar_groups(docs, 0.8).collect()
    last = seen[-1]
    assert last._jdf.queryExecution().analyzed().nodeName() != "Distinct"
    assert last.count() == last.distinct().count()
