"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import fold
    from tidemark.llm.language_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    return identify(docs, train(docs.where(~held_out)), "doc_id", held_out.alias("held_out"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import fold
    from tidemark.llm.toxicity import labelled, score, train

    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    return score(docs, train(labelled(docs, _table(spark, sf_dir, "labels")).where(~held_out)), "doc_id", held_out.alias("held_out"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import scan

    return scan(_table(spark, sf_dir, "documents")).drop("text_hash", "value")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import scratch_path
    from tidemark.llm.token_store import read_documents, write_tokens
    from tidemark.llm.tokens import default_tokenizer

    path = scratch_path(spark, "token-store")
    write_tokens(_table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=2)
    return read_documents(spark, path, digest_only=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack
    from tidemark.llm.tokens import default_tokenizer

    return pack(_table(spark, sf_dir, "documents"), default_tokenizer(), capacity=4096, end_id=1)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.interpolated_lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op10_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ball_tree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=10, query_every=100)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lexical_search import search

    return search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=20)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.alignment import align, default_tokenizers

    return align(_table(spark, sf_dir, "documents"), *default_tokenizers())


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import find, train

    docs = _table(spark, sf_dir, "documents")
    return find(docs, train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_store": op5_token_store,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_interpolated_lm": op9_interpolated_lm,
    "op10_ball_tree": op10_ball_tree,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_pii": op13_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op10_ball_tree": """
        WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id,
                          CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row AND len(q.e) = len(c.e))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM p QUALIFY rank <= 10""",
    "op11_lexical_search": r"""
        WITH split AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
             docs AS (SELECT doc, doc_id, t, len(t) AS n FROM split WHERE len(t) > 0),
             total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
             held AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM docs) GROUP BY ALL),
             weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term, n_docs),
             items AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
             asked AS (SELECT item, item_id, term, count(*) AS repeats FROM (SELECT item, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
             scored AS (SELECT item, item_id, doc, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
                        FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN docs USING (doc), total GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20""",
}
