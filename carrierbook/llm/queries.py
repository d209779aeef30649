"""The registered queries of the operators: production parameters, whole tables, and their SQL.

Encoding, similarity, secrets, quality, the classifier, personal data, packing and page text have no
SQL counterpart (vocabulary files, reachability over quadratic pairs, fitted or corpus-wide rules);
tests compare them with brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierbook.llm import bpe, exact_dedup, gam, html_text, lexical_search, ngram_join, packing, periodic_runs, pii, quality, secret_scan, toxicity, warc
from carrierbook.llm.common import pin, table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similarity_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = pin(warc.write(table(spark, sf_dir, "pages"), least_bytes=0))
    records = pin(warc.read(archives, with_payload=False))
    return warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_rows(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.score(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_rows(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), periodic_runs.planted_period)
    return found.drop("runs")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_ngram_join, op3_html_text, op4_warc, op5_secrets, op6_quality, op7_classifier,
                            op8_pii, op9_packing, op10_exact_dedup, op11_toxicity,
                            op12_lexical_search, op13_periodic_runs, pipeline)}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, strlen(html) AS size, sha1(html) AS hex,
                     max(page_id) OVER (PARTITION BY html) AS response_id FROM p),
        b AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(hex, CAST(5 * k + 1 AS INT), 5) AS BIGINT)) AS fives FROM d)
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((fives[CAST(i // 4 + 1 AS INT)] >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response_id THEN response_id END AS refers_to
        FROM b
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                          regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS normal FROM documents),
        g AS (SELECT doc_id, normal, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
                     count(*) OVER (PARTITION BY normal) AS group_size
              FROM d WINDOW w AS (PARTITION BY normal ORDER BY size DESC, doc_id))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(normal) AS text_sha256 FROM g
    """,
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
        sized AS (SELECT k, doc_id, found, len(found) AS n FROM d WHERE len(found) > 0),
        whole AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM sized),
        post AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(found) AS term FROM sized) GROUP BY k, term),
        weight AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w
                   FROM post, whole GROUP BY term, big_n),
        q AS (SELECT row_number() OVER () AS i, item_id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM benchmark),
        asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(found) AS term FROM q) GROUP BY i, item_id, term),
        norm AS (SELECT k, doc_id, 75 + (25 * n * big_n) // big_l AS m FROM sized, whole),
        scored AS (SELECT i, item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score
                   FROM asked JOIN weight USING (term) JOIN post USING (term) JOIN norm USING (k)
                   WHERE doc_id IS NOT NULL GROUP BY i, item_id, k, doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE r <= 20
    """,
}
