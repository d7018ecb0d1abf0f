"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi_media, best_fit_packing, byte_bpe, ngram_join, pii_disclosure, quality_classifier, quality_rules, secret_scan, substring_dedup, warc_archive
from .runtime import Scratch, table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    place = Scratch(spark, "warc").root
    warc_archive.write_archive(pages, place)
    read = warc_archive.read_archive(spark, place)
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(spark, table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=0, capacity=2048)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_disclosure.find(table(spark, sf_dir, "documents"), least_together=1, with_text=True)
    return found.withColumn("sanitised_sha256", F.sha2("sanitised", 256)).drop("text_key", "sanitised")


def op5_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_media.media_digests(avi_media.media_column(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, public_tokenizers.PATTERN, digests=True)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(secret_scan.labelled_findings(spark)))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"), s["sha256"])), ",")
    return found.select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_pii_disclosure": op4_pii_disclosure,
    "op5_avi_media": op5_avi_media,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_secret_scan": op10_secret_scan,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL of the queries that SQL can express, from the plain definitions.
ORACLE: dict[str, str] = {
    "op1_warc_archive": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last, sha1(h) AS d FROM p)
        SELECT page_id, strlen(h) AS payload_bytes, url,
          array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
          CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g
    """,
    "op3_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
        m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id
    """,
    "op8_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
        x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM x),
        f AS (SELECT g, min(doc_id) AS d FROM g GROUP BY g),
        c AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE f.d < g.doc_id),
        r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
        SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
          sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [y FOR y, k IN w IF NOT list_contains(gone, k)] END, ' ')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
    """,
}
