"""One query per dealt operator over its whole table, and the DuckDB statements that check them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, caps, intervals, jaccard, language, packing, preference, resample, substring, topk, toxicity, trie, warc
from tidegate.llm.common import start, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(start(spark), sf_dir, "documents"), VOCABULARY)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(start(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.digests(preference.neighbours(table(spark, sf_dir, "conversations")))


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(start(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(start(spark), sf_dir, "documents"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(start(spark), sf_dir, "documents")
    return bpe.digests(docs, VOCABULARY, bpe.build_lexicon(docs, VOCABULARY))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near(table(start(spark), sf_dir, "embeddings"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(start(spark), sf_dir, "documents"))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(start(spark), sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(start(spark), sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(start(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(start(spark), sf_dir, "conversations"))


def op13_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.digests(table(start(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_preference": op3_preference,
    "op4_maxscore": op4_maxscore,
    "op5_substring_rlz": op5_substring_rlz,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_cap_filters": op7_cap_filters,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_warc_revisit": op9_warc_revisit,
    "op10_language_id": op10_language_id,
    "op11_resample": op11_resample,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_interval_expansion": op13_interval_expansion,
}
ORACLES: dict[str, str] = {
    "op3_preference": preference.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op9_warc_revisit": """
        WITH p AS (
            SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
        ), t AS (
            SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM t""",
}
