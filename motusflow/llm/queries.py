"""The registered queries of this subpackage: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from .common import table as _table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(importable(spark), sf_dir, name)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import read_tokens, write_tokens

    out = write_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), good)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import digest

    return digest(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compared

    return compared(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predicted

    return predicted(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_lexicon import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import spans

    return spans(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.vec_id
), g AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
SELECT g.vec_id, coalesce(n.n_links, 0) AS n_links, g.component_id, g.vec_id = g.component_id AS kept
FROM g LEFT JOIN n ON n.vec_id = g.vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_best_fit_packing,
            op2_lm_scoring,
            op3_minhash_near_dedup,
            op4_license_scan,
            op5_embedding_near_dedup,
            op6_document_fingerprints,
            op7_language_id,
            op8_bpe_codec,
            op9_pii,
            op10_token_output,
        )
    } | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .license_scan import digest_sql

    return {"op4_license_scan": digest_sql(), "op5_embedding_near_dedup": OP5_SQL}
