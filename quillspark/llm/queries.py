"""The queries of this package's operators, each over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, iblt, licenses, linededup, media, mixing, pii, quality, simhash, warc
from .common import documents


def tokenizer_path() -> str:
    """The public vocabulary's file, the same on all workers; QUILLSPARK_TOKENIZER names another."""
    if path := os.environ.get("QUILLSPARK_TOKENIZER"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pii_key(spark: SparkSession) -> bytes:
    """The key of surrogates: quillspark.pii.key of the session, in hex. Where none is set, one is drawn and set, so that a session's results agree."""
    told = spark.conf.get("quillspark.pii.key", None)
    if not told:
        told = secrets.token_hex(32)
        spark.conf.set("quillspark.pii.key", told)
    return bytes.fromhex(told)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iblt.fingerprints(documents(spark, sf_dir))
    return out.select(*out.columns[:8], *[F.size(c).cast("long").alias(f"n_{c}") for c in out.columns[8:]])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return out.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        warc.page_number(F.col("response.refers_to")).alias("refers_to"),
        (F.lit(1) + F.col("request").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")).alias("n_records"),
        F.regexp_extract(F.col("metadata.fields").cast("string"), "payloadSha1Hex: ([0-9a-f]+)", 1).alias("metadata_digest"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(documents(spark, sf_dir), pii_key(spark))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to, 3::INT AS n_records, payload_digest AS metadata_digest
FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_media_columns, op2_quality, op3_fingerprints, op4_warc, op5_bpe, op6_simhash, op7_pii, op8_licenses, op9_mixing, op10_line_dedup)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC_SQL, "op9_mixing": mixing.SQL, "op10_line_dedup": linededup.SQL}
