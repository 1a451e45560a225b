"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing
from .language_model import interpolated_scores
from .line_crf import classify
from .nearest import nearest
from .packing import pack
from .quality_rules import rules
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .warc import read_records, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), min_words=1)


QUERIES = {"op3_quality_rules": op3_quality_rules, "op5_simhash": op5_simhash, "op8_language_model": op8_language_model, "op4_packing": op4_packing, "op7_suffix_dedup": op7_suffix_dedup, "op6_line_crf": op6_line_crf, "op9_warc": op9_warc, "op10_mixing": op10_mixing, "op2_nearest": op2_nearest, "op1_line_dedup": op1_line_dedup}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op9_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
    CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
""",
    "op10_mixing": mixing.SQL,
}
