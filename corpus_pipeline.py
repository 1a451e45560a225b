"""The corpus pipeline: classify, clean lines, drop near copies, mix sources, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of documents. run() applies them to documents, writing each result to
shared storage, so that a lost executor costs one stage at most.

Cases: documents with null or empty texts are classified by their one empty line; null ids come last where
order matters; repeated ids with other texts are separate documents throughout, repeated rows are copies of
each other (one stays); null sources are a source of their own; columns other than those of
documents are dropped by the first stage; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import line_dedup, mixing
from quillstone.llm.line_crf import keep_good
from quillstone.llm.packing import pack
from quillstone.llm.shingle_join import one_of_each_similar
from quillstone.llm.storage import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: Jaccard of at least 0.8 over shingles of five words. Fingerprints within three bits are candidates;
#: pairs that differ by more, which at 0.8 most do, are completed by rare shingles.
WIDTH, BITS, SIMILAR = 5, 3, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the line classifier takes for good."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out every line that an earlier line matches."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS), min_words=1)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, keep the document with the smallest id."""
    return one_of_each_similar(docs.select(*COLUMNS), width=WIDTH, threshold=SIMILAR, bits=BITS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that all sources have equal expected shares."""
    return mixing.mix(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with the ids' checksum."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", copies), ("mixing to target weights", mixture), ("packing", packed)]
#: A fitted classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs, f"pipeline-{k}") if k + 1 < len(STAGES) else docs
    return docs
