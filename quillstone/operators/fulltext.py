"""Ranked full-text search: TF-IDF weights, cosine scores.

The index is three tables: postings (term, key, tf) in files sorted by term, so that a query's terms prune
row groups; terms (term, df, idf); norms (key, norm). Building is two aggregations and a join by
term, in as many tasks as the texts have slices of some MB, so that a task's memory does not grow
with the input; no document or term list is gathered. A search sends the few query terms to all
tasks and aggregates by key.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_tokens, query_tokens, stemmed


#: Bytes of text whose words one task counts (its hash maps take some 20 times that), the least for which a core is
#: used, and the postings that such a slice has at most, roughly.
SLICE, LEAST, PAIRS = 8 << 20, 1 << 20, 750_000


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    terms: DataFrame
    norms: DataFrame
    key: str
    language: str


def measured(df: DataFrame, text: Column) -> tuple[int, int]:
    """Rows, and the slices to count their words in."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return rows, max(1, math.ceil(size / SLICE), min(math.ceil(size / LEAST), df.sparkSession.sparkContext.defaultParallelism))


def term_counts(df: DataFrame, key: str, text: Column, language: str, slices: int | None = None) -> DataFrame:
    """(term, key, tf); the slices are measured if they are not given."""
    slices = slices or measured(df, text)[1]
    # whole rows are dealt out by key, so words are counted where they stand; the outer explode infers no
    # filter on the words, which would analyse every text twice
    whole = df.select(F.col(key), text.alias("_text")).repartition(slices, key)
    words = whole.select(key, F.explode_outer(plain_tokens(F.col("_text"), language)).alias("term")).where(F.col("term").isNotNull())
    counted = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    if language in ("simple",):
        return counted
    # the exchange by term serves the distinct words and the join with their stems
    return stemmed(counted.repartition(slices, "term"), "term", language).repartition(slices, key).groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def inverse_frequencies(postings: DataFrame, total: int) -> DataFrame:
    """(term, df, idf = ln(N / df)); N counts all rows, those without words too."""
    return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(total)) / F.col("df")))


def document_norms(postings: DataFrame, terms: DataFrame, key: str, slices: int) -> DataFrame:
    weight = F.col("tf") * F.col("idf")
    if slices > postings.sparkSession.sparkContext.defaultParallelism:
        # given numbers of partitions are not put together again by their bytes, of which rows in memory are many times as many
        postings, terms = postings.repartition(slices, "term"), terms.repartition(slices, "term")
    return postings.join(terms, "term").groupBy(key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def build(df: DataFrame, key: str, text: Column, language: str = "spanish", path: str | None = None) -> TextIndex:
    """Build the index of a text expression; with a path, its tables are written there, each read from the one before."""
    total, slices = measured(df, text)
    return _indexed(term_counts(df, key, text, language, slices), total, slices, key, language, path)


def extended(old: TextIndex, fresh: DataFrame, text: Column, total: int, path: str) -> TextIndex:
    """The index with further rows: only these are analysed; weights and norms follow from all postings."""
    slices = measured(fresh, text)[1]
    counted = term_counts(fresh, old.key, text, old.language, slices)
    return _indexed(old.postings.unionByName(counted), total, slices + old.postings.count() // PAIRS, old.key, old.language, path)


def _indexed(postings: DataFrame, total: int, slices: int, key: str, language: str, path: str | None) -> TextIndex:
    spark = postings.sparkSession
    if path:
        # by hash: ranges would sample the words first, and so make them twice
        postings.repartition(slices, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
    terms = inverse_frequencies(postings, total)
    if path:
        terms.write.mode("overwrite").parquet(f"{path}/terms")
        terms = spark.read.parquet(f"{path}/terms")
    norms = document_norms(postings, terms, key, slices)
    if path:
        norms.write.mode("overwrite").parquet(f"{path}/norms")
        norms = spark.read.parquet(f"{path}/norms")
    return TextIndex(postings, terms, norms, key, language)


def opened(spark, path: str, key: str, language: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "norms")), key, language)


def scores(index: TextIndex, query: str) -> DataFrame:
    """(key, score) of the rows that share a weighted term with the query."""
    spark = index.postings.sparkSession
    tf = Counter(query_tokens(query, index.language))
    known = index.terms.where(F.col("term").isin(*tf)) if tf else index.terms.limit(0)
    weight = {r["term"]: tf[r["term"]] * r["idf"] for r in known.where("idf > 0").collect()}  # a row per word of the query
    length = math.sqrt(sum(w * w for w in weight.values()))
    rows = [(t, float(w), w / tf[t]) for t, w in sorted(weight.items())]
    asked = spark.createDataFrame(rows, "term string, q_weight double, q_idf double")
    hits = index.postings.where(F.col("term").isin(*weight) if weight else F.lit(False)).join(F.broadcast(asked), "term")
    summed = hits.groupBy(index.key).agg(F.sum(F.col("q_weight") * F.col("tf") * F.col("q_idf")).alias("dot"))
    scored = summed.join(index.norms, index.key)
    return scored.select(index.key, F.when(F.col("norm") > 0, F.col("dot") / (F.col("norm") * F.lit(length or 1.0))).otherwise(0.0).alias("_text_score"))


def search(df: DataFrame, index: TextIndex, query: str, limit: int | None = None) -> DataFrame:
    """The matching rows of df with _text_score, best first, ties by key."""
    found = df.join(scores(index, query), index.key).orderBy(F.desc("_text_score"), index.key)
    return found if limit is None else found.limit(limit)
