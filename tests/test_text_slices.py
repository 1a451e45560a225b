"""Words are counted in as many tasks as the texts have slices, whatever spark.sql.shuffle.partitions says."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstone import registry
from quillstone.sources.scratch import shared_dir

WORDS = 600_000


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """40 texts, 36 MB: the word "the" and 14,999 long words each, of which there are 26."""
    d = str(tmp_path_factory.mktemp("slices"))
    long = F.transform(F.sequence(F.lit(1), F.lit(WORDS // 40 - 1)), lambda i: F.repeat(F.char(F.lit(97) + (i + F.col("id")) % 26), 60))
    text = F.concat(F.lit("the "), F.array_join(long, " "))
    spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")).write.parquet(f"{d}/documents.parquet")
    return d


def _postings(spark) -> set[Path]:
    return set(Path(shared_dir(spark).removeprefix("file://")).glob("text-*/postings/*.parquet"))


@pytest.mark.parametrize("name", ["fulltext_virtual", "fulltext_all", "text_norms", "fulltext_topk"])
def test_an_index_is_built_in_slices(spark, texts, name):
    had, most = _postings(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = registry.QUERIES[name](spark, texts).collect()
    made = _postings(spark) - had
    assert len(made) > most  # files of five slices; two words may share one
    index = spark.read.parquet(*map(str, made))
    assert index.count() == 40 * (28 if name == "fulltext_virtual" else 27)
    assert index.agg(F.sum("tf")).first()[0] == WORDS + 40 * (name == "fulltext_virtual")
    assert len(rows) == {"text_norms": 40}.get(name, 0)  # a word of all texts weighs nothing


def test_frequencies_are_counted_in_slices(spark, texts):
    slices = int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    tf = registry.text_tf(spark, texts)
    assert tf.rdd.getNumPartitions() >= slices
    assert tf.agg(F.count("*"), F.sum("tf")).first() == (40 * 27, WORDS)


def test_inverse_frequencies_are_counted_in_slices(spark, texts):
    df = registry.text_df_idf(spark, texts)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert int(re.search(r"RepartitionByExpression \[doc_id#\d+L\], (\d+)", plan)[1]) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {tuple(r)[1:] for r in df.collect()} == {(40, 0.0)} and df.count() == 27
