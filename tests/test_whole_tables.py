import math
from pathlib import Path

from quillstone import registry


def test_text_queries_read_all_languages(spark, tmp_path):
    rows = [(1, "the red fox", "en", "a"), (2, "le renard rouge le", "fr", "a"), (3, "the zorro", "es", "b"), (4, "der fuchs", None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(run("text_tokens")) == [(1, 3), (2, 4), (3, 2), (4, 2)]
    assert (2, "le", 2) in run("text_tf") and len(run("text_tf")) == 10
    idf = {t: (df, x) for t, df, x in run("text_df_idf")}
    assert idf["the"] == (2, round(math.log(2), 6)) and idf["fuchs"] == (1, round(math.log(4), 6))
    assert sorted(r[0] for r in run("text_norms")) == [1, 2, 3, 4]
    for name in ("fulltext_all", "fulltext_topk", "fulltext_virtual"):
        assert sorted(r[0] for r in run(name)) == [1, 3], name


def test_catalog_counts_every_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r["table"]: r["rows"] for r in registry.catalog_stats(spark, d).collect()}
    assert got == {p.stem: spark.read.parquet(str(p)).count() for p in Path(d).glob("*.parquet")}
