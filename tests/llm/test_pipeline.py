import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_shingle_join import brute_kept
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillstone.llm import line_crf


def test_stages_in_turn(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.toPandas())
        if k + 1 < len(cp.STAGES):
            assert docs.columns == list(cp.COLUMNS)
    raw = pd.read_parquet(f"{d}/documents.parquet")
    scores = line_crf.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).toPandas()
    good = set(scores[scores.predicted == 1].doc_id)
    assert set(out[0].doc_id) == good and len(out[0]) == len(good) < len(raw)
    gone = {r[0]: set(map(int, filter(None, r[3].split(",")))) for r in brute_lines(list(out[0][["doc_id", "text"]].itertuples(index=False, name=None)))}
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in zip(out[0].doc_id, out[0].text)}
    assert dict(zip(out[1].doc_id, out[1].text)) == want
    assert (out[1].n_chars == out[1].text.str.len()).all()
    assert sorted(out[2].doc_id) == brute_kept(list(want.items())) and len(out[2]) < len(want)
    counts = out[3].groupby("doc_id").size()
    assert set(counts.index) <= set(out[2].doc_id) and abs(len(out[3]) - len(out[2])) < 6 * len(out[2]) ** 0.5
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(zip(out[2].doc_id, out[2].text))
    sizes = {i: len(tok.encode(texts[i], add_special_tokens=False).ids) + 1 for i in counts.index}
    assert out[4].groupby("doc_id").length.sum().to_dict() == {i: sizes[i] * n for i, n in counts.items()}
    for _, s in out[4].groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all()
    whole = out[4][out[4].length == out[4].doc_tokens].head(20)
    for r in whole.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_one_of_each_with_odd_rows(spark, odd_docs):
    from quillstone.llm.simhash import grouped, one_of_each

    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == grouped(odd_docs).select("root").distinct().count()
    assert kept.where(F.col("doc_id") == 200).count() <= 1


def test_stages_stand_odd_documents(spark, tmp_path, odd_docs, no_docs):
    """Nulls, repeated ids and rows, extra columns with clashing names, no rows at all."""
    labels = [(i, i % 2) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, start in enumerate((odd_docs, no_docs)):
        docs = start.withColumns({"d": F.lit(1), "_shingle_d": F.lit("x"), "_mix_at": F.lit(2.0)})
        for n, (_, stage) in enumerate(cp.STAGES):
            before = docs
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{n}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{n}")
            if n + 1 < len(cp.STAGES):
                assert docs.columns == list(cp.COLUMNS)
                assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        assert (docs.count() > 0) == (k == 0)
