import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from quillstone.llm import mixing


def test_distribution_function(spark):
    df = spark.createDataFrame([("a", 0.3), ("b", 4.0), ("c", 900.0)], "_mix_source string, rate double")
    for r in mixing.distribution(df).collect():
        rate = {"a": 0.3, "b": 4.0, "c": 900.0}[r._mix_source]
        k = np.arange(len(r._mix_cdf))
        logs = np.concatenate([[0], np.cumsum(np.log(k[1:]))])
        np.testing.assert_allclose(r._mix_cdf, np.cumsum(np.exp(k * np.log(rate) - rate - logs)), rtol=1e-9)
        assert abs(r._mix_cdf[-1] - 1) < 1e-9


def test_shares_and_sql(spark):
    n = 6000
    pdf = pd.DataFrame({"doc_id": range(n), "text": "t", "lang": "en", "source": ["hot" if i % 3 else f"s{i % 4}" for i in range(n)], "n_chars": 1})
    df = spark.createDataFrame(pdf)
    got = mixing.mix(df).toPandas()
    share = got.groupby("source").size() / len(got)
    assert abs(share - 0.2).max() < 0.02 and abs(len(got) - n) < 300
    with duckdb.connect() as con:
        con.register("documents", pdf)
        want = con.sql(mixing.SQL).df()
    key = ["doc_id", "copy"]
    pd.testing.assert_frame_equal(got.sort_values(key)[want.columns].reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)
    weights = spark.createDataFrame([("hot", 3.0), ("s0", 1.0), ("s1", 0.0), ("none", 5.0)], "source string, weight double")
    shares = Counter(r.source for r in mixing.mix(df, weights, size=8000).collect())
    assert set(shares) == {"hot", "s0"} and abs(shares["hot"] / 6000 - 1) < 0.06 and abs(shares["s0"] / 2000 - 1) < 0.1


def test_order_is_global_and_repeatable(spark):
    df = spark.createDataFrame([(i, "t", "en", f"s{i % 3}", 1) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    once, again = ([(r.doc_id, r.copy) for r in mixing.mix(d).collect()] for d in (df, df.repartition(7)))
    assert once == again and [x[0] for x in once] != sorted(x[0] for x in once)


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs)
    assert set(got.columns) == {*odd_docs.columns, "copy"}
    # by value: a count per row from its id and its source's rate, worked out without the module
    rows = odd_docs.collect()
    held = Counter(r.source for r in rows)
    want = Counter()
    for r in rows:
        u = int(hashlib.md5(f"7:count:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        rate, k, p, total = len(rows) / len(held) / held[r.source], 0, None, 0.0
        while True:
            total += math.exp(-rate) * rate**k / math.factorial(k)
            if total > u:
                break
            k += 1
        for copy in range(1, k + 1):
            want[(str(r.doc_id), r.text, r.source, copy)] += 1
    assert Counter((str(r.doc_id), r.text, r.source, r.copy) for r in got.collect()) == want
    assert mixing.mix(no_docs).collect() == []
    assert set(mixing.mix(odd_docs.withColumnRenamed("key", "copy")).columns) == {*odd_docs.columns, "copy"} - {"key"}


def test_any_column_names_and_a_joined_table(spark):
    names = ["_mix_source", "_mix_u", "_mix_cdf", "_mix_at", "_MIX_AT_"]
    df = spark.createDataFrame([(i if i % 4 else None, f"t{i}", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(90)], f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}")
    got = [tuple(r) for r in mixing.mix(df).collect()]
    assert mixing.mix(df).columns == [*df.columns, "copy"]
    rows = Counter(tuple(r) for r in df.collect())
    assert got and all(r[:-1] in rows for r in got)
    assert [tuple(r) for r in mixing.mix(df, send=0).collect()] == got
