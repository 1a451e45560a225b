import random

import numpy as np
from test_suffix_dedup import brute, corpus

from quillstone.llm import suffix_dedup as sd


def test_batches_added_to_a_stored_index(spark):
    texts = corpus(11)
    rows = [(i, t) for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    parts = [rows[:30], rows[30:35], rows[35:80], rows[80:]]
    index = sd.Index(length=40, k=8, max_run=10)
    for n, part in enumerate(parts):
        index.add(spark.createDataFrame(part, "doc_id long, text string"))
        done = sorted(r for p in parts[: n + 1] for r in p)
        got = sd.cut(spark.createDataFrame(done, "doc_id long, text string"), index.spans).collect()
        assert [(r.n_bytes, bytes(r.kept), len(r.spans)) for r in sorted(got, key=lambda r: r.doc_id)] == brute([t for _, t in done], 40)
        assert [rank for rank, _ in index.levels] == [[0], [1], [1, 0], [2]][n]
    assert sum(level.count() for _, level in index.levels) == sum(len(sd.anchors(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 40, 8)[0]) for t in texts if t)


def test_many_equal_surroundings(spark):
    text = "xy" * 300
    rows = [(i, text) for i in range(30)] + [(100 + i, f"{i} " + text[: 100 + i] + f" {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sd.remove_repeats(df, length=40, k=8, max_run=50).collect()
    assert [(r.n_bytes, bytes(r.kept), len(r.spans)) for r in sorted(got, key=lambda r: r.doc_id)] == brute([t for _, t in rows], 40)
