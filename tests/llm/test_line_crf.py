import itertools
import random

import numpy as np

from quillstone.llm import line_crf as crf
from quillstone.llm.bytekit import text_bytes


def test_marginals_match_enumeration():
    r = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    s, trans = r.normal(size=7), r.normal(size=(2, 2))
    p, pairs, total = crf.Chains(doc).marginals(s, trans)
    want_p, want_pairs, want_total = np.zeros(7), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        e = np.array([np.exp(sum(s[i] * y for i, y in zip(at, path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))) for path in paths])
        want_total += np.log(e.sum())
        for weight, path in zip(e / e.sum(), paths):
            want_p[at] += weight * np.array(path)
            for a, b in itertools.pairwise(path):
                want_pairs[a, b] += weight
    np.testing.assert_allclose(p, want_p)
    np.testing.assert_allclose(pairs, want_pairs)
    np.testing.assert_allclose(total, want_total)


def test_features_of_lines():
    import pyarrow as pa

    x, doc, weight = crf.line_features(*text_bytes(pa.array(["AB cd\n\nAB cd", None, "x#y", ""])))
    assert doc.tolist() == [0, 0, 0, 1, 2, 3] and weight.tolist() == [6, 1, 6, 1, 4, 1]
    assert x[0, 1] == 0.5 and x[2, 7] == 1 and x[1, 8] == 1 and x[4, 2] == 1 and x[2, 6] == 1 and x[0, 6] == 0


def test_held_out_accuracy_and_odd_rows(spark, odd_docs, no_docs):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(1, 8)))
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        text = "\n".join(" ".join(word() if good else r.choice([word().upper() + "!!", word() + "%%%", word() + " | "]) for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 6)))
        rows.append((i, text))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    got = crf.classify(docs, marks).collect()
    held = [g for g in got if g.held_out]
    assert len(got) == 600 and 150 < len(held) < 250
    assert np.mean([g.predicted == dict(labels)[g.doc_id] for g in held]) > 0.97
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    odd = crf.classify(odd_docs, marks).collect()
    assert len(odd) == odd_docs.count() and all(0 <= g.score <= 1 for g in odd)
    assert crf.classify(no_docs, marks).collect() == []
    assert {g.score for g in crf.classify(odd_docs, marks.limit(0)).collect()} == {0.5}


def likelihood(x, doc, good, w, trans, ridge=1.0):
    """By enumeration of all labellings, nothing shared with the module."""
    total = 0.0
    for d in range(doc[-1] + 1):
        at = np.flatnonzero(doc == d)
        score = lambda path: sum(x[i] @ w * y for i, y in zip(at, path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
        every = np.array([score(path) for path in itertools.product((0, 1), repeat=len(at))])
        total += score(good[at]) - np.logaddexp.reduce(every)
    return total / len(x) - ridge * (w @ w + (trans**2).sum()) / 2 / len(x)


def test_fit_reaches_the_optimum():
    r = np.random.default_rng(3)
    doc = np.repeat(np.arange(30), r.integers(1, 6, 30))
    x = np.hstack([np.ones((len(doc), 1)), r.normal(size=(len(doc), 2))])
    good = (x[:, 1] + 0.5 * r.normal(size=len(doc)) > 0).astype(int)
    w, trans = crf.fit(x, doc, good, rounds=400)
    best = likelihood(x, doc, good, w, trans)
    # small steps in any direction make it no better: the gradient, by differences, is almost zero
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-4
        up = likelihood(x, doc, good, w + step[:3], trans + step[3:].reshape(2, 2))
        down = likelihood(x, doc, good, w - step[:3], trans - step[3:].reshape(2, 2))
        assert abs(up - down) / 2e-4 < 2e-3
    assert best > likelihood(x, doc, good, np.zeros(3), np.zeros((2, 2))) + 0.1


def test_document_score_is_the_weighted_mean_of_marginals():
    import pyarrow as pa

    r = np.random.default_rng(8)
    w, trans = r.normal(size=crf.FEATURES), r.normal(size=(2, 2))
    texts = ["One line here\n\nanother ## line\nEND", "", "x", "a b c\nA B C!"]
    buf, off = text_bytes(pa.array(texts))
    score, _, _ = crf.score_texts(buf, off, w, trans)
    x, doc, _ = crf.line_features(buf, off)
    for d, text in enumerate(texts):
        at = np.flatnonzero(doc == d)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        e = np.array([np.exp(sum(x[i] @ w * y for i, y in zip(at, path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))) for path in paths])
        p = np.array(paths).T @ (e / e.sum())
        size = np.array([len(line.encode()) + 1 for line in text.split("\n")])
        np.testing.assert_allclose(score[d], (p * size).sum() / size.sum(), atol=1e-9)


def test_training_lines_are_bounded(spark):
    rows = [(i, ("good words here\n" if i % 2 else "### %%% ###\n") * 40) for i in range(90)] + [(5, "again\n" * 40)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    some = crf.training_rows(docs, marks, max_lines=900).collect()
    assert 15 < len(some) <= 900 // 41
    whole = crf.training_rows(docs, marks).collect()
    assert len(whole) == len({r.doc_id for r in whole}) > 40
    assert crf.training_rows(docs, marks, max_train=7).count() == 7
