import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    def of(text):
        return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]

    rest = [zlib.crc32(str(r.doc_id).encode()) % 5 if r.doc_id is not None else 0 for r in rows]
    docs = [of(r.text) for r in rows]

    def counted(which):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for d, r in zip(docs, rest):
            if which(r):
                for h, w in zip(["<s>", *d], d):
                    uni[w] += 1
                    bi[h, w] += 1
                    ctx[h] += 1
        return uni, bi, ctx

    uni, bi, ctx = counted(lambda r: r != 1)
    n, v = sum(uni.values()), len(uni)
    uni2, bi2, ctx2 = counted(lambda r: r not in (1, 2))
    n2 = sum(uni2.values())
    held = Counter()
    for d, r in zip(docs, rest):
        if r == 2:
            for h, w in zip(["<s>", *d], d):
                step = lambda x: round(-lm.STEP * math.log2(x)) if x else -1
                held[int(lm.bucket(np.array([float(ctx2[h])]))[0]), step(bi2[h, w] / ctx2[h] if ctx2[h] else 0), step(uni2[w] / n2)] += 1
    table = {k: np.array([x[i] for x in held]) for i, k in enumerate(("bucket", "q2", "q1"))} | {"n": np.array(list(held.values()))}
    weights = lm.fit_weights(table, 1 / (v + 1))
    out = []
    for row, d, r in zip(rows, docs, rest):
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        score = 0.0
        for h, w in zip(["<s>", *d], d):
            l2, l1, l0 = weights[int(lm.bucket(np.array([float(ctx[h])]))[0])]
            score += math.log10(l2 * (bi[h, w] / ctx[h] if ctx[h] else 0) + l1 * uni[w] / n + l0 / (v + 1))
        out.append((str(row.doc_id), r == 1, len(d), sum(uni[w] > 0 for w in d), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [16 << 20, 3000])
def test_matches_brute_force(spark, odd_docs, block_bytes):
    expected = brute(odd_docs.collect())
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.interpolated_scores(odd_docs, block_bytes=block_bytes).collect())
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    np.testing.assert_allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-6)


def plain_em(tokens, uniform, rounds=400):
    """Weights per context bucket from exact probabilities of every held-out token, in plain loops."""
    weights = {}
    for b in {t[0] for t in tokens}:
        mine = [t[1:] for t in tokens if t[0] == b]
        w = [1 / 3, 1 / 3, 1 / 3] if b else [0.0, 0.5, 0.5]
        for _ in range(rounds):
            sums = [0.0, 0.0, 1e-3]
            for p2, p1 in mine:
                parts = [w[0] * p2, w[1] * p1, w[2] * uniform]
                for i, x in enumerate(parts):
                    sums[i] += x / sum(parts)
            w = [x / sum(sums) for x in sums]
        weights[b] = w
    return weights


def test_weights_against_a_plain_em():
    r = np.random.default_rng(5)
    tokens = []
    for b in (0, 1, 3, 6):
        for _ in range(400):
            p1 = float(r.choice([0, 1e-4, 2e-3, 0.03, 0.1]))
            p2 = float(r.choice([0, 0, 0.01, 0.2, 0.7])) if b else 0.0
            tokens.append((b, p2, p1))
    steps = lambda x: round(-lm.STEP * math.log2(x)) if x else -1
    held = Counter((b, steps(p2), steps(p1)) for b, p2, p1 in tokens)
    table = {k: np.array([x[i] for x in held]) for i, k in enumerate(("bucket", "q2", "q1"))} | {"n": np.array(list(held.values()))}
    got, want = lm.fit_weights(table, 1e-5, rounds=400), plain_em(tokens, 1e-5)
    for b, w in want.items():
        np.testing.assert_allclose(got[b], w, atol=0.03)  # probabilities are kept in steps of a quarter of log2
    assert (got[2] == got[1]).all() or (got[2] == got[3]).all()


def test_buckets_are_powers_of_two():
    assert lm.bucket(np.array([0.0, 1, 2, 3, 4, 7, 8, 1023, 1024])).tolist() == [0, 1, 2, 2, 3, 3, 4, 10, 11]


def test_empty(no_docs):
    assert lm.interpolated_scores(no_docs).collect() == []


def test_packing():
    for values in (np.array([], np.uint64), np.array([0, 1, 2**64 - 1, 7], np.uint64), np.arange(5, dtype=np.uint32)):
        assert (lm.unpack(lm.pack(values), values.dtype.type) == values).all()
