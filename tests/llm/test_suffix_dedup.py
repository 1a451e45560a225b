import random

import numpy as np
import pytest

from quillstone.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for s in range(len(d) - length + 1):
            seen.setdefault(d[s : s + length], []).append((i, s))
    gone = [np.zeros(len(d), bool) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = True
    return [(len(d), bytes(np.frombuffer(d, np.uint8)[~g]), int((np.diff(g.astype(int), prepend=0) == 1).sum())) for d, g in zip(data, gone)]


def corpus(seed):
    r = random.Random(seed)
    letters = "abÉ日\n "
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [text(r.randint(5, 60)) for _ in range(6)]
    out = [None, "", "short", "a" * 90, "ab" * 60]
    for _ in range(60):
        out.append("".join(text(r.randint(0, 25)) + (r.choice(passages)[r.randint(0, 4) :] if r.random() < 0.7 else "") for _ in range(r.randint(0, 5))))
    near = text(150)
    for _ in range(45):
        i = r.randrange(120)
        out.append(near[:i] + r.choice(letters) + near[i + 1 :])
    out += [out[20], out[20], near, near]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("max_run,batch_size", [(20_000, 32768), (20_000, 20), (10, 32768)])
def test_matches_brute_force(spark, max_run, batch_size):
    texts = corpus(max_run + batch_size)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pos string").repartition(3)
    got = sd.remove_repeats(df, length=40, k=8, max_run=max_run, batch_size=batch_size).collect()
    assert [(r.n_bytes, bytes(r.kept), len(r.spans)) for r in sorted(got, key=lambda r: r.doc_id)] == brute(texts, 40)


def test_odd_documents(spark, odd_docs, no_docs):
    assert sd.remove_repeats(no_docs).collect() == []
    rows = odd_docs.collect()
    expected = sorted((str(r.doc_id), n, kept, spans) for r, (n, kept, spans) in zip(rows, brute([r.text for r in rows], 400)))
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept), len(r.spans)) for r in sd.remove_repeats(odd_docs).collect()) == expected


def test_family_in_any_batches():
    texts = [t for t in corpus(5) if t]
    records = []
    for i, t in enumerate(texts):
        buf = np.frombuffer(t.encode(), np.uint8)
        at, _ = sd.anchors(buf, np.array([0, len(buf)]), 40, 8)
        records += [(i, 0, int(a), t.encode()[max(0, a - 32) : a], t.encode()[a : a + 40]) for a in at]
    covers = []
    for size in (10**6, 100, 7):
        family = sd.Family(40, 8)
        for i in range(0, len(records), size):
            family.add(records[i : i + size])
        gone = {}
        for row in family.spans().to_pylist():
            gone.setdefault(row["d"], set()).update(range(row["begin"], row["until"]))
        covers.append(gone)
        ranks = [rank for rank, _ in family.levels]
        assert ranks == sorted(set(ranks), reverse=True)
    assert covers[0] == covers[1] == covers[2]
