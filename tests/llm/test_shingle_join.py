import random
import re

import numpy as np
import pytest
from test_simhash import WORD

import corpus_pipeline as cp
from quillstone.llm.shingle_join import fingerprints, one_of_each_similar


def shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_kept(rows):
    """rows: (doc_id, text), ids distinct. The smallest id of each component of pairs with a Jaccard of 0.8."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [d for k, (d, _) in enumerate(rows) if find(k) == k]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    bases = [[word() for _ in range(r.choice([6, 30, 100, 300]))] for _ in range(25)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "Two Words"), (904, "two  words")]
    for d in range(250):
        x = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 10])):
            x[r.randrange(len(x))] = word()
        rows.append((d, " ".join(x)))
    return rows


@pytest.mark.parametrize("hot", [256, 3])
def test_matches_brute_force(spark, hot):
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in one_of_each_similar(docs, hot=hot).collect()) == brute_kept(rows)


def test_pipeline_stage_judges_by_overlap(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.copies(spark, docs, "").collect()) == brute_kept(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    assert one_of_each_similar(no_docs).collect() == []
    kept = one_of_each_similar(odd_docs)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()


@pytest.mark.parametrize("bits", [0, 3, 7])
def test_fingerprints_never_change_the_result(spark, bits):
    rows = corpus(17)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in one_of_each_similar(docs, bits=bits).collect()) == brute_kept(rows)


def test_fingerprints_of_sets():
    r = random.Random(1)
    sets = [[r.getrandbits(64) for _ in range(n)] for n in (5, 0, 1, 12)]
    got = fingerprints(np.array([x for s in sets for x in s], np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert got.tolist() == [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s) > len(s)) for s in sets]
