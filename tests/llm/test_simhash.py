import random
import re

import numpy as np
import pandas as pd
from xxhash import xxh64_intdigest

from quillstone.llm import simhash
from quillstone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, width=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_matches_brute_force(spark, odd_docs):
    rows = odd_docs.collect()
    prints = [brute_print(r.text) for r in rows]
    classes = brute_classes(prints)
    least = {c: min([rows[i].doc_id for i in range(len(rows)) if classes[i] == c and rows[i].doc_id is not None], default=None) for c in set(classes)}
    expected = sorted((str(r.doc_id), f"{p:016x}", str(least[c])) for r, p, c in zip(rows, prints, classes))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == expected


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def planted(n=400):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    out = set()
    for _ in range(n):
        x = r.choice(base)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out | {r.getrandbits(64) for _ in range(n)})


def test_links_with_and_without_split_nodes(spark):
    values = planted()
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    names = brute_classes(values)
    groups = {frozenset(signed[i] for i in range(len(values)) if names[i] == c) for c in set(names)}
    df = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    for limit in (200_000, 2):
        parts = components(simhash.links(df, max_node=limit)).toPandas()
        got = {frozenset(g) for _, g in parts.groupby("root")["node"]}
        assert got == {g for g in groups if len(g) > 1}, limit


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(5, 5), (None, 3), (1000, 1001)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(1000, 1000), (1001, 1000)}


def test_one_of_each_with_any_column_names(spark):
    from quillstone.llm.shingle_join import one_of_each_similar
    from quillstone.llm.simhash import one_of_each

    names = ["_order", "_simhash_d", "_simhash_x", "_shingle_d", "d", "x", "D_"]
    df = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}", *[f"{n}{i}" for n in names]) for i in range(6)], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    for run in (one_of_each, one_of_each_similar):
        got = run(df)
        assert got.columns == df.columns
        for r in got.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] and r.doc_id % 2 == 0
