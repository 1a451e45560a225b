import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillstone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_key_is_a_curve():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert_key(points, 3)
    assert sorted(key) == list(range(512))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_word_ids_are_the_tokenizers():
    full, own = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH, words=5)
    texts = ["", "Hello, WORLD's  don't\tit'll 12,345.6%", "a b c ß Ñandú É é İstanbul ΣΑΣ", "<|endoftext|>x <|startoftext|> <b>", "日本語 🙂🙂 x\x1cy \x85 z", "ª¼²× ÷", "I'VE 've'll'"]
    assert [np.frombuffer(own.encode([t])[0], "<u2").tolist() for t in texts] == [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(spark, odd_docs):
    full = Tokenizer.from_file(PATH)
    pieces = packing.pack(odd_docs, PATH, length=512, part_bytes=400).collect()
    expected = sorted((str(r.doc_id), full.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd_docs.collect())
    rows = {}
    by_seq = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        rows.setdefault((str(p.doc_id), p.doc_tokens), []).append((p.start, ids))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for k, spans in by_seq.items():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at == 512 or k == max(by_seq)
    total = sorted((d, x) for (d, _), ps in rows.items() for _, ids in ps for x in ids)
    assert total == sorted((d, x) for d, ids in expected for x in ids)
    single = {d: ids for d, ids in expected if sum(e[0] == d for e in expected) == 1}
    for (d, _), ps in rows.items():
        if d in single:
            assert [x for _, ids in sorted(ps) for x in ids] == single[d]
            assert [s for s, _ in sorted(ps)] == [sum(len(i) for _, i in sorted(ps)[:k]) for k in range(len(ps))]


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []


def test_digest_is_crc32_of_the_ids(spark):
    from pyspark.sql import functions as F

    p = packing.pack(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), PATH).select("ids", F.crc32("ids").alias("x")).first()
    assert p.x == zlib.crc32(bytes(p.ids))


def test_sequences_follow_the_curve(spark):
    import random

    r = random.Random(3)
    topics = [[f"{c}{i}" for i in range(40)] for c in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, " ".join(r.choice(topics[i % 4]) for _ in range(r.randint(20, 60)))) for i in range(120)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH, length=256, part_bytes=400).collect()
    walk = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    full = Tokenizer.from_file(PATH)
    ids = [np.array(full.encode(t, add_special_tokens=False).ids + [2]) for _, t in rows]
    key = dict(enumerate(packing.curve_keys(ids).tolist()))
    assert walk == sorted(range(120), key=lambda i: (key[i], i)) != list(range(120))
    # neighbours on the curve are alike: far more often of one topic than by chance
    same = sum(a % 4 == b % 4 for a, b in itertools.pairwise(walk)) / 119
    assert same > 0.5
