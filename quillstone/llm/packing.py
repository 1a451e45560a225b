"""Packing along a space-filling curve.

Every document becomes token ids with a final end id. Its hashed token counts are projected to
three dimensions; the Hilbert key of the projection puts similar documents next to each other.
Documents are range-sorted by key, and the curve is cut every ``length`` ids, so that neighbours
share sequences and only the last sequence of all can be short.

Global positions come from sums per range partition (one number each) and running sums inside
them; ids never pass through one task. Sorting moves keys and counts only; ids are joined once.

Cases: a null or empty text is the end id alone. Repeated rows and ids, null ids included, are
packed each for itself; ties of the key fall to doc_id, then to the order of input rows. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

BITS, DIMS, BUCKETS = 20, 3, 256
#: Words of these characters alone are taken apart here; all others go to the tokenizer as they are.
_PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the vocabulary's own pattern of word pieces.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of whole texts, word by word: this vocabulary drops white space and never joins words across it.

    Words seen before come from two tables of bounded size; new ones are encoded many at a time.
    """

    def __init__(self, path: str, words: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.inner = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.inner.normalizer = None
        self.inner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.pieces, self.limit = regex.compile(_PIECES), words
        self.by_word: dict[bytes, bytes] = {}
        self.by_piece: dict[str, bytes] = {}

    def _learn(self, new: set[bytes]) -> None:
        split: dict[bytes, list[str]] = {}
        for word in new:
            # most words are letters alone, or letters and one mark: their pieces need no pattern
            if word.isalpha():
                split[word] = [word.lower().decode()]
                continue
            if word[:-1].isalpha() and word[-1:] in b".,;:!?":
                split[word] = [word[:-1].lower().decode(), word[-1:].decode()]
                continue
            text = word.decode()
            if _PLAIN.fullmatch(text):
                split[word] = self.pieces.findall(text.lower())
            else:
                self.by_word[word] = np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        fresh = [p for p in {p for ps in split.values() for p in ps} if p not in self.by_piece]
        for i in range(0, len(fresh), 500):
            some = fresh[i : i + 500]
            ids = np.array(self.inner.encode(" ".join(some), add_special_tokens=False).ids, "<u2")
            cuts = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(some):
                data = ids.tobytes()
                self.by_piece |= {p: data[a:b] for p, a, b in zip(some, [0, *cuts], cuts, strict=False)}
            else:
                self.by_piece |= {p: np.array(self.full.encode(p, add_special_tokens=False).ids, "<u2").tobytes() for p in some}
        self.by_word |= {w: b"".join(map(self.by_piece.__getitem__, ps)) for w, ps in split.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        known = self.by_word
        split = [t.encode().split() for t in texts]
        new = set().union(*split).difference(known) if split else set()
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set().union(*split)
            if len(self.by_piece) > self.limit:
                self.by_piece.clear()
            self._learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, dims), by Skilling's transposition."""
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], seed: int = 11) -> np.ndarray:
    """Hilbert keys of documents given as id arrays."""
    r = np.random.default_rng(seed)
    signs, bucket = r.choice([-1.0, 1.0], (BUCKETS, DIMS)), r.integers(0, BUCKETS, 1 << 16)
    size = np.array([len(x) for x in ids])
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
    counts = np.bincount(np.repeat(np.arange(len(ids)), size) * BUCKETS + bucket[flat], minlength=len(ids) * BUCKETS).reshape(-1, BUCKETS).astype(np.float64)
    vector = counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-12)
    place = 1 / (1 + np.exp(-2 * (vector @ signs)))
    return hilbert_key(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = 4096, end_id: int = 2, part_bytes: int = 32 << 20) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    c = F.col

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            data = [x + end for x in tok.encode([t or "" for t in batch.column("text").to_pylist()])]
            ids = [np.frombuffer(x, "<u2") for x in data]
            key = np.concatenate([curve_keys(ids[i : i + 100]) for i in range(0, len(ids), 100)]) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "key", "doc_tokens", "ids"])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_tokens"), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n)], names=["row", "doc_tokens", "part", "inside"])
            at = int(ends[-1]) if len(ends) else at

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            out: list[tuple] = []
            for doc, data, at in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "ids", "at")), strict=True):
                ids = np.frombuffer(data, "<u2").astype("<u4")
                n, begin = len(ids), 0
                while begin < n:
                    sequence, offset = divmod(at + begin, length)
                    size = min(length - offset, n - begin)
                    out.append((doc, begin, size, ids[begin : begin + size].tobytes(), n, sequence, offset))
                    begin += size
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True) if out else [[]] * 7, shape, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    shape = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    coded = docs.select(c("doc_id").cast("long"), c("text").cast("string")).mapInArrow(encode, "doc_id long, key long, doc_tokens long, ids binary")
    coded = saved(coded.withColumn("row", F.monotonically_increasing_id()), "packing-ids", 500)
    rows = coded.count()
    parts = max(1, -(-rows * 40 // part_bytes))
    ordered = coded.select("key", "doc_id", "row", "doc_tokens").repartitionByRange(parts, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = saved(ordered.mapInArrow(running, "row long, doc_tokens long, part long, inside long"), "packing-places")
    sums = placed.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - c("n")).alias("base"))
    if parts <= 100_000:  # a row per range partition: two megabytes at most
        bases = F.broadcast(bases)
    places = placed.join(bases, "part").select("row", (c("base") + c("inside")).alias("at"))
    return coded.select("row", "doc_id", "ids").join(places.hint("merge"), "row").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
