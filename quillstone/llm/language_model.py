"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Training documents give n-gram counts. The maximum-likelihood estimates of a token after its
predecessor, of a token alone, and the uniform one are mixed with weights that depend on how often
the context occurs (a bucket per power of two). Expectation-maximisation finds the weights on
held-out counts: one part of the training documents is deleted from all counts and predicted by
what is left; the final counts then include it again.

Layout: documents are dealt by hash into blocks of bounded bytes. A block turns its tokens into
sorted distinct n-gram keys and sends them out cut by key range, as packed columns; a range task
adds up all blocks and sends each block the totals, in the block's own key order, so keys never
travel back. A block then scores its documents with what it got. What is gathered grows with the
input, and a task holds one block, or one range of keys, of all of them. Frequent tokens are one key
per block, whatever their number.

Keys are 64-bit hashes of token bytes. Cases: null text is empty and has the end token alone; a null
doc_id counts as remainder 0 (training); repeated rows and ids are separate rows; an empty table
gives an empty result; without training documents the model is uniform.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import LOWER, mix, slices, span_hash, text_bytes, words
from .storage import saved

END, START = np.uint64(0x5BF0A8B1E7C3D921), np.uint64(0xC2B2AE3D27D4EB4F)
#: Steps of log2 probabilities in the held-out table that expectation-maximisation reads.
STEP = 4
_BACK = "block long, kind int, part long, total binary, part_total binary, types long, tokens long, fold_tokens long"


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; ascending unsigned ones best as differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()) if len(values) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys (one end per text), predecessor keys, and the text number of each token."""
    keys, owner, base = [], [], 0
    for batch in table.combine_chunks().to_batches():
        for piece in slices(batch, "text"):
            buf, off = text_bytes(piece.column("text"))
            buf = LOWER[buf]
            start, end, doc = words(buf, off)
            size = np.bincount(doc, minlength=len(off) - 1) + 1
            key = np.full(size.sum(), END, np.uint64)
            key[np.arange(len(doc)) + doc] = span_hash(buf, start, end)
            keys.append(key)
            owner.append(base + np.repeat(np.arange(len(size)), size))
            base += len(size)
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    doc = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    before = np.empty_like(key)
    before[1:] = key[:-1]
    if len(key):
        before[np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])] = START
    return key, before, doc


def _distinct(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For unigrams and bigrams: sorted distinct keys and, per token, the index among them; the token's text last."""
    key, before, doc = tokens(table)
    return [*(np.unique(k, return_inverse=True) for k in (key, mix(before + mix(key)))), (before, doc)]


def _cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Key ranges present (by leading bits) and the borders of their runs."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return part[heads], np.append(heads, len(keys))


def count_block(table: pa.Table, bits: int) -> pa.Table:
    """Packed distinct keys and training counts of one block, a row per kind and key range."""
    rows: dict[str, list] = {k: [] for k in ("part", "kind", "block", "keys", "counts", "fold")}
    *kinds, (_, doc) = _distinct(table)
    train = np.asarray(table["train"].to_numpy(zero_copy_only=False), bool)[doc]
    block, fold = table["block"][0].as_py(), bool(table["fold"][0].as_py())
    for kind, (keys, at) in enumerate(kinds):
        counts = np.bincount(at, train, len(keys)).astype(np.uint32)
        parts, edges = _cuts(keys, bits)
        for part, (a, b) in zip(parts.tolist(), pairwise(edges.tolist()), strict=True):
            for k, v in zip(rows, (part, kind, block, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(counts[a:b]), fold), strict=True):
                rows[k].append(v)
    return pa.table(rows, schema=pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("fold", pa.bool_())]))


def add_up(table: pa.Table) -> pa.Table:
    """Totals of one key range and kind over all blocks, packed again in each block's order."""
    keys = [np.cumsum(unpack(x, np.uint64)) for x in table["keys"].to_pylist()]
    counts = np.concatenate([unpack(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.float64)
    fold = np.array(table["fold"].to_pylist(), bool)
    ends = np.cumsum([len(k) for k in keys])
    all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    in_fold = np.repeat(fold, [len(k) for k in keys])
    total = np.bincount(at, counts, len(all_keys)).astype(np.uint64)
    part_total = np.bincount(at, counts * in_fold, len(all_keys)).astype(np.uint64)
    pieces = np.split(at, ends[:-1])
    n = len(pieces)
    first = np.arange(n) == 0
    return pa.table(
        {
            "block": table["block"], "kind": table["kind"].cast(pa.int32()), "part": table["part"],
            "total": pa.array([pack(total[p]) for p in pieces], pa.binary()),
            "part_total": pa.array([pack(part_total[p]) if f else None for p, f in zip(pieces, fold, strict=True)], pa.binary()),
            "types": pa.array(np.where(first, int((total > 0).sum()), 0)), "tokens": pa.array(np.where(first, int(total.sum()), 0)),
            "fold_tokens": pa.array(np.where(first, int(part_total.sum()), 0)),
        }
    )


def _received(back: pa.Table, kind: int, column: str) -> np.ndarray:
    rows = sorted((part, data) for part, k, data in zip(back["part"].to_pylist(), back["kind"].to_pylist(), back[column].to_pylist(), strict=True) if k == kind)
    return np.concatenate([unpack(x, np.uint64) for _, x in rows]).astype(np.float64) if rows else np.zeros(0)


def _counts(docs: pa.Table, back: pa.Table, starts: float, deleted: bool, fold_starts: float) -> tuple[np.ndarray, ...]:
    """Per token: bigram, context and unigram count, and the token's text."""
    (_, at1), (_, at2), (before, doc) = _distinct(docs)
    one, two = _received(back, 0, "total"), _received(back, 1, "total")
    if deleted:
        one, two = one - _received(back, 0, "part_total"), two - _received(back, 1, "part_total")
    c1, c2 = one[at1], two[at2]
    context = np.empty_like(c1)
    context[1:] = c1[:-1]
    context[before == START] = starts - fold_starts * deleted
    return c2, context, c1, doc


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole part of log2."""
    return np.where(context > 0, np.frexp(context)[1], 0).astype(np.int64)


def fit_weights(table: dict[str, np.ndarray], uniform: float, buckets: int = 64, rounds: int = 100) -> np.ndarray:
    """Expectation-maximisation: weights (bucket, 3) of bigram, unigram and uniform estimates.

    table: bucket, q2, q1 (steps of -log2 probability, -1 for zero) and n, the held-out tokens.
    """
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (buckets, 1))
    weights[0] = [0, 0.5, 0.5]
    p = np.stack([np.where(table[k] < 0, 0.0, 2.0 ** (-table[k] / STEP)) for k in ("q2", "q1")] + [np.full(len(table["n"]), uniform)], axis=1)
    b, n = table["bucket"].astype(np.int64), table["n"].astype(np.float64)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(b, share[:, k], buckets) for k in range(3)], axis=1) + np.array([0.0, 0.0, 1e-3])
        fresh = sums / sums.sum(axis=1, keepdims=True)
        done = np.abs(fresh - weights).max() < 1e-6
        weights = fresh
        if done:
            break
    known = np.flatnonzero(np.bincount(b, n, buckets))
    for i in range(1, buckets):  # a bucket without held-out tokens takes the weights of the nearest one with some
        if len(known) and i not in known and known[-1] > 0:
            near = known[known > 0]
            weights[i] = weights[near[np.argmin(np.abs(near - i))]]
    return weights


def held_out_table(docs: pa.Table, back: pa.Table, n: float, starts: float, fold_starts: float) -> pa.Table:
    """The block's tokens as counts per bucket and pair of estimates, from counts without the held-out part."""
    c2, context, c1, _ = _counts(docs, back, starts, True, fold_starts)
    steps = lambda x: np.where(x > 0, np.round(-STEP * np.log2(np.where(x > 0, x, 1))), -1).astype(np.int64)
    code = (bucket(context) << 40) | ((steps(np.divide(c2, context, out=np.zeros_like(c2), where=context > 0)) + 1) << 20) | (steps(c1 / max(n, 1)) + 1)
    codes, many = np.unique(code, return_counts=True)
    return pa.table({"bucket": codes >> 40, "q2": ((codes >> 20) & 0xFFFFF) - 1, "q1": (codes & 0xFFFFF) - 1, "n": many.astype(np.int64)})


def score_block(docs: pa.Table, back: pa.Table, weights: np.ndarray, n: float, v: float, starts: float) -> pa.Table:
    """The scores of one block's documents."""
    c2, context, c1, doc = _counts(docs, back, starts, False, 0.0)
    w = weights[bucket(context)]
    p = w[:, 0] * np.divide(c2, context, out=np.zeros_like(c2), where=context > 0) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
    many = docs.num_rows
    per = lambda x=None: np.bincount(doc, x, many)
    score = per(np.log10(p))
    return pa.table(
        {
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": per().astype(np.int64), "n_known": per(c1 > 0).astype(np.int64),
            "train_tokens": np.full(many, int(n), np.int64), "base_score": per(np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))), "score": score, "mean_score": score / np.maximum(per(), 1),
        }
    )


def interpolated_scores(docs: DataFrame, *, folds: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), and mean_score (per token) of every row.

    Documents whose crc32(doc_id as text) leaves remainder 1 are not learned from; those of
    remainder 2 are the held-out part that the weights are found on.
    """
    c = F.col
    rest = F.coalesce(F.crc32(c("doc_id").cast("string")), F.lit(0)) % folds
    slim = docs.select(c("doc_id").cast("long"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text")).withColumns({"held_out": rest == 1, "train": rest != 1, "fold": rest == 2})
    size, starts, fold_starts = slim.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.count_if("train"), F.count_if("fold")).first()
    blocks = max(1, -(-size // block_bytes))
    fold_blocks = -(-blocks // folds)
    place = F.xxhash64("doc_id", "text")
    dealt = slim.withColumn("block", F.when(c("fold"), F.pmod(place, F.lit(fold_blocks))).otherwise(fold_blocks + F.pmod(place, F.lit(blocks))))
    bits = max(2, int(blocks).bit_length())
    packed = dealt.groupBy("block").applyInArrow(lambda t: count_block(t, bits), "part long, kind int, block long, keys binary, counts binary, fold boolean")
    back = saved(packed.groupBy("part", "kind").applyInArrow(add_up, _BACK), "lm-totals")
    v, n, fold_n = (float(x or 0) for x in back.where("kind = 0").agg(F.sum("types"), F.sum("tokens"), F.sum("fold_tokens")).first())
    sent = back.select("block", "kind", "part", "total", "part_total")
    fold_docs, fold_back = dealt.where("fold"), sent.where(c("block") < fold_blocks)
    held = fold_docs.groupBy("block").cogroup(fold_back.groupBy("block")).applyInArrow(lambda d, b: held_out_table(d, b, n - fold_n, starts, fold_starts), "bucket long, q2 long, q1 long, n long")
    table = held.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()
    weights = fit_weights({k: table[k].to_numpy(np.int64) for k in table}, 1 / (v + 1))
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double"
    return dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(lambda d, b: score_block(d, b, weights, n, v, starts), shape)

