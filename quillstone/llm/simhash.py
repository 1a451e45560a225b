"""SimHash near-duplicates, joined by walking pairs of binary-trie nodes.

Every whole text gets a 64-bit fingerprint of its word shingles. Two fingerprints within ``bits``
differing bits agree in at least one of ``bits + 1`` blocks, so the distinct fingerprints are dealt
out once per block, rotated to put that block first; below each block value hangs a binary trie, a
sorted array whose nodes are ranges. The self-join walks node pairs together, adds up differing
bits and drops a pair once it exceeds the budget. Nodes over ``max_node`` fingerprints are first
split by their next bits; each part then meets its own and the parts within the budget. A task
passes on a spanning forest of its links, at most one per fingerprint, never all pairs.

Cases: null, empty and blank texts have fingerprint zero, linked like any other. A null doc_id
takes part, but names no component: component_id is the smallest id reachable, null if none is
there. Repeated rows and ids are separate rows of one component. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .bytekit import LOWER, SEP, slices, text_bytes, words
from .components import components
from .storage import discard, saved, unused


def single_spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each: the bytes, and the words' starts, ends and text numbers there."""
    start, end, doc = words(buf, offsets)
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 32, np.uint8)
    out[np.delete(np.arange(at[-1]), at[1:] - 1)] = buf[~SEP[buf]]
    return out, at[:-1], at[1:] - 1, doc


def fingerprint_batch(batch: pa.RecordBatch, width: int, seed: int) -> np.ndarray:
    """The unsigned fingerprints of a batch's texts."""
    buf, off = text_bytes(batch.column("text"))
    n = len(off) - 1
    out, start, end, doc = single_spaced(LOWER[buf], off)
    count = np.bincount(doc, minlength=n)
    last = np.cumsum(count)
    prints = np.zeros(n, np.uint64)
    if not len(doc):
        return prints
    word = np.arange(len(doc))
    opens = (word + width <= last[doc]) | ((count[doc] < width) & (word == last[doc] - count[doc]))
    first = word[opens]
    until = np.minimum(first + width, last[doc[first]]) - 1
    data = out.tobytes()
    h = np.fromiter((xxh64_intdigest(data[a:b], seed) for a, b in zip(start[first].tolist(), end[until].tolist(), strict=True)), np.uint64, len(first))
    per = np.bincount(doc[first], minlength=n)
    full = np.flatnonzero(per)
    heads = (np.cumsum(per) - per)[full]
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    prints[full] = np.packbits(sums * 2 > per[full][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return prints


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                fp = fingerprint_batch(batch, width, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def trie_links(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, depth: int, budget: int, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in a, j in b) with at most budget differing bits.

    a and b: sorted uint64 arrays. nodes: rows (a_lo, a_hi, b_lo, b_hi) of node pairs whose entries
    agree in the first depth bits. itself: a and b are one array, nodes are on the diagonal, and
    each pair i < j comes once.
    """
    found = []
    lo_a, hi_a, lo_b, hi_b = nodes.T.astype(np.int64)
    err = np.zeros(len(nodes), np.int64)
    while len(err):
        same = itself & (lo_a == lo_b)
        size = (hi_a - lo_a) * (hi_b - lo_b)
        small = (size <= 16) | (depth >= 64)
        if small.any():
            k = np.flatnonzero(small)
            rep = np.repeat(k, size[k])
            step = np.arange(len(rep)) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
            wide = (hi_b - lo_b)[rep]
            i, j = lo_a[rep] + step // wide, lo_b[rep] + step % wide
            ok = (~same[rep] | (i < j)) & (np.bitwise_count(a[i] ^ b[j]) <= budget)
            found.append((i[ok], j[ok]))
            big = ~small
            lo_a, hi_a, lo_b, hi_b, err, same = (x[big] for x in (lo_a, hi_a, lo_b, hi_b, err, same))
        if not len(err):
            break
        bit = np.uint64(1) << np.uint64(63 - depth)
        high = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        cut = lambda v, lo, hi: np.clip(np.searchsorted(v, (v[lo] & high) | bit), lo, hi)  # noqa: E731  the prefix is shared, so the first entry with the bit set starts the right child
        mid_a, mid_b = cut(a, lo_a, hi_a), cut(b, lo_b, hi_b)
        left_a, right_a, left_b, right_b = (lo_a, mid_a), (mid_a, hi_a), (lo_b, mid_b), (mid_b, hi_b)
        parts = [(left_a, left_b, 0, None), (right_a, right_b, 0, None), (left_a, right_b, 1, None), (right_a, left_b, 1, ~same)]
        out = []
        for (la, ha), (lb, hb), more, where in parts:
            keep = (la < ha) & (lb < hb) & (err + more <= budget)
            keep &= True if where is None else where
            out.append((la[keep], ha[keep], lb[keep], hb[keep], err[keep] + more))
        lo_a, hi_a, lo_b, hi_b, err = (np.concatenate(x) for x in zip(*out, strict=True))
        depth += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) for the nodes of the links that are not smallest themselves."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    hung = np.flatnonzero(root != np.arange(len(names)))
    return names[hung], names[root[hung]]


def links(prints: DataFrame, *, bits: int = 2, max_node: int = 200_000, split_bits: int = 8) -> DataFrame:
    """u, v: a spanning forest per task of the links between the distinct fingerprints in column fp."""
    c = F.col
    blocks = bits + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    turned = F.array(*(F.struct(F.lit(k).alias("block"), (F.shiftleft("fp", edges[k]).bitwiseOR(F.shiftrightunsigned("fp", 64 - edges[k])) if k else c("fp")).alias("turned"), F.lit(edges[k + 1] - edges[k]).alias("size")) for k in range(blocks)))
    rows = prints.select(F.inline(turned)).withColumn("key", F.expr("shiftrightunsigned(turned, 64 - size)"))
    hot = rows.groupBy("block", "key").agg(F.count("*").alias("n")).where(c("n") > max_node).select("block", "key", F.lit(True).alias("hot"))
    rows = rows.join(hot, ["block", "key"], "left").withColumn("cell", F.when(c("hot"), F.expr(f"shiftrightunsigned(shiftleft(turned, size), {64 - split_bits})")).otherwise(F.lit(0)))
    flips = [0] + [1 << i for i in range(split_bits)] + [(1 << i) | (1 << j) for i in range(split_bits) for j in range(i)]
    flips = [x for x in flips if bin(x).count("1") <= bits]
    targets = F.when(c("hot"), F.filter(F.transform(F.array(*map(F.lit, flips)), lambda x: c("cell").bitwiseXOR(x.cast("long"))), lambda x: x >= c("cell"))).otherwise(F.array(c("cell")))
    dealt = rows.withColumn("to", F.explode(targets)).select("block", "size", "key", "to", (c("to") != c("cell")).alias("guest"), "turned")
    dealt = dealt.repartition("block", "key", "to").sortWithinPartitions("block", "key", "to", "guest", F.col("turned").bitwiseXOR(F.lit(-(1 << 63))))

    def walk(block: int, size: int, group: np.ndarray, guest: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """group: number of the node each row belongs to, rows in order; own rows of a node stand before its guests."""
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        tails = np.append(heads[1:], len(group))
        guests = np.add.reduceat(guest, heads, dtype=np.int64)
        own = tails - guests
        some = own - heads > 1
        order = np.arange(len(v))
        i, j = _by_node(v, order, heads[some], own[some], size, bits)
        met = (guests > 0) & (own > heads)
        for lo, mid, hi in zip(heads[met], own[met], tails[met], strict=True):
            p, q = trie_links(v[lo:mid], v[mid:hi], np.array([[0, mid - lo, 0, hi - mid]]), size, bits, False)
            i, j = np.append(i, lo + p), np.append(j, mid + q)
        turn = np.uint64((64 - edges[block]) % 64), np.uint64(edges[block])
        back = (v << turn[0]) | (v >> turn[1]) if edges[block] else v
        return forest(back[i].view(np.int64), back[j].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if held.num_rows < 200_000:
                    continue
            if held is None or not held.num_rows:
                continue
            cols = {k: held[k].to_numpy() for k in ("block", "size", "key", "to", "guest", "turned")}
            new = np.concatenate([[True], (cols["block"][1:] != cols["block"][:-1]) | (cols["key"][1:] != cols["key"][:-1]) | (cols["to"][1:] != cols["to"][:-1])])
            group = np.cumsum(new)
            upto = len(group) if batch is None else int(np.flatnonzero(new)[-1])
            held = held.slice(upto) if batch is not None else None
            for block in np.unique(cols["block"][:upto]):
                mine = np.flatnonzero(cols["block"][:upto] == block)
                u, w = walk(int(block), int(cols["size"][mine[0]]), group[mine], cols["guest"][mine].astype(np.int64), cols["turned"][mine].view(np.uint64))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _by_node(v: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each of the ranges; ranges are compacted, so that one sorted array holds them all."""
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = hi - lo
    at = np.cumsum(width) - width
    picked = np.repeat(lo - at, width) + np.arange(width.sum())
    i, j = trie_links(v[picked], v[picked], np.stack([at, at + width, at, at + width], axis=1), size, bits, True)
    return order[picked[i]], order[picked[j]]


def grouped(docs: DataFrame, *, width: int = 3, bits: int = 2, seed: int = 42, max_node: int = 200_000) -> DataFrame:
    """doc_id, text_hash, fp, root (the component's smallest fingerprint) and component_id of every row."""
    prints = saved(fingerprints(docs, width=width, seed=seed), "simhash", 1000)
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    parts = components(links(classes.select("fp"), bits=bits, max_node=max_node), "simhash-links")
    rooted = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = saved(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id"), "simhash-components")
    discard(classes)
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return grouped(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, one of each component: the smallest doc_id (null last), then the smallest hash of the text."""
    c = F.col
    order = lambda text_hash: F.struct(F.coalesce(c("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), text_hash.alias("x"))
    first = grouped(docs, **options).groupBy("root").agg(F.min(order(c("text_hash"))).alias("f")).select("f.d", "f.x")
    kd, kx = unused(docs.columns, "d", "x")
    own = order(F.xxhash64(c("text").cast("string")))
    kept = docs.withColumns({kd: own["d"], kx: own["x"]}).join(first.toDF(kd, kx), [kd, kx], "left_semi")
    return kept.dropDuplicates([kd, kx]).select(*docs.columns)
