"""SimHash near-dedup judged by word shingles: every pair of texts with a Jaccard similarity of at least ``threshold``.

A text is the set of its shingles of ``width`` words (lower case, one space between words; a shorter
text is one shingle), each a 64-bit hash. Texts with equal sets are one node. First the nodes'
SimHash fingerprints go through the binary-trie self-join: links within ``bits`` bits are candidates, and
those whose whole sets are similar enough join their nodes. That settles most of a group of close
copies at a cost in proportion to its size.

No bit budget can promise the threshold (pairs of 0.8 differ by some ten bits of 64), so the pairs that
fingerprints miss are completed exactly: of two similar sets
both hold a common shingle among their first s - ceil(threshold * s) + 1 in any one order, here the
rarest first (by the frequency of hash buckets, a table of fixed size). These prefixes meet by shingle under
length and position filters, and each pair that meets, and isn't joined yet, is verified on its
whole sets before components are formed.

A shingle in over ``hot`` prefixes would pair whole groups of near copies: its sets first meet the
one with the smallest id, and only those that this leaves outside its component meet all others.
Nothing is capped: every similar pair is verified or already has both ends in one component.

Cases: null, empty and blank texts have the empty set and are one node. A null doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .bytekit import LOWER, slices, span_hash, text_bytes
from .components import components
from .simhash import links as trie_self_join
from .simhash import single_spaced
from .storage import discard, saved, unused


#: Hash buckets of the rarity table: one byte each.
BUCKETS = 1 << 20


def shingle_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, one text after the other, and the n + 1 offsets."""
    buf, off = text_bytes(column)
    n = len(off) - 1
    out, start, end, doc = single_spaced(LOWER[buf], off)
    if not len(doc):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    count = np.bincount(doc, minlength=n)
    last = np.cumsum(count)
    word = np.arange(len(doc))
    first = word[(word + width <= last[doc]) | ((count[doc] < width) & (word == last[doc] - count[doc]))]
    until = np.minimum(first + width, last[doc[first]]) - 1
    h, of = span_hash(out, start[first], end[until]), doc[first]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n))])


def _least_shared(a, b, threshold: float):
    return np.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """Eighths of log2 of the shingles in each hash bucket, repeats within a text counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                np.add.at(seen, _bucket(shingle_sets(batch.column("text"), width)[0]), 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["b", "k"])

    total = docs.select("text").mapInArrow(run, "b long, k long").groupBy("b").agg(F.sum("k").alias("k"))
    table = total.select(F.col("b").cast("int"), F.least(F.lit(255), F.floor(8 * F.log2(F.col("k").cast("double")))).cast("short").alias("r")).toArrow()
    ranks = np.zeros(BUCKETS, np.uint8)
    ranks[table["b"].to_numpy()] = table["r"].to_numpy()
    return ranks


def fingerprints(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit SimHash of each set of hashes: the bits that over half of them have."""
    s = np.diff(off)
    out, full = np.zeros(len(s), np.uint64), np.flatnonzero(s)
    if len(full):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, off[:-1][full], axis=0, dtype=np.int64)
        out[full] = np.packbits(sums * 2 > s[full][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _identified(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """d, x, id (of the shingle set), fp (its fingerprint), s (its size) and prefix (its rarest hashes) of every row."""
    ranks = docs.sparkSession.sparkContext.broadcast(rarity(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                h, off = shingle_sets(batch.column("text"), width)
                s = np.diff(off)
                ids = np.fromiter((xxh3_64_intdigest(h[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.uint64, len(s))
                take = np.where(s > 0, s - np.ceil(threshold * s - 1e-9).astype(np.int64) + 1, 0)
                at = np.cumsum(take) - take
                picked = np.repeat(off[:-1] - at, take) + np.arange(take.sum())
                rare = h[np.lexsort((h, ranks.value[_bucket(h)], np.repeat(np.arange(len(s)), s)))]
                prefix = pa.ListArray.from_arrays(pa.array(np.append(at, take.sum()), pa.int32()), pa.array(rare[picked].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("x"), pa.array(ids.view(np.int64)), pa.array(fingerprints(h, off).view(np.int64)), pa.array(s.astype(np.int32)), prefix], names=["d", "x", "id", "fp", "s", "prefix"])

    return docs.select("d", "x", "text").mapInArrow(run, "d long, x long, id long, fp long, s int, prefix array<long>")


def _met(rows: DataFrame, threshold: float, hot: int) -> DataFrame:
    """u, v of the pairs of rows (id, s, pos, token) that may be similar; rows of crowded tokens come again with v null."""
    parted = rows.repartition("token").sortWithinPartitions("token", "id")

    def pairs(ids: np.ndarray, s: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.minimum(s[i] - pos[i], s[j] - pos[j]) >= _least_shared(s[i], s[j], threshold)
        return ids[i[ok]], ids[j[ok]]

    def emit(u, v=None, token=None, s=None, pos=None) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(u), kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(u), none(pa.int64()) if v is None else pa.array(v), none(pa.int64()) if token is None else pa.array(token), none(pa.int32()) if s is None else pa.array(s), none(pa.int32()) if pos is None else pa.array(pos)],
            names=["u", "v", "token", "s", "pos"],
        )

    def whole_runs(token, ids, s, pos) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.append(heads, len(token)))
        for size in np.unique(n[(n > 1) & (n <= hot)]):
            i, j = np.triu_indices(size, 1)
            step = max(1, (1 << 20) // len(i))
            at = heads[n == size]
            for k in range(0, len(at), step):
                some = at[k : k + step, None]
                yield emit(*pairs(ids, s, pos, (some + i).ravel(), (some + j).ravel()))
        for a, size in zip(heads[n > hot], n[n > hot], strict=True):
            one = slice(a, a + size)
            yield emit(*pairs(ids, s, pos, np.full(size - 1, a), np.arange(a + 1, a + size)))
            yield emit(ids[one], None, token[one], s[one], pos[one])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = ("token", "id", "s", "pos"), [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in names])
            size += batch.num_rows
            if size < 200_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            upto = int(np.searchsorted(cols[0], cols[0][-1]))  # tokens ascend; the last run may go on
            yield from whole_runs(*(x[:upto] for x in cols)) if upto else ()
            held, size = [[x[upto:] for x in cols]], 0
        if held:
            yield from whole_runs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return parted.select("token", "id", "s", "pos").mapInArrow(run, "u long, v long, token long, s int, pos int")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    held = docs.join(nodes.join(wanted, "id").select("id", "first.d", "first.x"), ["d", "x"]).dropDuplicates(["id"]).select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                h, off = shingle_sets(batch.column("text"), width)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["id", "h"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = shared >= threshold * (len(x) + len(y) - shared) - 1e-9
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    hashed = saved(held.mapInArrow(sets, "id long, h binary"), "shingles-sets", 1000)
    both = pairs.join(hashed.select(F.col("id").alias("u"), F.col("h").alias("a")), "u").join(hashed.select(F.col("id").alias("v"), F.col("h").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(similar, "u long, v long")


def _close(nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs (u, v) of nodes that the trie self-join links, or that share a fingerprint: a forest, not all pairs."""
    c = F.col
    classes = saved(nodes.groupBy("fp").agg(F.min("id").alias("first_id")), "shingles-prints")
    twins = nodes.join(classes, "fp").where(c("id") != c("first_id")).select(c("id").alias("u"), c("first_id").alias("v"))
    hung = saved(trie_self_join(classes.select("fp"), bits=bits).distinct(), "shingles-trie")
    named = lambda side: classes.select(c("fp").alias(side), c("first_id").alias(f"{side}_id"))
    linked = hung.join(named("u"), "u").join(named("v"), "v").select(c("u_id").alias("u"), c("v_id").alias("v"))
    out = saved(linked.union(twins).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "shingles-close")
    discard(classes, hung)
    return out


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    root = lambda side: parts.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    both = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
    return both.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def _may_match(threshold: float) -> Column:
    y, z = (lambda k: F.col(f"y.{k}")), (lambda k: F.col(f"z.{k}"))
    need = F.ceil((y("s") + z("s")) * (threshold / (1 + threshold)) - 1e-9)
    return F.least(y("s") - y("pos"), z("s") - z("pos")) >= need


def one_of_each_similar(docs: DataFrame, *, width: int = 5, threshold: float = 0.8, bits: int = 3, hot: int = 256) -> DataFrame:
    """The rows of docs, one of each component of similar texts: the smallest doc_id (null last), then the smallest hash of the text."""
    c = F.col
    text = c("text").cast("string")
    d, x = F.coalesce(c("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(text)
    keyed = docs.select(d.alias("d"), x.alias("x"), text.alias("text"))
    sets = saved(_identified(keyed, width, threshold), "shingles", 1000)
    nodes = saved(sets.groupBy("id").agg(F.min(F.struct("d", "x")).alias("first"), F.min("fp").alias("fp")), "shingles-nodes")
    close = _close(nodes, bits)
    near = saved(_verified(close, nodes, keyed, width, threshold), "shingles-near")
    known = components(near, "shingles-known")
    rows = sets.dropDuplicates(["id"]).select("id", "s", F.posexplode("prefix").alias("pos", "token"))
    met = saved(_met(rows, threshold, hot), "shingles-met")
    pairs = saved(_apart(met.where(c("v").isNotNull()).select("u", "v").distinct(), known), "shingles-pairs")
    links = near.union(saved(_verified(pairs, nodes, keyed, width, threshold), "shingles-links"))
    parts = components(links, "shingles-parts")
    crowded = met.where(c("v").isNull()).select(c("u").alias("id"), "token", "s", "pos")
    if crowded.limit(1).count():
        rooted = crowded.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        rooted = saved(rooted, "shingles-crowded")
        star = rooted.groupBy("token").agg(F.min(F.struct("id", "root")).alias("f")).select("token", c("f.root").alias("centre"))
        outside = rooted.join(star, "token").where(c("root") != c("centre")).drop("centre")
        more = outside.alias("y").join(rooted.alias("z"), (c("y.token") == c("z.token")) & (c("y.root") != c("z.root")) & _may_match(threshold))
        more = more.select(F.least("y.id", "z.id").alias("u"), F.greatest("y.id", "z.id").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti")
        links = links.union(saved(_verified(saved(more, "shingles-rest"), nodes, keyed, width, threshold), "shingles-links"))
        parts = components(links, "shingles-parts")
    named = nodes.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = saved(named.groupBy("root").agg(F.min("first").alias("f")).select("f.d", "f.x"), "shingles-first")
    discard(sets, met, pairs, nodes, close, near, known)
    kd, kx = unused(docs.columns, "d", "x")
    kept = docs.withColumns({kd: d, kx: x}).join(first.toDF(kd, kx), [kd, kx], "left_semi")
    return kept.dropDuplicates([kd, kx]).select(*docs.columns)
