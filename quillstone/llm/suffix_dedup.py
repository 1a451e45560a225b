"""Long repeated byte strings by families of sparse suffix arrays.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed. Suffixes
are indexed at content-defined anchors: of each window of that length, the first position with the
smallest hash of ``k`` bytes. Equal windows have their anchor at the same place, so no repeat is
lost. Anchors whose k bytes occur once in all documents can't be in a repeat and are dropped before
any text moves. The other anchors are dealt out by their hash, each with the bytes around it.

Documents come in batches. An Index keeps a logarithmic family of levels: a new batch's anchors become
a run sorted by the hash of the bytes that follow (a sparse suffix array in shared storage), its keys are
merge-scanned against every level there is, and levels of equal rank are merged into one of the
next. Only anchors that a batch has in common with a level, or twice in itself, fetch the bytes
around them, which are dealt out by key and compared in the order of their suffixes; what
was compared in earlier batches isn't compared again. A task that is dealt many records works the same
way in memory: batches get suffix arrays, are merge-scanned against its levels, equal levels merge.
A scan looks at runs with k equal bytes and finds for each record how
far left and right of its anchor it lies in matches of the full length. Runs of few records compare
pairs; others intersect classes of equal left and right parts, level by level of the common-prefix
arrays, in linear space.

Keys with over ``max_run`` records are not gathered in one task. Their records with equal
surroundings cover each other whole, so one of each class stands for all. Where still over ``max_run``
classes share a key, they are regrouped by the longer cores that windows with similar splits share,
halving the interval of splits as long as a group is crowded; surroundings and cores are compared by
128-bit hashes.

Cases: null text is empty; texts under ``length`` bytes keep everything; matches never cross texts;
repeated rows are separate texts, so they cover each other; null and repeated doc_ids are fine.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekit import mix, slices, text_bytes
from .storage import discard, saved

_TABLE = np.random.default_rng(400).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15
_ID = "d long, x long"


def gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position on (k a power of two), by doubling."""
    h, size, r = _TABLE[buf], 1, _R
    while size < k:
        h = h[:-size] * np.uint64(r) + h[size:]
        size, r = 2 * size, r * r % (1 << 64)
    return mix(h)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-byte hashes of the anchors of all windows inside texts."""
    n, width = len(buf), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hash(buf, k)
    low = (h & ~np.uint64((1 << 32) - 1)) | np.arange(len(h), dtype=np.uint64)
    full = np.full(-(-len(low) // width) * width, np.uint64(2**64 - 1))
    full[: len(low)] = low
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[width - 1 : width + n - length])
    crossing = np.zeros(n + 1, np.int64)
    for edge in offsets[1:-1]:
        crossing[max(0, edge - length + 1)] += 1
        crossing[edge] -= 1
    inside = np.cumsum(crossing)[: n - length + 1] == 0
    at = np.unique((least[inside] & np.uint64((1 << 32) - 1)).astype(np.int64))
    return at, h[at]


def _find(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            buf, off = text_bytes(batch.column("text"))
            at, h = anchors(buf, off, length, k)
            doc = np.searchsorted(off, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(doc)), batch.column("x").take(pa.array(doc)), pa.array(at - off[doc]), pa.array(h.view(np.int64))], names=["d", "x", "pos", "key"])


def _surround(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each listed anchor with the bytes before it (back to the farthest window) and from it on."""
    for batch in batches:
        out: list[tuple] = []
        for d, x, old, text, found in zip(*(batch.column(c).to_pylist() for c in ("d", "x", "old", "text", "found")), strict=True):
            data = text.encode()
            for f in found:
                a = f["pos"]
                out.append((d, x, a, f["key"], old, data[max(0, a - length + k) : a], data[a : a + length]))
                if len(out) >= 20_000:
                    yield _records(out)
                    out = []
        if out:
            yield _records(out)


def _records(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["d", "x", "pos", "key", "old", "left", "right"])


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of one width, and their lengths."""
    size = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width), size


def common(m: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common prefix lengths of row pairs."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 10_000):
        p, q = i[a : a + 10_000], j[a : a + 10_000]
        differ = m[p] != m[q]
        first = differ.argmax(axis=1)
        out[a : a + 10_000] = np.minimum(np.where(differ.any(axis=1), first, m.shape[1]), np.minimum(size[p], size[q]))
    return out


class Level:
    """Records in suffix-array order: sorted by the bytes from the anchor on."""

    def __init__(self, records: list[tuple]):
        self.records = records

    @classmethod
    def of(cls, batch: list[tuple]) -> Level:
        return cls(sorted(batch))

    def merged(self, other: Level) -> Level:
        return Level(sorted(self.records + other.records))  # two runs: a linear merge


def scan(records: list[tuple], fresh: np.ndarray | None, length: int, k: int, reach: np.ndarray) -> None:
    """Widen reach (rows: bytes left and right of the anchor in full-length matches) for suffix-ordered records.

    records: (right, reversed left, ...). fresh: which belong to the new batch; runs without both
    kinds were seen before. None: all are new.
    """
    n = len(records)
    if n < 2:
        return
    right, r_size = _matrix([r[0] for r in records], length)
    left, l_size = _matrix([r[1] for r in records], length - k)
    up = common(right, r_size, np.arange(n - 1), np.arange(1, n))
    twin = np.zeros(n, bool)
    twin[1:] = (up == length) | ((up == r_size[1:]) & (up == r_size[:-1]))
    twin[1:] &= (left[1:] == left[:-1]).all(axis=1) & (l_size[1:] == l_size[:-1])  # records sort by right, then left: equal ones are neighbours
    whole = np.zeros(n, bool)
    whole[1:] |= twin[1:]
    whole[:-1] |= twin[1:]
    whole &= l_size + r_size >= length
    reach[whole] = np.maximum(reach[whole], np.stack([l_size, r_size], axis=1)[whole])
    kept = np.flatnonzero(~twin)
    start = np.concatenate([[True], np.minimum.reduceat(up, kept[:-1])[: len(kept) - 1] < k]) if len(kept) > 1 else np.ones(len(kept), bool)
    # equal records share one representative: between two representatives the common prefix is the least over all steps
    heads = np.flatnonzero(start)
    tails = np.append(heads[1:], len(kept))
    pairs_i, pairs_j = [], []
    new = fresh if fresh is not None else None
    for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
        m = t - h
        if m < 2:
            continue
        run = kept[h:t]
        if new is not None:
            some = new[run[0] : (kept[t] if t < len(kept) else n)]
            if some.all() or not some.any():
                continue
        if m <= 24:
            a, b = np.triu_indices(m, 1)
            pairs_i.append(run[a])
            pairs_j.append(run[b])
        else:
            steps = common(right, r_size, run[:-1], run[1:])
            order = np.array(sorted(range(m), key=lambda i: records[run[i]][1]))
            _wide(run, order, steps, left, l_size, r_size, length, reach)
    if pairs_i:
        i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
        r = common(right, r_size, i, j)
        some = r >= k
        i, j, r = i[some], j[some], r[some]
        lf = common(left, l_size, i, j)
        ok = lf + r >= length
        for a in (i[ok], j[ok]):
            np.maximum.at(reach[:, 0], a, lf[ok])
            np.maximum.at(reach[:, 1], a, r[ok])
    rep = kept[np.searchsorted(kept, np.arange(n), side="right") - 1]
    reach[:] = np.maximum(reach, reach[rep])


def _wide(run: np.ndarray, order: np.ndarray, up: np.ndarray, left: np.ndarray, l_size: np.ndarray, r_size: np.ndarray, length: int, reach: np.ndarray) -> None:
    """One long run: a record is in a match at split l if another shares its l bytes to the left and length - l to the right."""
    m = len(run)
    by_left = run[order]
    down = common(left, l_size, by_left[:-1], by_left[1:])
    for split in np.unique(np.concatenate([down, length - up])):
        if split < 0 or split > left.shape[1]:
            continue
        r_class = np.concatenate([[0], np.cumsum(up < length - split)])
        l_class = np.empty(m, np.int64)
        l_class[order] = np.concatenate([[0], np.cumsum(down < split)])
        _, at, many = np.unique(l_class * m + r_class, return_inverse=True, return_counts=True)
        hit = run[(many[at] > 1) & (l_size[run] >= split) & (r_size[run] >= length - split)]
        reach[hit, 0] = np.maximum(reach[hit, 0], split)
        reach[hit, 1] = np.maximum(reach[hit, 1], length - split)


class Family:
    """The levels of one task; add() and hold() return nothing, spans() the covered ranges so far."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k
        self.levels: list[tuple[int, Level]] = []
        self.owners: list[tuple] = []
        self.reach = np.zeros((0, 2), np.int64)

    def _scan(self, records: list[tuple], first_new: int | None) -> None:
        names = np.array([r[2] for r in records])
        local = np.zeros((len(records), 2), np.int64)
        scan(records, None if first_new is None else names >= first_new, self.length, self.k, local)
        self.reach[names] = np.maximum(self.reach[names], local)

    def _level(self, batch: list[tuple]) -> tuple[int, Level]:
        base = len(self.owners)
        self.owners += [r[:3] for r in batch]
        self.reach = np.concatenate([self.reach, np.zeros((len(batch), 2), np.int64)])
        return base, Level.of([(r[4], r[3][::-1], base + i) for i, r in enumerate(batch)])

    def hold(self, batch: list[tuple]) -> None:
        """Records of earlier batches of documents: a level of its own, not compared in itself."""
        self.levels.append((1 << 30, self._level(batch)[1]))

    def add(self, batch: list[tuple]) -> None:
        """batch: (d, x, pos, left, right) records."""
        base, level = self._level(batch)
        rank = 0
        self._scan(level.records, None)
        for _, other in self.levels:
            self._scan(level.merged(other).records, base)
        while self.levels and self.levels[-1][0] == rank:
            level, rank = level.merged(self.levels.pop()[1]), rank + 1
        self.levels.append((rank, level))

    def spans(self) -> pa.RecordBatch | None:
        hit = np.flatnonzero(self.reach.sum(axis=1) >= self.length)
        if not len(hit):
            return None
        d, x, pos = (np.array(c) for c in zip(*(self.owners[i] for i in hit), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(x), pa.array(pos - self.reach[hit, 0]), pa.array(pos + self.reach[hit, 1])], names=["d", "x", "begin", "until"])


def _match(batches: Iterator[pa.RecordBatch], length: int, k: int, batch_size: int) -> Iterator[pa.RecordBatch]:
    """lo: records of crowded keys come once per interval of splits; each interval has its own family."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for lo, old, *record in zip(*(batch.column(c).to_pylist() for c in ("lo", "old", "d", "x", "pos", "left", "right")), strict=True):
            held.setdefault(lo, ([], []))[old].append(record)
    while held:
        new, old = held.popitem()[1]
        family = Family(length, k)
        if old:
            family.hold(old)
        for a in range(0, len(new), batch_size):
            family.add(new[a : a + batch_size])
        if (out := family.spans()) is not None:
            yield out


def _two_hashes(core: Column) -> tuple[Column, Column]:
    """Independent 64-bit hashes: arguments are chained as seeds, so the literal comes first."""
    return F.xxhash64(core), F.xxhash64(F.lit(1), core)


def _sides(rows: DataFrame) -> DataFrame:
    """Records as the matching tasks take them, every split in one family."""
    return rows.select(F.lit(0).alias("lo"), "old", "d", "x", "pos", "key", "left", "right")


def collapsed(hot: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """One record of each class of equal surroundings of a key, and the spans that classes of more than one cover.

    A class of any size is summed up on the map side; a member is new if the class has a new one.
    """
    c = F.col
    g1, g2 = _two_hashes(F.concat_ws("", F.hex("left"), F.lit("|"), F.hex("right")))
    named = saved(hot.withColumns({"g1": g1, "g2": g2}), "repeats-crowded", 1000)
    by = ["key", "g1", "g2"]
    classes = named.groupBy(*by).agg(F.count("*").alias("n"), F.min("old").alias("old"), F.min(F.struct("d", "x", "pos", "left", "right")).alias("r"))
    classes = saved(classes.select(*by, "n", "old", "r.*"), "repeats-classes")
    many = classes.where((c("n") > 1) & (F.octet_length("left") + F.octet_length("right") >= length)).select(*by)
    members = named.select(*by, "d", "x", "pos", (c("pos") - F.octet_length("left")).alias("begin"), (c("pos") + F.octet_length("right")).alias("until"))
    spans = saved(members.join(many, by, "left_semi").select("d", "x", "begin", "until"), "repeats-twins")
    discard(named)
    return classes.drop("g1", "g2", "n"), spans


def refined(hot: DataFrame, length: int, k: int, max_run: int) -> tuple[DataFrame, DataFrame]:
    """Crowded records by what all windows of an interval of splits share: (d, x, pos, lo, g1, g2) groups, and covered spans.

    A window with l bytes left of the anchor, lo <= l <= hi, holds lo bytes to the left and
    length - hi from the anchor on. Records are grouped by that core;
    groups still crowded have their interval halved, down to one split, where the core is the window.
    """
    c = F.col
    where = ["lo", "hi", "g1", "g2"]

    def cores(rows: DataFrame) -> DataFrame:
        core = F.concat(F.substring("left", F.octet_length("left") - c("lo") + 1, c("lo")), F.substring("right", F.lit(1), length - c("hi")))
        fits = (F.octet_length("left") >= c("lo")) & (F.octet_length("right") >= length - c("hi"))
        return rows.where(fits).select("d", "x", "pos", "lo", "hi", *(h.alias(g) for h, g in zip(_two_hashes(core), ("g1", "g2"), strict=True)))

    mid = F.floor((c("lo") + c("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(c("lo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), c("hi").alias("b")))).alias("i")
    split = lambda rows: rows.select("*", halves).drop("lo", "hi").select("*", c("i.a").alias("lo"), c("i.b").alias("hi")).drop("i")
    now = split(hot.select("d", "x", "pos", "left", "right").withColumns({"lo": F.lit(0), "hi": F.lit(length - k)}))
    groups, spans = None, None
    while True:
        held = saved(cores(now), "repeats-cores")
        # only crowded groups are looked up: a row for every max_run records at most
        large = saved(held.groupBy(*where).agg(F.count("*").alias("n")).where(c("n") > max_run).select(*where), "repeats-large")
        known = F.broadcast(large) if large.limit(100_001).count() <= 100_000 else large
        live = held.join(known, where, "left_semi")
        few = held.join(known, where, "left_anti").select("d", "x", "pos", "lo", "g1", "g2")
        whole = live.where(c("lo") == c("hi")).select("d", "x", (c("pos") - c("lo")).alias("begin"), (c("pos") - c("lo") + length).alias("until"))
        groups, spans = (few, whole) if groups is None else (groups.unionByName(few), spans.unionByName(whole))
        crowded = live.where(c("lo") < c("hi")).select("d", "x", "pos", "lo", "hi")
        if not crowded.limit(1).count():
            return groups, spans
        now = split(crowded.distinct().join(hot.select("d", "x", "pos", "left", "right"), ["d", "x", "pos"]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text")):
        kept, spans, sizes = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = text.encode()
            merged: list[list[int]] = []
            for s in sorted((f["begin"], f["until"]) for f in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, pieces = 0, []
            for a, b in merged:
                pieces.append(data[at:a])
                at = b
            kept.append(b"".join([*pieces, data[at:]]) if merged else data)
            spans.append([{"begin": a, "until": b} for a, b in merged])
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("until", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _run(anchors_: DataFrame) -> DataFrame:
    """Anchors in files sorted by key; a key of any number of anchors is spread over many of them."""
    return anchors_.repartition("key", F.pmod(F.xxhash64("x"), F.lit(256))).sortWithinPartitions("key")


@dataclass
class Index:
    """What was added so far: levels (rank, table of anchors sorted by key), the batches' texts and the spans found.

    Texts are read where the caller keeps them, so the tables given to add() must stay readable.
    """

    length: int = 400
    k: int = 64
    max_run: int = 100_000
    batch_size: int = 32768
    task_bytes: int = 40 << 20
    levels: list[tuple[int, DataFrame]] = field(default_factory=list)
    texts: list[DataFrame] = field(default_factory=list)
    spans: list[DataFrame] = field(default_factory=list)

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch of documents: d, x (keys of documents), begin and until of what it covers, in itself and in earlier batches."""
        c = F.col
        length, k = self.length, self.k
        whole = keyed(docs).where(F.octet_length("text") >= length).select("d", "x", "text")
        found = whole.mapInArrow(partial(_find, length=length, k=k), f"{_ID}, pos long, key long")
        fresh = saved(_run(found), "repeats-level", 1000)
        counted, many = fresh.groupBy("key").agg(F.count("*").alias("new")), c("new")
        for i, (_, level) in enumerate(self.levels):  # merge-scans: both sides are sorted by key
            counted = counted.join(level.groupBy("key").agg(F.count("*").alias(f"old{i}")), "key", "left")
            many = many + F.coalesce(f"old{i}", F.lit(0))
        crowd = counted.select("key", many.alias("n")).where(c("n") > 1).withColumn("hot", c("n") > self.max_run)
        crowd = saved(crowd, "repeats-keys")
        records, some = crowd.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("hot"), F.lit(False))).first()
        anchored = fresh.withColumn("old", F.lit(False))
        texts = whole.withColumn("old", F.lit(False))
        for _, level in self.levels:
            anchored = anchored.unionByName(level.withColumn("old", F.lit(True)))
        for earlier in self.texts:
            texts = texts.unionByName(earlier.withColumn("old", F.lit(True)))

        def around(hot: bool) -> DataFrame:
            listed = anchored.join(crowd.where(c("hot") == hot).select("key"), "key").groupBy("d", "x", "old").agg(F.collect_set(F.struct("pos", "key")).alias("found"))
            joined = texts.join(listed, ["d", "x", "old"]).select("d", "x", "old", "text", "found")
            return joined.mapInArrow(partial(_surround, length=length, k=k), f"{_ID}, pos long, key long, old boolean, left binary, right binary")

        tasks = max(1, -(-records * 2 * length // self.task_bytes))
        match = partial(_match, length=length, k=k, batch_size=self.batch_size)
        shape = f"{_ID}, begin long, until long"
        spans = _sides(around(False)).repartition(tasks, "key").mapInArrow(match, shape)
        if some:
            classes, twins = collapsed(around(True), length)
            spans = spans.unionByName(twins)
            large = saved(classes.groupBy("key").agg(F.count("*").alias("n")).where(c("n") > self.max_run).select("key"), "repeats-large")
            spans = spans.unionByName(_sides(classes.join(large, "key", "left_anti")).repartition(tasks, "key").mapInArrow(match, shape))
            if large.limit(1).count():
                hot = saved(classes.join(large, "key"), "repeats-crowded")
                groups, covered = refined(hot, length, k, self.max_run)
                grouped = groups.distinct().join(hot, ["d", "x", "pos"]).repartition(tasks, "lo", "g1", "g2")
                spans = spans.unionByName(grouped.select("lo", "old", "d", "x", "pos", "left", "right").mapInArrow(match, shape)).unionByName(covered)
        out = saved(spans.distinct(), "repeats-spans", 1000)
        discard(crowd)
        level, rank = fresh, 0
        while self.levels and self.levels[-1][0] == rank:
            other = self.levels.pop()[1]
            merged = saved(_run(level.unionByName(other)), "repeats-level")
            discard(level, other)
            level, rank = merged, rank + 1
        self.levels.append((rank, level))
        self.texts.append(whole)
        self.spans.append(out)
        return out


def keyed(docs: DataFrame) -> DataFrame:
    """d and x (the id and a hash of the text), doc_id and text of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("x"), doc_id.alias("doc_id"), text.alias("text"))


def cut(docs: DataFrame, spans: list[DataFrame]) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, maximal) and kept (the remaining bytes) of every row."""
    listed = reduce(DataFrame.unionByName, spans).groupBy("d", "x").agg(F.collect_set(F.struct("begin", "until")).alias("spans"))
    joined = keyed(docs).join(listed, ["d", "x"], "left").select("doc_id", "text", "spans")
    # written in batches of bounded rows: an Arrow batch of 10,000 long texts is held several times over
    return saved(joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<begin:long,until:long>>, kept binary"), "repeats-kept", 1000)


def remove_repeats(docs: DataFrame, *, batches: int = 2, **options) -> DataFrame:
    """cut() of all documents, added to an index in batches dealt out by the hash of the text."""
    index = Index(**options)
    for b in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(batches)) == b))
    discard(*(level for _, level in index.levels))
    out = cut(docs, index.spans)
    discard(*index.spans)
    return out
