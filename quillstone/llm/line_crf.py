"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line gets statistics of itself and of its neighbours; the chain labels every line good or bad.
A document's score is the mean of its lines' forward-backward marginals of "good", weighted by
their lengths. The field is fitted to maximum conditional likelihood (with a ridge) on labelled
documents, whose lines take the document's label.

Fitting reads at most ``max_train`` labelled documents of ``max_lines`` lines in all, those with the smallest
hashes of their ids, of a repeated id one row; line statistics are made on the executors and only they
reach the driver. Scoring is one pass over all whole texts.

Cases: null or empty text is one empty line; a null doc_id counts as remainder 0 (not held out) but
has no label; of several labels of a document the mean counts, rounded up at a half; null labels
are dropped; without labels of both kinds every score is 0.5. Repeated rows and ids are scored each
for itself. Only doc_id (for folds and labels) and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import SEP, lines, mix, per_span, seen_before, slices, span_hash, text_bytes, words
from .storage import saved

OWN = 12
#: Statistics that the line before and the line after also lend.
LENT = (1, 2, 3, 6, 7)
FEATURES = OWN + 2 * len(LENT) + 2


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _PUNCT, _DIGIT = _class(b"#*$%&|<>"), _class(b".,;:!?\"'()[]{}-_/\\@=+~^`"), _class(b"0123456789")
_UPPER = _class(bytes(range(65, 91)))
_LETTER = _UPPER | _class(bytes(range(97, 123))) | (np.arange(256) >= 0xC0)


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, text numbers and weights (bytes + 1) of all lines."""
    start, end, doc = lines(buf, off)
    count = lambda flags: per_span(flags, start, end).astype(np.float64)
    ws, we, wd = words(buf, off)
    h = span_hash(buf, ws, we)
    line = np.searchsorted(start, ws, side="right") - 1
    while len(line) and (bad := end[line] <= ws).any():  # an empty line shares its start with the next one
        line[bad] += 1
    n = len(start)
    n_words = np.bincount(line, minlength=n).astype(np.float64)
    again, _ = seen_before(mix(h ^ mix(wd.astype(np.uint64))))
    twice, _ = seen_before(mix(h ^ mix(line.astype(np.uint64) + np.uint64(1 << 40))))
    copied, _ = seen_before(mix(span_hash(buf, start, end, 5) ^ mix(doc.astype(np.uint64))))
    letters, per_word = count(_LETTER[buf]), np.maximum(n_words, 1)
    own = np.zeros((n, OWN))
    own[:, 0] = 1
    own[:, 1] = count(_UPPER[buf]) / np.maximum(letters, 1)
    own[:, 2] = np.minimum(count(_SYMBOL[buf]) / per_word, 3)
    own[:, 3] = np.minimum(count(_PUNCT[buf]) / per_word, 3)
    own[:, 4] = count(_DIGIT[buf]) / np.maximum(end - start, 1)
    own[:, 5] = np.minimum(count(~SEP[buf]) / per_word / 10, 3)
    own[:, 6] = np.bincount(line, again, n) / per_word
    own[:, 7] = copied & (n_words > 0)
    own[:, 8] = n_words == 0
    own[:, 9] = np.log1p(n_words) / 5
    own[:, 10] = np.bincount(line, twice, n) / per_word
    own[:, 11] = letters / np.maximum(end - start, 1)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    last = np.concatenate([doc[1:] != doc[:-1], [True]])
    before, after = np.zeros((n, len(LENT))), np.zeros((n, len(LENT)))
    before[1:], after[:-1] = own[:-1, LENT], own[1:, LENT]
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None]]), doc, (end - start + 1).astype(np.float64)


class Chains:
    """Lines of many documents, time-major: step t holds the t-th lines of the documents that have one."""

    def __init__(self, doc: np.ndarray):
        n = int(doc[-1]) + 1 if len(doc) else 0
        size = np.bincount(doc, minlength=n)
        head = np.cumsum(size) - size
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.live = np.searchsorted(-size, -np.arange(1, (size[0] if n else 0) + 1), side="right")
        self.steps = [head[self.order[:m]] + t for t, m in enumerate(self.live)]

    def marginals(self, s: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) per line, expected transitions (2, 2), log partition; s: score of good against bad."""
        forward = np.zeros((len(s), 2))
        log = np.logaddexp
        for t, at in enumerate(self.steps):
            a = forward[at - 1] if t else None
            now = np.stack([log(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0]), log(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1])], axis=1) if t else np.zeros((len(at), 2))
            now[:, 1] += s[at]
            forward[at] = now
        backward = np.zeros((len(s), 2))
        pairs = np.zeros((2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            b = backward[at] + np.stack([np.zeros(len(at)), s[at]], axis=1)
            backward[at - 1] = np.stack([log(trans[0, 0] + b[:, 0], trans[0, 1] + b[:, 1]), log(trans[1, 0] + b[:, 0], trans[1, 1] + b[:, 1])], axis=1)
            z = log(*(forward[at - 1] + backward[at - 1]).T)
            for i in (0, 1):
                for j in (0, 1):
                    pairs[i, j] += np.exp(forward[at - 1][:, i] + trans[i, j] + b[:, j] - z).sum()
        total = log(*(forward + backward).T)
        first = self.steps[0] if self.steps else np.zeros(0, np.int64)
        return np.exp(forward[:, 1] + backward[:, 1] - total), pairs, float(total[first].sum())


def fit(x: np.ndarray, doc: np.ndarray, good: np.ndarray, *, rounds: int = 120, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions; good: label of every line. Deterministic: full gradients, Adam steps."""
    chains, n = Chains(doc), len(x)
    inner = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[:-1][inner], good[1:][inner]), 1)
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p, pairs, _ = chains.marginals(x @ w[:-4], w[-4:].reshape(2, 2))
        g = np.concatenate([(good - p) @ x, (seen - pairs).ravel()]) / n - ridge * w / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-4], w[-4:].reshape(2, 2)


def score_texts(buf: np.ndarray, off: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document scores, and P(good) and text number of each line."""
    x, doc, weight = line_features(buf, off)
    p, _, _ = Chains(doc).marginals(x @ w, trans)
    return np.clip(np.round(np.bincount(doc, p * weight) / np.bincount(doc, weight), 12), 0, 1), p, doc


def _held_out(folds: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % folds == 1


def training_rows(docs: DataFrame, labels: DataFrame, *, folds: int = 3, max_train: int = 4000, max_lines: int = 400_000) -> DataFrame:
    """doc_id, text and good of the documents that the field is fitted to."""
    c = F.col
    known = labels.where(c("quality").isNotNull() & c("doc_id").isNotNull() & ~_held_out(folds)).groupBy(c("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("long").alias("good"))
    # a row per document of the sample at most, here and below
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    slim = docs.select(c("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("x"))
    lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines")
    sizes = slim.join(chosen, "doc_id").select("doc_id", "good", "x", lines).groupBy("doc_id", "good").agg(F.min(F.struct("x", "lines")).alias("f"))
    found = sizes.select("doc_id", "good", "f.x", "f.lines", F.xxhash64("doc_id").alias("order")).toPandas().sort_values(["order", "doc_id"])
    taken = found[(found["lines"] + 1).cumsum() <= max_lines]
    fixed = docs.sparkSession.createDataFrame([tuple(map(int, r)) for r in taken[["doc_id", "x", "good"]].itertuples(index=False)], "doc_id long, x long, good long")
    return slim.join(F.broadcast(fixed), ["doc_id", "x"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "good")


def fit_documents(docs: DataFrame, labels: DataFrame, *, folds: int = 3, max_train: int = 4000, max_lines: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights and transitions; labels: doc_id and quality (0 or 1).

    Documents whose crc32(doc_id as text) leaves remainder 1 are held out.
    """
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x, doc, _ = line_features(*text_bytes(batch.column("text")))
                rows = np.split(x.astype(np.float32), np.flatnonzero(np.diff(doc)) + 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "good", "x"])

    rows = training_rows(docs, labels, folds=folds, max_train=max_train, max_lines=max_lines)
    train = rows.mapInArrow(described, "doc_id long, good long, x binary").toPandas().sort_values(["doc_id", "x"])
    if train["good"].nunique() < 2:
        return np.zeros(FEATURES), np.zeros((2, 2))
    parts = [np.frombuffer(b, np.float32).reshape(-1, FEATURES).astype(np.float64) for b in train["x"]]
    size = np.array([len(p) for p in parts])
    return fit(np.vstack(parts), np.repeat(np.arange(len(parts)), size), np.repeat(train["good"].to_numpy(np.int64), size))


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 3, max_train: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted and line_scores (P(good) per line) of every row."""
    w, trans = fit_documents(docs, labels, folds=folds, max_train=max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                score, p, doc = score_texts(*text_bytes(batch.column("text")), w, trans)
                size = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(score)))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(p))], names=["doc_id", "score", "line_scores"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, line_scores array<double>")
    return saved(scored, "crf-scores", 1000).select("doc_id", _held_out(folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "line_scores")


def keep_good(docs: DataFrame, labels: DataFrame, *, folds: int = 3, max_train: int = 4000) -> DataFrame:
    """The rows of docs, all columns, that score at least 0.5."""
    w, trans = fit_documents(docs, labels, folds=folds, max_train=max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                score, _, _ = score_texts(*text_bytes(batch.column("text")), w, trans)
                yield batch.filter(pa.array(score >= 0.5))

    return saved(docs.mapInArrow(run, docs.schema), "crf-kept", 1000)
