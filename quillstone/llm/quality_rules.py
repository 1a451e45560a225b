"""Quality rules: base rules, then robust multivariate outliers per language and source.

Every whole text becomes a vector of transformed statistics. Per (lang, source) the
minimum-covariance-determinant estimate (centre and covariance of the most concentrated share of
rows) is found by C-steps over all rows, from two starts (the median, and the plain mean and covariance),
each until its determinant falls no more; the smallest one counts. A document whose
Mahalanobis distance is too large is rejected. A C-step is one aggregation: rows are summed by group
and distance bin on the map side, so neither a hot source nor many groups put more than some hundred
rows per group in one task.

Every group has its own estimate, whatever its size. The same steps run for whole languages and for all
rows, and a group's centre and covariance are drawn towards those of its language, and the language's
towards those of all rows, with the weight of ``prior`` rows: a group of three
rows hardly departs from its language, one of thousands is its own.

Sums are taken over integers (statistics in steps of 1/1024), so results don't depend on the order
of rows or on retries. The concentrated share is rounded up to the edge of a distance bin.

Cases: null or empty text has no words and fails the base rules; a null lang or source is a group
of its own. Repeated rows and ids are separate rows.
Other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chi2
from .bytekit import SEP, lines, mix, per_span, seen_before, slices, span_hash, text_bytes, words
from .storage import saved

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")
DIMS = 6
SCALE = 1024
#: Smallest standard deviations of the transformed statistics: keeps the covariance regular where most rows have a zero.
FLOOR = (0.04, 0.06, 0.10, 0.10, 0.06, 0.03)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PAIRS = list(combinations_with_replacement(range(DIMS), 2))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            buf, off = text_bytes(batch.column("text"))
            n = len(off) - 1
            start, end, doc = words(buf, off)
            count = lambda of, w=None: np.bincount(of, w, n).astype(np.int64)
            h = span_hash(buf, start, end)
            char = (buf & 0xC0) != 0x80
            out = {"n_words": count(doc), "word_chars": per_span(char & ~SEP[buf], off[:-1], off[1:]), "n_symbols": per_span(_SYMBOL[buf], off[:-1], off[1:])}
            ls, le, ld = lines(buf, off)
            worded = per_span(~SEP[buf], ls, le) > 0
            ls, le, ld = ls[worded], le[worded], ld[worded]
            again, _ = seen_before(mix(span_hash(buf, ls, le) ^ mix(ld.astype(np.uint64))))
            out |= {"n_dup_lines": count(ld, again), "n_lines": count(ld), "n_upper": per_span((buf >= 65) & (buf <= 90), off[:-1], off[1:])}
            known, _ = seen_before(mix(h ^ mix(doc.astype(np.uint64))))
            out["n_distinct"] = count(doc, ~known)
            covered = np.zeros(len(h) + 1, np.int64)
            if len(h) >= 5:
                window = mix(doc[:-4].astype(np.uint64))
                for k in range(5):
                    window = mix(window ^ h[k : len(h) - 4 + k])
                inside = np.flatnonzero(doc[:-4] == doc[4:])
                _, twin = seen_before(window[inside])
                np.add.at(covered, inside[twin], 1)
                np.add.at(covered, inside[twin] + 5, -1)
            out["n_repeat_words"] = count(doc, np.cumsum(covered)[:-1] > 0)
            kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[k]) for k in STATS)], names=["doc_id", "lang", "source", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of STATS for every row."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(_stats, "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in STATS))


def _vector() -> list:
    """The transformed statistics in steps of 1 / SCALE; a prior of 20 average words steadies short texts."""
    c = F.col
    n = c("n_words").cast("double")
    share = lambda x, of: F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / of))))
    raw = [
        F.log((c("word_chars") + 120.0) / (n + 20.0)),
        share(c("n_symbols"), c("word_chars") + 20.0),
        share(c("n_dup_lines"), c("n_lines") + 3.0),
        share(c("n_repeat_words"), n + 20.0),
        share(c("n_upper"), c("word_chars") + 40.0),
        F.log(c("n_distinct") + 20.0) / F.log(n + 20.0),
    ]
    return [F.round(x * SCALE).cast("long").alias(f"z{i}") for i, x in enumerate(raw)]


_KEYS = ("level", "g_lang", "g_source")
_MODEL = "level int, g_lang string, g_source string, start int, n long, m long, size double, better boolean, centre array<double>, cov array<double>, coef array<double>"
#: Models are sent to all tasks up to so many rows (half a kilobyte each), else joined by shuffling.
SEND = 50_000


def _coefficients(cov: np.ndarray) -> tuple[list[float], float]:
    """Coefficients of the squared distance, and the log determinant; the floor keeps both finite."""
    whole = cov + np.diag((np.array(FLOOR) * SCALE) ** 2)
    precision = np.linalg.inv(whole)
    return [float(precision[i, j] * (1 if i == j else 2)) for i, j in _PAIRS], float(np.linalg.slogdet(whole)[1])


def _square(flat: list[float]) -> np.ndarray:
    out = np.zeros((DIMS, DIMS))
    for x, (i, j) in zip(flat, _PAIRS, strict=True):
        out[i, j] = out[j, i] = x
    return out


def _estimate(key: tuple, bins: pd.DataFrame, share: float) -> pd.DataFrame:
    """Centre and covariance of the bins of the nearest rows that hold the share; start 1 begins with all rows."""
    *names, start, first, was = key
    bins = bins.sort_values("bin")
    n = int(bins["n"].sum())
    part = 1.0 if first and start == 1 else share
    upto = int(np.searchsorted(bins["n"].cumsum().to_numpy(), np.ceil(part * n))) + 1
    near = bins.iloc[:upto]
    m = int(near["n"].sum())
    sums = [int(near[f"s{i}"].sum()) for i in range(DIMS)]
    centre = np.array(sums, float) / m
    squares = [sum(map(int, near[f"q{i}_{j}"])) for i, j in _PAIRS]
    cov = _square([q / m - centre[i] * centre[j] for q, (i, j) in zip(squares, _PAIRS, strict=True)])
    held = min(1.0, m / n)
    cov *= held / chi2.cdf(chi2.quantile(held, DIMS), DIMS + 2) if held < 1 else 1.0
    coef, size = _coefficients(cov)
    return pd.DataFrame({**{k: [v] for k, v in zip(_KEYS, names, strict=True)}, "start": [start], "n": [n], "m": [m], "size": [size], "better": [size < was - 1e-9], "centre": [list(centre)], "cov": [[float(cov[i, j]) for i, j in _PAIRS]], "coef": [coef]})


def _drawn(batches: Iterator[pd.DataFrame], prior: float) -> Iterator[pd.DataFrame]:
    """Each group's model, drawn towards its language's, and that towards the model of all rows."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            centre, cov = np.array(r.all_centre), _square(r.all_cov)
            for m, own, own_cov in ((r.lang_m, r.lang_centre, r.lang_cov), (r.m, r.centre, r.cov)):
                w = m / (m + prior)
                apart = np.array(own) - centre
                # the spread of two centres is part of the spread of the mixture
                cov = w * _square(own_cov) + (1 - w) * (cov + w * np.outer(apart, apart))
                centre = centre + w * apart
            out.append((r.g_lang, r.g_source, list(centre), _coefficients(cov)[0]))
        yield pd.DataFrame(out, columns=["k_lang", "k_source", "centre", "coef"])


def _distance() -> F.Column:
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        d = lambda x: F.col(f"z{x}") - F.get("centre", F.lit(x))
        total = total + F.get("coef", F.lit(k)) * d(i) * d(j)
    return F.greatest(total, F.lit(0.0))


def _sent(model: DataFrame) -> DataFrame:
    return F.broadcast(model) if model.limit(SEND + 1).count() <= SEND else model


def estimates(rows: DataFrame, *, share: float = 0.75, prior: float = 30.0, steps: int = 20) -> DataFrame:
    """k_lang, k_source, centre and coef (of the squared distance) of every group of rows (k_lang, k_source, z0, z1, ...)."""
    c = F.col
    z = [f"z{i}" for i in range(DIMS)]
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("g_lang"), source.alias("g_source"))
    none = F.lit("")
    every = rows.select(F.explode(F.array(level(0, none, none), level(1, c("k_lang"), none), level(2, c("k_lang"), c("k_source")))).alias("g"), *z).select("g.*", *z)
    medians = every.groupBy(*_KEYS).agg(*(F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(z)))
    weight = [F.lit(1.0 / (2 * FLOOR[i] * SCALE) ** 2 if i == j else 0.0) for i, j in _PAIRS]
    begun = medians.select(*_KEYS, F.explode(F.array(F.lit(0), F.lit(1))).alias("start"), F.lit(float("inf")).alias("size"), F.array(*(f"m{i}" for i in range(DIMS))).alias("centre"), F.array(*weight).alias("coef"))
    model = saved(begun, "quality-starts")
    bin_of = F.round(8 * F.log2(_distance() + 1e-3)).cast("int").alias("bin")
    sums = [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(z)), *(F.sum((c(f"z{i}") * c(f"z{j}")).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"q{i}_{j}") for i, j in _PAIRS)]
    found = []
    for step in range(steps):
        moving = model.select(*_KEYS, "start", c("size").alias("was"), "centre", "coef")
        bins = every.join(_sent(moving), list(_KEYS)).withColumn("bin", bin_of).groupBy(*_KEYS, "start", "was", "bin").agg(*sums)
        after = bins.withColumn("first", F.lit(step == 0)).groupBy(*_KEYS, "start", "first", "was").applyInPandas(lambda key, pdf: _estimate(key, pdf, share), _MODEL)
        model = saved(after.where("better"), "quality-mcd")
        if not model.limit(1).count():
            break
        found.append(model)
    model = reduce(DataFrame.unionByName, found) if found else model
    best = Window.partitionBy(*_KEYS).orderBy("size", "start", "m")
    chosen = model.withColumn("k", F.row_number().over(best)).where(c("k") == 1)
    part = lambda k, name: chosen.where(c("level") == k).select("g_lang", c("m").alias(f"{name}_m"), c("centre").alias(f"{name}_centre"), c("cov").alias(f"{name}_cov"))
    whole = chosen.where(c("level") == 2).join(F.broadcast(part(0, "all").drop("g_lang")), F.lit(True)).join(part(1, "lang"), "g_lang")  # one row stands for all
    return whole.mapInPandas(lambda batches: _drawn(batches, prior), "k_lang string, k_source string, centre array<double>, coef array<double>")


def rules(docs: DataFrame, *, share: float = 0.75, cutoff: float = 0.99999, prior: float = 30.0, steps: int = 20) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared Mahalanobis, null where the base rules failed) and kept.

    share: part of a group taken as its concentrated rows. cutoff: chi-square probability beyond
    which a document is an outlier. prior: rows that the surrounding group's estimate weighs. steps:
    C-steps at most.
    """
    c = F.col
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    keys = {"base_failed": failed, "k_lang": F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("n")), "k_source": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))}
    keyed = saved(statistics(docs).withColumns(keys).select("doc_id", *STATS, "base_failed", "k_lang", "k_source", *_vector()), "quality-stats", 1000)
    model = saved(estimates(keyed.where(~c("base_failed")), share=share, prior=prior, steps=steps), "quality-models")
    scored = keyed.join(_sent(model), ["k_lang", "k_source"], "left").withColumn("distance", F.when(~c("base_failed"), _distance()))
    kept = ~c("base_failed") & F.coalesce(c("distance") <= chi2.quantile(cutoff, DIMS), F.lit(True))
    return scored.select("doc_id", *STATS, "base_failed", "distance", kept.alias("kept"))
