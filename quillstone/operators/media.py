"""Similarity of media by bags of visual or acoustic words.

Descriptors (rows of key and vector) are quantised by a codebook into histograms, weighted by
inverse document frequency and compared by cosine. Two scorers: the sequential one compares the
weighted query with raw histograms of all rows, the inverted one compares weighted with weighted
over shared codewords. Descriptors come from a table or from an extractor over files.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keypoints import orb, sift
from .resample import resized

IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff", "gif", "webp")
SOUNDS = ("mp3", "wav", "flac", "ogg", "m4a", "aac")


def media_type(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end.isin(*IMAGES), "image").when(end.isin(*SOUNDS), "audio")


def type_of(name: str) -> str | None:
    """The same of one name."""
    end = name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    return "image" if end in IMAGES else "audio" if end in SOUNDS else None


def file_name(pattern: str, key: str, columns: list[str]) -> Column:
    """The file of a row: {id} is the key, {column} any column."""
    out = F.replace(F.lit(pattern), F.lit("{id}"), F.col(key).cast("string"))
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return out


def kind_of(feature: str) -> str:
    """The media that a feature describes."""
    return "image" if feature in ("SIFT", "ORB", "HOG") else "audio"


def samples(data: bytes, rate: int | None = None, seconds: float = 30.0) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] of a PCM WAV file, interpolated to a rate; none if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            own, width = f.getframerate(), f.getsampwidth()
            raw = np.frombuffer(f.readframes(int(min(f.getnframes(), seconds * own))), {1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(float)
            raw = (raw - 128 * (width == 1)) / float(1 << (8 * width - 1))
            x = raw.reshape(-1, f.getnchannels()).mean(axis=1)
    except Exception:
        return np.zeros(0), rate or 1
    if rate is None or rate == own or not len(x):
        return x, own
    at = np.arange(int(len(x) * rate / own)) * own / rate
    return np.interp(at, np.arange(len(x)), x), rate


def spectral(data: bytes) -> np.ndarray:
    """Centroid, roll-off and zero crossings of the windows of a PCM WAV file; none if it can't be read."""
    raw, rate = samples(data)
    n = len(raw) // 512
    if not n:
        return np.zeros((0, 3))
    windows = raw[: n * 512].reshape(n, 512)
    power = np.abs(np.fft.rfft(windows, axis=1))
    freq = np.fft.rfftfreq(512, 1 / rate)
    total = np.maximum(power.sum(axis=1), 1e-9)
    roll = freq[(power.cumsum(axis=1) >= 0.85 * total[:, None]).argmax(axis=1)]
    cross = (np.diff(np.signbit(windows), axis=1) != 0).mean(axis=1)
    return np.stack([(power * freq).sum(axis=1) / total, roll, cross], axis=1)


#: Of MFCC and chroma: samples a second, window, step.
RATE, WINDOW, HOP = 22050, 2048, 512


def power_frames(x: np.ndarray) -> np.ndarray:
    """Power spectra (frames, bins) of Hann windows around every step."""
    if not len(x):
        return np.zeros((0, WINDOW // 2 + 1))
    padded = np.pad(x, WINDOW // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    return np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2


def mel(hz: np.ndarray) -> np.ndarray:
    """Linear below 1000 Hz, logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, 3 * hz / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def mel_filters(bands: int) -> np.ndarray:
    """Triangles of equal area (bands, bins), evenly spaced in mel up to half the rate."""
    bins = np.fft.rfftfreq(WINDOW, 1 / RATE)
    grid = np.linspace(0, RATE / 2, 200_001)
    edges = np.interp(np.linspace(0, mel(RATE / 2), bands + 2), mel(grid), grid)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))) * 2 / (high - low)


def mfcc(data: bytes, count: int = 13, bands: int = 128) -> np.ndarray:
    """Cepstral coefficients of every frame: cosine transform of the mel spectrum in decibels, 80 at most below its peak."""
    power = power_frames(samples(data, RATE)[0]) @ mel_filters(bands).T
    if not len(power):
        return np.zeros((0, count))
    level = 10 * np.log10(np.maximum(power, 1e-10))
    level = np.maximum(level, level.max() - 80)
    k, b = np.arange(count)[:, None], np.arange(bands)[None]
    basis = np.cos(np.pi * k * (2 * b + 1) / (2 * bands)) * np.where(k == 0, np.sqrt(1 / bands), np.sqrt(2 / bands))
    return level @ basis.T


def chroma(data: bytes) -> np.ndarray:
    """The power of every frame by pitch class (12, from C), the strongest class at one; frames of silence are zeros."""
    power = power_frames(samples(data, RATE)[0])
    hz = np.fft.rfftfreq(WINDOW, 1 / RATE)[1:]
    pitch = 12 * np.log2(hz / 440) + 9
    # each bin counts for the classes around its pitch, and low and very high octaves count less
    apart = (pitch[:, None] - np.arange(12) + 6) % 12 - 6
    weight = np.exp(-2 * apart**2)
    weight *= (np.exp(-0.5 * ((np.log2(hz / 27.5) - 5) / 2) ** 2) / np.sqrt((weight**2).sum(axis=1)))[:, None]
    out = power[:, 1:] @ weight
    top = out.max(axis=1, keepdims=True)
    return np.divide(out, top, out=np.zeros_like(out), where=top > 1e-12)


def gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Brightness (0 to 255) of an image as Spark's image source gives it: rows of blue, green, red."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return x[:, :, 0] if channels == 1 else x[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def hog(x: np.ndarray, size: int = 128, cell: int = 8, bins: int = 9) -> np.ndarray:
    """One row: oriented gradients of all windows of 64 x 128 pixels, blocks of 2 x 2 cells, clipped unit length."""
    x = resized(x, size, size)
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gx[:, 1:-1], gy[1:-1] = x[:, 2:] - x[:, :-2], x[2:] - x[:-2]
    length, angle = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), np.pi) / np.pi * bins - 0.5
    low = np.floor(angle).astype(int)
    part, n = angle - low, size // cell
    of = (np.arange(size) // cell)[:, None] * n + (np.arange(size) // cell)[None]
    hist = sum(np.bincount((of * bins + (low + k) % bins).ravel(), (length * w).ravel(), n * n * bins) for k, w in ((0, 1 - part), (1, part))).reshape(n, n, bins)
    block = np.concatenate([hist[:-1, :-1], hist[:-1, 1:], hist[1:, :-1], hist[1:, 1:]], axis=2)
    unit = lambda v: v / np.sqrt((v**2).sum(axis=2, keepdims=True) + 1e-6)
    block = unit(np.minimum(unit(block), 0.2))
    wide = 64 // cell - 1
    return np.concatenate([block[:, i : i + wide].ravel() for i in range(block.shape[1] - wide + 1)])[None]


#: feature name -> function from file bytes (of images: brightness) to descriptor rows; further ones can be registered.
EXTRACTORS: dict[str, Callable] = {"SPECTRAL": spectral, "MFCC": mfcc, "CHROMA": chroma, "HOG": hog, "SIFT": sift, "ORB": orb}


def extract(files: DataFrame, feature: str) -> DataFrame:
    """(key, vector) descriptors of files (key, content) or, for image features, (key, image); unreadable files have none."""
    if feature not in EXTRACTORS:
        raise NotImplementedError(f"no extractor for {feature} is installed; register one in EXTRACTORS or supply descriptors")
    run, images = EXTRACTORS[feature], "image" in files.columns
    held = files.select("key", *(f"image.{k}" for k in ("height", "width", "nChannels", "data"))) if images else files.select("key", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, *args = (c[i].as_py() for c in b.columns)
                v = run(gray(*args)) if images else run(args[0])
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(v), b.column(0).type), pa.array(v.astype(float).tolist(), pa.list_(pa.float64()))], names=["key", "vector"])

    return held.mapInArrow(rows, f"key {files.schema['key'].dataType.simpleString()}, vector array<double>")


def codebook(descriptors: DataFrame, k: int = 300, seed: int = 42, per_key: int = 1000, total: int = 200_000) -> list[list[float]]:
    """k-means centres of a bounded, seeded sample: at most per_key vectors of a row, total in all."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    placed = descriptors.withColumn("_place", F.xxhash64(F.lit(seed), "key", "vector"))
    sample = first_placed(placed, per_key, total).select(array_to_vector("vector").alias("features"))
    return [list(map(float, c)) for c in KMeans(k=k, seed=seed, maxIter=100).fit(sample).clusterCenters()]


#: Bits of a place that are left out to count places by their range; 16,384 ranges remain.
RANGE = 50


def first_placed(placed: DataFrame, per_key: int, total: int) -> DataFrame:
    """The rows of smallest _place in order, at most per_key of a key and total in all.

    Ranges of places are counted first, so that only rows of the ranges that hold the result are dealt
    out by key and sorted, not every row; one task reads little more than total rows.
    """
    from pyspark.sql import Window

    by_key = F.row_number().over(Window.partitionBy("key").orderBy("_place"))
    capped = lambda rows: rows.withColumn("_r", by_key).where(F.col("_r") <= per_key).drop("_r")
    of = F.shiftright("_place", RANGE)
    counts = sorted(tuple(r) for r in placed.groupBy(of.alias("range")).agg(F.count("*")).collect())  # a row per range
    everything, wanted = sum(n for _, n in counts), total
    while True:
        seen = last = 0
        for last, n in counts:
            seen += n
            if seen >= wanted:
                break
        # a key's rows within the ranges are its first ones, so that the cap takes the same as over all rows
        few = capped(placed.where(of <= last) if seen < everything else placed)
        if seen >= everything or few.count() >= total:
            return few.repartition(1).sortWithinPartitions("_place").limit(total)
        wanted = 2 * seen


def nearest_word(vector: str, words: list[list[float]]) -> Column:
    """Index of the nearest centre, ties to the smaller one."""
    centres = F.array(*(F.array(*map(F.lit, w)) for w in words))
    gaps = F.transform(centres, lambda w: F.aggregate(F.zip_with(w, F.col(vector), lambda a, b: (a - b.cast("double")) * (a - b.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


#: Codebooks of up to so many numbers become expressions; larger ones are multiplied in Arrow batches.
INLINE = 512


def quantised(descriptors: DataFrame, words: list[list[float]]) -> DataFrame:
    """(key, word): the nearest centre of every descriptor, ties to the smaller one."""
    if len(words) * len(words[0]) <= INLINE:
        return descriptors.select("key", nearest_word("vector", words).alias("word"))
    centres = np.array(words)
    size = (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, centres.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((size - 2 * x @ centres.T).argmin(axis=1).astype(np.int32))], names=["key", "word"])

    return descriptors.select("key", "vector").mapInArrow(run, f"key {descriptors.schema['key'].dataType.simpleString()}, word int")


def histograms(descriptors: DataFrame, words: list[list[float]]) -> DataFrame:
    """(key, word, share): each row's descriptors by nearest centre, summing to one."""
    found = quantised(descriptors, words).groupBy("key", "word").agg(F.count("*").alias("n"))
    return found.join(found.groupBy("key").agg(F.sum("n").alias("total")), "key").select("key", "word", (F.col("n") / F.col("total")).alias("share"))


def word_weights(hist: DataFrame, total: int) -> DataFrame:
    """(word, idf = ln(N / df)); words that occur nowhere have none."""
    return hist.groupBy("word").agg(F.count("*").alias("df")).select("word", F.log(F.lit(float(total)) / F.col("df")).alias("idf"))


def sequential_scores(hist: DataFrame, idf: DataFrame, query: DataFrame) -> DataFrame:
    """(key, score) of all rows: weighted query against raw histograms, zeros included."""
    q = query.join(idf, "word").select("word", (F.col("share") * F.col("idf")).alias("w"))
    size = q.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    # the query and its norm: a row per codeword at most
    dots = hist.join(F.broadcast(q), "word", "left").groupBy("key").agg(F.coalesce(F.sum(F.col("share") * F.col("w")), F.lit(0.0)).alias("dot"), F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("norm"))
    both = F.col("norm") * F.coalesce(size.scalar(), F.lit(0.0))
    return dots.select("key", F.when(both > 0, F.col("dot") / both).otherwise(0.0).alias("score"))


def inverted_scores(hist: DataFrame, idf: DataFrame, query: DataFrame) -> DataFrame:
    """(key, score) of the rows that share a weighted codeword: cosine of weighted histograms."""
    weigh = lambda h: h.join(F.broadcast(idf), "word").withColumn("w", F.col("share") * F.col("idf"))
    q = weigh(query).where("w > 0").select("word", F.col("w").alias("qw"))
    size = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("size"))
    rows = weigh(hist)
    dots = rows.join(F.broadcast(q), "word", "left").groupBy("key").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return dots.where(F.col("dot").isNotNull()).select("key", (F.col("dot") / (F.col("norm") * size.scalar())).alias("score"))


def most_similar(scores: DataFrame, k: int, without: str | None = None) -> DataFrame:
    """The k best rows, ties by key; without: the key, as text, that the query file itself has."""
    kept = scores if without is None else scores.where(F.col("key").cast("string") != without)
    return kept.orderBy(F.desc("score"), "key").limit(k)
