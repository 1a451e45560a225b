"""Whole texts as UTF-8 bytes in numpy: words, lines and 64-bit hashes without a Python object per word.

Words are ``[^\\x20\\x09-\\x0D]+``; those bytes never occur inside a multi-byte character, so byte
offsets give the same words as code points do. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEP = np.zeros(256, bool)
SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> _S30)) * _C2
    h = (h ^ (h >> _S27)) * _C3
    return h ^ (h >> _S31)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one text after the other, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about limit text bytes (one row at least): bounds what numpy holds at once."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of kept bytes, cut at text ends."""
    n = len(keep)
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] |= keep[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] |= keep[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words."""
    return spans(~SEP[buf], offsets)


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all \\n-split lines; every text has one line at least."""
    breaks = np.flatnonzero(buf == 10)
    of = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    text = np.concatenate([np.arange(len(offsets) - 1), of])
    starts = starts[np.lexsort((starts, text))]
    ends = ends[np.lexsort((ends, text))]
    return starts, ends, np.sort(text, kind="stable")


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(buf)
    view = np.ndarray(n + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    size = (ends - starts).astype(np.int64)
    h = mix((size.astype(np.uint64) + np.uint64(seed)) * _C1)
    for i in np.flatnonzero(size > 4096):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    at = np.flatnonzero((size > 0) & (size <= 4096))
    pos, left = starts[at], size[at]
    while len(at):
        h[at] = mix((h[at] ^ (view[pos] & _MASK[np.minimum(left, 8)])) * _C1)
        more = left > 8
        at, pos, left = at[more], pos[more] + 8, left[more] - 8
    return h


def per_span(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flagged bytes each span holds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: does an equal one stand earlier; does an equal one stand anywhere else."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    twin = same.copy()
    twin[:-1] |= same[1:]
    earlier, other = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order], other[order] = same, twin
    return earlier, other
