import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bytekit as bk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\n\t\x0b\x1c ", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_lines(texts):
    buf, off = bk.text_bytes(pa.array(texts, pa.string()))
    start, end, doc = bk.words(buf, off)
    got = [(d, buf[a:b].tobytes().decode()) for a, b, d in zip(start, end, doc)]
    assert got == [(d, w) for d, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    start, end, doc = bk.lines(buf, off)
    assert [(d, buf[a:b].tobytes().decode()) for a, b, d in zip(start, end, doc)] == [(d, x) for d, t in enumerate(texts) for x in (t or "").split("\n")]
    assert sum(b.num_rows for b in bk.slices(pa.record_batch({"t": pa.array(texts, pa.string())}), "t", 10)) == len(texts)


def test_hashes_depend_on_bytes_only():
    buf = np.frombuffer(b"abcabc" + b"x" * 9000 + b"abc", np.uint8)
    start = np.array([0, 3, 9006, 0, 6, 7, 0])
    end = np.array([3, 6, 9009, 2, 9005, 9006, 0])
    h = bk.span_hash(buf, start, end)
    assert h[0] == h[1] == h[2] and h[4] == h[5] and len(set(h.tolist())) == 4
    earlier, other = bk.seen_before(h)
    assert earlier.tolist() == [False, True, True, False, False, True, False] and other.tolist() == [True, True, True, False, True, True, False]
