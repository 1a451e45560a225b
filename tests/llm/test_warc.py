import gzip
import hashlib
import io
import random
import zlib
from email.parser import BytesHeaderParser
from http.client import HTTPResponse
from pathlib import Path

from quillstone.llm import warc


def pages(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdeé<>\r\n 日") for _ in range(n))
    shared = [text(150), text(99), "x" * 100, "y" * 99]
    rows = [(i, f"http://e.example/{i}\r\nEvil: 1", r.choice([*shared, text(r.randint(0, 400)), None, ""]), "k") for i in range(80)]
    rows += [(None, None, shared[0], None), (None, "u", text(300), None), rows[5], (None, "u", "z" * 120, None), (None, "v", "z" * 120, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3), rows


def expected(rows):
    first = {}
    for i, _, h, _ in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h, _ in rows:
        again = h in first and i != first[h] and h is not None
        out.append((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", str(first[h]) if again else "None"))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    index = warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=3000)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.read_records(index, range_bytes=2000, gap_bytes=10).collect())
    assert got == expected(rows)
    files = {r.file for r in index.collect()}
    assert len(files) > 3 and files == {p.name for p in Path(tmp_path, "w").iterdir()}
    blob = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").iterdir())
    assert blob.count(b"WARC/1.1\r\n") == len(rows) + len(files)


def records(data):
    """A reader that shares nothing with the module: members by gzip, heads by the mail parser, HTTP by http.client."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data)
        data = member.unused_data
        version, _, rest = raw.partition(b"\r\n")
        assert version == b"WARC/1.1"
        head = BytesHeaderParser().parsebytes(rest)
        block = rest.partition(b"\r\n\r\n")[2]
        n = int(head["Content-Length"])
        assert block[n:] == b"\r\n\r\n"
        yield head, block[:n]


class Socket(io.BytesIO):
    def makefile(self, *_):
        return self


def test_another_reader_understands_the_archives(spark, tmp_path):
    df, rows = pages(spark)
    warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=3000, send=0)
    names, seen = set(), []
    for p in Path(tmp_path, "w").iterdir():
        (info, fields), *rest = records(p.read_bytes())
        assert info["WARC-Type"] == "warcinfo" and info["WARC-Filename"] == p.name and b"software: " in fields
        for head, block in [(info, fields), *rest]:
            assert head["WARC-Date"] and head["WARC-Record-ID"].startswith("<urn:uuid:") and head["WARC-Record-ID"] not in names
            names.add(head["WARC-Record-ID"])
        for head, block in rest:
            assert head["Content-Type"] == "application/http;msgtype=response" and "\n" not in head["WARC-Target-URI"]
            http = HTTPResponse(Socket(block))
            http.begin()
            page, digest = head.get("Quillstone-Page-ID"), head["WARC-Payload-Digest"].removeprefix("sha256:")
            size = int(http.getheader("Content-Length"))
            if head["WARC-Type"] == "response":
                assert hashlib.sha256(http.read()).hexdigest() == digest
            else:
                assert head["WARC-Profile"].endswith("identical-payload-digest") and head["WARC-Refers-To-Target-URI"] and head["WARC-Refers-To-Date"]
            seen.append((str(page), size, digest, head["WARC-Type"], str(head.get("Quillstone-Refers-To-Page"))))
    assert sorted(seen) == expected(rows)


def test_selected_records(spark, tmp_path):
    df, rows = pages(spark)
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_records(index.where("page_id in (3, 40, 79)")).collect()
    want = {i: (h or "") for i, _, h, _ in rows}
    assert sorted(r.page_id for r in got) == [3, 40, 79]
    assert all(bytes(r.payload).decode() == want[r.page_id] for r in got if r.record_type == "response")


def test_empty(spark):
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and warc.read_records(index).count() == 0
