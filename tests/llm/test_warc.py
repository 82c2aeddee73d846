"""Web archives: round trips, references to equal payloads, framing and damage."""

import base64
import gzip
import hashlib
import io
import os
import random
from collections import defaultdict

import pytest

from panelspark.llm import warc

PAGES = "page_id long, url string, html string"
CLASH = ("uid", "sha1", "same", "payload", "payload_bytes", "refers_to", "refers_uid", "n", "first")


def pages():
    rng = random.Random(1)
    long = "".join(rng.choice("<p>äö日\r\n\r\nWARC/1.1 ") for _ in range(300_000))
    rows = [(i, f"http://h/{i}", f"<html>{i % 4}</html>") for i in range(12)]
    rows += [(20, None, None), (21, "http://h/21", ""), (22, "http://h/a b\r\nX: 1\n", long), (23, "http://ü/ñ", long), (30, "u", "once")]
    rows += [(None, "u", "lost"), (None, "u", "lost"), (None, None, "<html>1</html>"), (31, "u", "tie"), (31, "u", "tie"), (31, "v", "tie")]
    return rows


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    """Sorted (page_id, bytes, digest, type, refers_to)."""
    by = defaultdict(list)
    for page, _, html in rows:
        by[html or ""].append(page)
    out = []
    for html, found in by.items():
        size, found = len(html.encode()), sorted(found, key=lambda p: (p is None, p or 0))
        for i, p in enumerate(found):
            again = i > 0 and size >= min_bytes
            out.append((p, size, digest(html), "revisit" if again else "response", found[0] if again else None))
    return sorted(out, key=repr)


def digests(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("min_bytes", [0, 1, 10, 10**6])
def test_digests_against_brute_force(spark, table, tmp_path, min_bytes):
    from pyspark.sql import functions as F

    df = table(pages(), PAGES).withColumns({c: F.lit(1) for c in CLASH})
    assert digests(warc.archive_digests(df, str(tmp_path / "w"), min_bytes)) == brute(pages(), min_bytes)


def test_pages_come_back(spark, table, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(table(pages(), PAGES), path, level="1")
    got = warc.read_archives(spark, path).collect()
    html = {(p, h or "") for p, _, h in pages()}
    assert all((r["page_id"], r["html"]) in html for r in got if r["record_type"] == "response")
    assert all(r["html"] is None for r in got if r["record_type"] == "revisit")
    address = {r["page_id"]: r["url"] for r in got}
    assert address[20] is None and address[22] == "http://h/a%20b%0D%0AX:%201%0A" and address[23] == "http://ü/ñ"


def test_empty_table(spark, table, tmp_path):
    df = warc.archive_digests(table([], PAGES), str(tmp_path / "w"))
    assert df.collect() == [] and df.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_small_archives_and_a_second_write(spark, table, tmp_path):
    path = str(tmp_path / "w")
    some = [(i, "u", f"{i} " * 500) for i in range(40)]
    warc.write_archives(table(some, PAGES), path, archivebytes="2000")
    assert sum(f.endswith(".warc.gz") for f in os.listdir(path)) > 6
    warc.write_archives(table([(100, "u", "new")], PAGES), path)
    assert digests(warc.read_archives(spark, path)) == brute([*some, (100, "u", "new")])
    warc.write_archives(table([(7, "u", "only")], PAGES), path, mode="overwrite")
    assert digests(warc.read_archives(spark, path)) == brute([(7, "u", "only")])


def test_archives_without_a_commit_are_not_read(spark, table, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(table([(1, "u", "a")], PAGES), path)
    with open(f"{path}/part-lost.warc.gz", "wb") as f:
        f.write(row(5, b"lost"))
    assert digests(warc.read_archives(spark, path, payload=False)) == brute([(1, "u", "a")])


def row(page_id, payload, **kw):
    return warc.page_member({"page_id": page_id, "uid": 0, "url": "u", "payload": payload, "payload_bytes": len(payload),
                             "sha1": hashlib.sha1(payload).hexdigest(), "refers_to": None, "refers_uid": None, **kw})


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_reader_in_chunks(chunk):
    payloads = [b"", b"x", b"\r\n\r\n" * 5, bytes(range(256)) * 40]
    data = b"".join(row(i, p) for i, p in enumerate(payloads))
    got = list(warc.read_records(io.BytesIO(data), chunk=chunk))
    assert [r.payload for r in got] == payloads
    starts = [len(b"".join(row(i, p) for i, p in enumerate(payloads[:n]))) for n in range(4)]
    assert [r.offset for r in got] == starts
    # every record can be read from its offset alone
    assert next(warc.read_records(io.BytesIO(data[starts[3] :]), chunk=chunk)).payload == payloads[3]


def test_members_are_plain_gzip():
    text = gzip.decompress(row(3, b"hello"))
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"hello\r\n\r\n") and gzip.decompress(row(1, b"a") + row(2, b"b")).count(b"WARC/1.1") == 2


def packed(raw):
    return gzip.compress(raw, mtime=0)


def test_damage_is_told():
    whole = gzip.decompress(row(3, b"hello world"))
    for broken in (
        row(3, b"hello" * 100)[:-12], row(3, b"hello")[5:], packed(whole.replace(b"hello", b"jello")), packed(whole[:-6]), packed(whole + b"more"),
        packed(whole.replace(b"Content-Length: ", b"Content-Length: 9")), packed(whole.replace(b"Content-Length: ", b"Content-Length: x")),
        packed(b"HTTP" + whole), packed(whole[:60]), row(3, b"a") + b"garbage",
        row(3, b"abc", sha1=hashlib.sha1(b"abd").hexdigest()),
    ):
        for chunk in (1, 1 << 18):
            with pytest.raises(warc.Damaged):
                list(warc.read_records(io.BytesIO(broken), chunk=chunk))
    assert list(warc.read_records(io.BytesIO(b""))) == []
