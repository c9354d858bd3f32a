import hashlib
import io
import os
import random

import pytest

from hybridctx.llm import warc
from hybridctx.llm.common import shared_path


def archive(n=6, compressed=True, seed=0):
    r = random.Random(seed)
    parts = []
    for i in range(n):
        body = bytes(r.choice(b"abc \n<>") for _ in range(r.randrange(0, 4000)))
        rec = warc.record_bytes(i, body)
        parts.append(warc.member(rec) if compressed else rec)
    return parts


def read(data):
    return list(warc.salvage(io.BytesIO(data)))


def ids(found):
    return [f[3]["warc-record-id"] for f in found if f[0] == "record"]


@pytest.mark.parametrize("compressed", [True, False])
def test_whole_archive(compressed):
    parts = archive(compressed=compressed)
    found = read(b"".join(parts))
    assert ids(found) == [f"<urn:page:{i}>" for i in range(6)] and all(f[0] == "record" for f in found)
    assert found[-1][2] == sum(map(len, parts))


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk_between", "junk_start", "lost_head"])
def test_later_records_are_recovered(compressed, damage):
    parts = archive(compressed=compressed, seed=3)
    bad = 2
    if damage == "flip":
        p = bytearray(parts[bad])
        for at in range(len(p) // 2, len(p) // 2 + 8):
            p[at] ^= 0x55
        parts[bad] = bytes(p)
    elif damage == "cut":
        parts[bad] = parts[bad][:len(parts[bad]) // 2]
    elif damage == "junk_between":
        parts.insert(bad, b"\x00\xff" * 700 + warc.GZIP_MAGIC + b"WARC/1.1\r\nno header")
    elif damage == "junk_start":
        parts.insert(0, b"garbage\r\n")
    else:
        parts[bad] = parts[bad][12:]
    found = read(b"".join(parts))
    want = [f"<urn:page:{i}>" for i in range(6) if damage.startswith("junk") or i != bad]
    assert ids(found) == want
    gaps = [f for f in found if f[0] == "gap"]
    assert gaps and all(g[5] for g in gaps)
    # records and gaps cover the file without overlap
    at = 0
    for f in found:
        assert f[1] == at
        at = f[2]
    assert at == sum(map(len, parts))


def test_damage_at_the_end_and_empty_file():
    parts = archive()
    found = read(b"".join(parts)[:-5])
    assert ids(found) == [f"<urn:page:{i}>" for i in range(5)]
    assert found[-1][0] == "gap" and found[-1][2] == sum(map(len, parts)) - 5
    assert read(b"") == []


def test_payload_that_looks_like_a_record():
    inner = warc.record_bytes(99, b"inner")
    data = warc.record_bytes(1, b"x" + inner + b"\r\n\r\nWARC/1.1\r\n") + warc.record_bytes(2, b"y")
    assert ids(read(data)) == ["<urn:page:1>", "<urn:page:2>"]


def pages(spark, rows):
    return spark.createDataFrame([(k, None, h, "x", 1) for k, h in rows],
                                 "page_id long, url string, html string, path string, records long")


def test_round_trip(spark):
    long, other = "é" * 600, "o" * 1000
    rows = [(1, long), (2, long), (3, long), (4, "short"), (5, "short"), (6, None), (7, ""), (8, other), (8, other),
            (9, "o" * 999), (10, "o" * 999), (None, long), (11, "a\r\n\r\nWARC/1.1\r\n\x00b" * 100)]
    got = sorted(warc.round_trip(pages(spark, rows)).collect(), key=str)
    top = {}
    for k, h in rows:
        if k is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, k), k)
    want = []
    for k, h in rows:
        b = (h or "").encode()
        ref = top[h] if h in top and top[h] != k else None
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref is not None else "response", ref))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_plain_archives_and_payloads(spark):
    rows = [(i, f"page {i} " * 300) for i in range(20)]
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(pages(spark, rows), folder, "page_id", "html", uri="url", compressed=False)
    got = {r.record_id: r.payload.decode() for r in warc.read_archives(spark, manifest).collect()}
    assert got == {f"urn:page:{i}": h for i, h in rows}
    paths = [r.path for r in manifest.collect()]
    assert all(p.endswith(".warc") for p in paths)
    # damage one file on disk: its other records still come back and the gap is logged
    path = next(p for p, n in [(r.path, r.records) for r in manifest.collect()] if n > 2).removeprefix("file:")
    path = "/" + path.lstrip("/")
    size = os.path.getsize(path)
    with open(path, "r+b") as f:
        f.write(b"#####")
    rows_back = warc.read_archives(spark, manifest).collect()
    gaps = [r for r in rows_back if r.kind == "gap"]
    assert len(gaps) == 1 and gaps[0].start == 0 and gaps[0].end < size and gaps[0].reason == "no version line"
    assert sum(r.kind == "record" for r in rows_back) == 19


def test_lengths_are_checked_against_the_stream_alone():
    good = warc.record_bytes(1, b"x" * 40)
    huge = good.replace(b"Content-Length: 40", b"Content-Length: 99999999999999999999999")
    for size in (None, 3 * len(good) + 24):
        for make in (lambda r: r, warc.member):
            data = make(good) + make(huge) + make(good)
            got = list(warc.salvage(io.BytesIO(data), len(data) if size else None))
            assert [g[0] for g in got] == ["record", "gap", "record"]
    # a header block beyond a mebibyte is no damage
    wide = warc.record_bytes(2, b"y" * 9, uri="u" * (2 << 20))
    for make in (lambda r: r, warc.member):
        data = make(wide) + make(good)
        assert [g[0] for g in warc.salvage(io.BytesIO(data), len(data))] == ["record", "record"]


def test_lost_records_fail_the_round_trip(spark, monkeypatch):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(i, f"page {i}") for i in range(20)], "page_id long, html string").coalesce(1)
    manifest = warc.write_archives(pages, shared_path(spark, "warc-test"))
    assert warc.read_archives(spark, manifest, complete=True).count() == 20
    with pytest.raises(Exception, match="20 of 21 records"):
        warc.read_archives(spark, manifest.withColumn("records", F.col("records") + 1), complete=True).count()


def test_odd_string_keys_come_back(spark):
    keys = ["null", None, "a\r\nWARC-Type: x", "<b>", "+ %41", "ü/ß", ""]
    pages = spark.createDataFrame([(k, "h" * 1000) for k in keys], "page_id string, html string")
    got = warc.round_trip(pages).collect()
    assert sorted(map(str, (r.page_id for r in got))) == sorted(map(str, keys)) and None in [r.page_id for r in got]
