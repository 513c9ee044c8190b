"""Archives: round trips, revisits, and what a damaged archive still gives."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomspark.llm import warc

DATE = ("WARC-Date", "2020-01-01T00:00:00Z")
HTML = ["<p>one</p>" * 30, "", None, "short", "<p>one</p>" * 30, "é" * 50, "é" * 49, "WARC/1.1\r\nx\r\n\r\n" * 20, "<p>one</p>" * 30, "a" * 100, "a" * 100, "b" * 99, "b" * 99]


def pages(spark):
    rows = [(k * 3 if k != 8 else None, f"http://x/{k}\r\n%", h, "y", "z") for k, h in enumerate(HTML)]
    rows += [rows[0], (1, None, "<p>one</p>" * 30, "y", "z")]  # a repeated row, a null address
    return spark.createDataFrame(rows, "page_id long, url string, html string, content string, payload string")


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("few", [200_000, 0])
def test_round_trip(spark, monkeypatch, packed, few):
    monkeypatch.setattr(warc, "FEW", few)
    df = pages(spark)
    archives = warc.write(df, size=2000, packed=packed)
    assert archives.count() > 1
    found = warc.resolve(warc.read(archives)).filter("record_type <> 'warcinfo'").withColumn("page_id", warc.page_id("record_id")).collect()
    assert all(r.gap is None for r in found) and len(found) == df.count()
    want = []
    for r in df.collect():
        data = (r.html or "").encode()
        same = [x.page_id for x in df.collect() if (x.html or "").encode() == data and x.page_id is not None]
        first = min(same) if len(data) >= 100 and same else None
        visit = first is not None and first != r.page_id
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if visit else "response", f"<urn:page:{first}>" if visit else None, b"" if visit else data))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))) for r in found)
    assert warc.write(df.limit(0)).count() == 0
    assert warc.read(archives.limit(0)).count() == 0


def archive(packed, count=30, seed=0):
    rng = random.Random(seed)
    plain = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:{k}>"), DATE], bytes(rng.choice(b"WARC/1.0\r\n x\x1f\x8b\x08") for _ in range(rng.randrange(400)))) for k in range(count)]
    return [warc.member(r) if packed else r for r in plain]


def tiled(data):
    """What salvage() gives; its ranges cover the archive once, in order."""
    out, at = [], 0
    for start, end, headers, payload, why in warc.salvage(data):
        assert start == at and end > start and (headers is None) == (why is not None) == (payload is None)
        at = end
        out.append((start, end, None if headers is None else headers["warc-record-id"]))
    assert at == len(data)
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_only_damaged_records_are_lost(packed):
    records = archive(packed)
    edges = [0]
    for r in records:
        edges.append(edges[-1] + len(r))
    data = b"".join(records)
    assert [x[2] for x in tiled(data)] == [f"<urn:{k}>" for k in range(30)]
    rng = random.Random(1)
    for trial in range(60):
        bad, hit = bytearray(data), set()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(data))
            bad[at] ^= rng.randrange(1, 256)
            hit.add(next(k for k in range(30) if edges[k] <= at < edges[k + 1]))
        got = {x[2] for x in tiled(bytes(bad))}
        assert {f"<urn:{k}>" for k in range(30) if k not in hit} <= got, trial
        # bytes cut out, or put in between records
        at, size = rng.randrange(len(data)), rng.randrange(1, 300)
        cut = data[:at] + data[at + size :]
        whole = {f"<urn:{k}>" for k in range(30) if edges[k + 1] <= at or edges[k] >= at + size}
        assert whole <= {x[2] for x in tiled(cut)}, trial
        k = rng.randrange(31)
        noise = bytes(rng.randrange(256) for _ in range(size))
        more = tiled(data[: edges[k]] + noise + data[edges[k] :])
        assert len([x for x in more if x[2]]) == 30 and [(a, b) for a, b, i in more if i is None] == [(edges[k], edges[k] + size)]


def broken(headers, block=b"hello", **change):
    r = warc.record(headers, block)
    for old, new in change.values():
        assert old in r
        r = r.replace(old, new)
    return r


GOOD = [("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:a>"), DATE]


@pytest.mark.parametrize("data, why", [
    (broken(GOOD[1:]), "no warc-type"),
    (broken([*GOOD, ("WARC-Payload-Digest", "sha1:ABC")]), "payload digest differs"),
    (broken(GOOD, c=(b"hello", b"hallo")), "block digest differs"),
    (broken(GOOD, c=(b"Length: 5", b"Length: 50")), "the record does not end where its length says"),
    (broken(GOOD, c=(b"Length: 5", b"Length: +5")), "content-length is no number"),
    (broken(GOOD, c=(b"WARC-Type: ", b"nothing here ")), "a header line without a name"),
    (broken(GOOD)[:20], "headers without an end"),
    (warc.member(broken(GOOD))[:-3], "the gzip member is cut off"),
    (warc.member(broken(GOOD))[:-8] + bytes(8), "the gzip member is damaged"),
    (warc.member(broken(GOOD) * 2), "the gzip member holds more than a record"),
    (b"nothing", "no version line"),
])
def test_checks(data, why):
    ((start, end, headers, _, reason),) = warc.salvage(data)
    assert (start, end, headers, reason) == (0, len(data), None, why)


def test_foreign_records(spark):
    """Digests of other kinds, folded headers, version 1.0, and files that are read by Spark's own source."""
    import base64

    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npayload"
    sha1 = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:b>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nX-Note: a\r\n b\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:{sha1}\r\nWARC-Block-Digest: crc9:00\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    (row,) = warc.salvage(head + body + b"\r\n\r\n")
    assert row[2]["x-note"] == "a b" and bytes(row[3]) == b"payload"
    assert tiled(b"") == []


def test_files(spark, tmp_path):
    df = pages(spark)
    for r in warc.write(df, size=1500).collect():
        (tmp_path / r.archive).write_bytes(bytes(r.content))
        gzip.decompress(bytes(r.content))  # any gzip reader takes it
    first = sorted(tmp_path.iterdir())[0]
    data = bytearray(first.read_bytes())
    data[len(data) // 2] ^= 255
    first.write_bytes(bytes(data))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    out = warc.read(files, name="path", payload=False)
    gaps = out.filter("gap is not null").collect()
    assert gaps and all(r.archive.endswith(first.name) and r.length > 0 and r.record_id is None for r in gaps)
    assert out.filter("gap is null and record_type <> 'warcinfo'").count() >= df.count() - 3
    total = sum(p.stat().st_size for p in tmp_path.iterdir())
    assert out.agg(F.sum("length")).first()[0] == total


def test_nulls_and_unresolved(spark):
    none = spark.createDataFrame([("a", None), ("b", b""), (None, warc.record([*GOOD[1:], ("WARC-Type", "revisit"), ("WARC-Refers-To", "<urn:z>")], b""))], "archive string, content binary")
    (r,) = warc.resolve(warc.read(none)).collect()
    assert r.archive is None and r.record_type == "revisit" and r.payload_digest is None and r.payload_bytes is None
