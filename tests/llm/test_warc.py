from pyspark.sql import functions as F
import random
import base64
import gzip
import hashlib
import io

import pytest

from crowdlens.llm import warc


def archive(n=40):
    payloads = [(f"page {i} " * (i * 37 % 300)).encode() for i in range(n)]
    payloads[5] = warc.member(b"WARC/1.1\r\nx: y\r\n\r\n") * 3  # packed data inside a payload
    payloads[6] = b"\x1f\x8b\x08" * 5000
    members = [warc.member(warc.record(i, f"http://a/{i}", p, None, True, "d"), level=0 if i in (5, 6) else 6)
               for i, p in enumerate(payloads)]
    return payloads, members


@pytest.mark.parametrize("step", [1, 3, 100, 1000, 4096, 10**9])
def test_ranges_of_any_size_own_every_record_once(step):
    payloads, members = archive(12 if step < 100 else 40)
    data = b"".join(members)
    if step < 100:
        starts = range(0, 3000, step)
        data = data[: sum(map(len, members[:5]))]
        payloads, starts = payloads[:5], range(0, len(data), step)
    else:
        starts = range(0, len(data), step)
    rows = [r for s in starts for r in warc.read_range(io.BytesIO(data), len(data), s, min(s + step, len(data)))]
    assert [r["page_id"] for r in rows] == list(range(len(payloads)))
    assert [r["payload"] for r in rows] == payloads


def test_each_member_is_a_record_of_its_own():
    _, members = archive()
    assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in members)


def test_bytes_between_are_skipped_and_broken_records_are_told():
    payloads, members = archive(7)
    data = b"noise" + members[0] + members[1] + b"\x00\x00" + members[2]
    for step in (50, 10**6):
        rows = [r for s in range(0, len(data), step) for r in warc.read_range(io.BytesIO(data), len(data), s, min(s + step, len(data)))]
        assert [r["page_id"] for r in rows] == [0, 1, 2]
    cut = members[0] + members[1][:-30]
    with pytest.raises(ValueError):
        list(warc.read_range(io.BytesIO(cut), len(cut), 0, len(cut)))
    wrong = warc.record(1, "u", b"abc", None, True, "d").replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    with pytest.raises(ValueError):
        warc.parse(wrong)


def test_round_trip(spark):
    rows = [(3, "http://a/", "same", "x"), (1, "http://b/\r\nX-Page-Id: 9", "same", "x"), (2, None, None, "x"), (4, "u", "", "x"),
            (5, "u", "É漢😀" * 50_000, "x"), (1, "http://b/\r\nX-Page-Id: 9", "same", "x"), (None, "u", "same", "x"),
            (None, "v", "only here", "x")] + [(100 + i, f"http://c/{i}", f"html {i % 7}\r\n\r\n", "x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first string")
    small = warc.Settings(file_bytes=2000, range_bytes=500)
    got = warc.round_trip(pages.repartition(3), small).collect()
    groups = {}
    for page, _, html, _ in rows:
        groups.setdefault(html or "", []).append(page)
    want = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        first = min((p for p in groups[html or ""] if p is not None), default=None)
        want.append((page, None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
                     "response" if page == first else "revisit", base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data),
                     None if page == first else first, data if page == first else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.url, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to,
                                                   None if r.payload is None else bytes(r.payload))) for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0


def _wrong(page=1):
    return warc.member(warc.record(page, "u", b"abc" * 50, None, True, "d").replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


@pytest.mark.parametrize("data", [
    archive(7)[1][0][:-30], archive(7)[1][0][:25], _wrong(), b"\x00\x00" + _wrong(), archive(7)[1][1] + b"\x00" + _wrong(),
    archive(7)[1][1] + b"\x00" + archive(7)[1][1][:-5], warc.member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), archive(7)[1][0][:-5] + b"12345",
], ids=["cut", "cut in the header", "digest", "after noise", "after padding", "cut after padding", "without a digest", "checksum"])
@pytest.mark.parametrize("step", [60, 10**6])
def test_damage_is_told_wherever_the_record_stands(data, step):
    with pytest.raises(ValueError):
        for s in range(0, len(data), step):
            list(warc.read_range(io.BytesIO(data), len(data), s, min(s + step, len(data))))


@pytest.mark.parametrize("how", ["cut", "overwritten"])
def test_records_lost_from_written_archives_are_told(spark, tmp_path, how):
    pages = spark.range(20).selectExpr("id AS page_id", "'u' AS url", "concat('html ', id) AS html").coalesce(1)
    settings = warc.Settings(range_bytes=500)
    files = warc.write(pages, (tmp_path / "warc").as_uri(), settings)
    assert warc.read(spark, files, settings).count() == 20 and files.head().records == 20
    assert warc.read(spark, files.select("path", "bytes"), settings).count() == 20
    path = files.head().path.removeprefix("file://")
    data = open(path, "rb").read()
    second = data.index(warc.MAGIC, 1)
    with open(path, "wb") as sink:
        sink.write(data[:-40] if how == "cut" else bytes(second) + data[second:])
    with pytest.raises(Exception, match="instead of"):
        warc.read(spark, files, settings).collect()


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    """19 or more ranges of two files: each is a task of its own, with re-planning on."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", random.Random(i).randbytes(3000).hex()) for i in range(200)],
                                  "page_id long, url string, html string").coalesce(2)
    s = warc.Settings(range_bytes=20_000)
    files = warc.write(pages, str(tmp_path / "split"), s)
    ranges = sum(-(-r.bytes // s.range_bytes) for r in files.collect())
    rows = warc.read(spark, files, s).withColumn("task", F.spark_partition_id())
    assert ranges >= 19 and rows.select("task").distinct().count() >= min(ranges, 8) and rows.count() == 200
    assert rows.rdd.getNumPartitions() == ranges
    assert all(r.path.startswith("file:///") for r in files.collect())


@pytest.mark.parametrize("folder, uri", [
    ("/a b/c%20d", "file:///a b/c%20d"), ("file:/x/y", "file:///x/y"), ("file:///x/y", "file:///x/y"), ("s3a://bucket/x", "s3://bucket/x"),
    ("s3n://b/x", "s3://b/x"), ("hdfs://host:8020/x", "hdfs://host:8020/x"), ("abfss://c@a.dfs.core.windows.net/x", "abfss://c@a.dfs.core.windows.net/x"),
    ("dbfs:/x", None), ("http://x/y", None), ("relative/path", None)])
def test_stores(folder, uri):
    if uri is None:
        with pytest.raises(ValueError, match="can't be kept"):
            warc.store_uri(folder)
    else:
        assert warc.store_uri(folder) == uri == warc.store_uri(uri)


def test_folders_with_signs_of_uris(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, "x"), (2, None, None)], "page_id long, url string, html string")
    folder = tmp_path / "a b%20c#d"
    files = warc.write(pages, str(folder))
    assert sorted(r.page_id for r in warc.read(spark, files).collect()) == [1, 2]
