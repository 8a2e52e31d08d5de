import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from siltstone.llm import warc


def _pages(spark):
    big, other = "<p>é" * 400, "x" * 999
    html = [big, other, big, None, "", other, "y" * 1000, "z\r\n\r\nWARC/1.1\r\n" * 90, big, "y" * 1000]
    rows = [(i * 3, f"http://a/{i}: b\r\nX: y" if i % 2 else None, h) for i, h in enumerate(html)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = len(p) >= 1000 and top[h or ""] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    return sorted(out)


def test_round_trip(spark):
    rows, df = _pages(spark)
    assert sorted(map(tuple, warc.round_trip(df).collect())) == brute(rows)
    assert sorted(map(tuple, warc.round_trip(df.withColumns({"id": F.lit(1), "payload": F.lit(2)})).collect())) == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_survive_small_frames_and_bundles(spark):
    rows, df = _pages(spark)
    bundles = warc.write_bundles(df.coalesce(1), frame_bytes=1500, bundle_bytes=4000)
    assert bundles.count() > 1
    read = {r.page_id: r for r in warc.read_bundles(bundles).collect()}
    texts = {i: (h or "").encode() for i, _, h in rows}
    for i, url, _ in rows:
        r = read[i]
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else texts[i])
        assert r.url == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))
    one = bundles.first()
    data = bytes(one.data)
    # Any reader expands the frames and skips the footer.
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.count(b"WARC-Record-ID") == len(one.ids) and sum(d for *_, d in warc.read_seek_table(data)) == len(plain)
    for i, f, o, n in zip(one.ids, one.frames, one.offsets, one.lengths):
        header, _, _ = warc.parse_record(warc.read_at(data, f, o, n))
        assert header["WARC-Record-ID"] == f"<urn:page:{i}>"
    with pytest.raises(ValueError):
        warc.read_seek_table(data[:-1])


def test_broadcast_and_join_agree(spark):
    _, df = _pages(spark)
    few, many = (sorted((r.id, r.refers_to or -1) for r in warc.with_revisits(df, broadcast_rows=b).collect()) for b in (100, -1))
    assert few == many


def test_repeated_and_null_ids(spark):
    big = "q" * 2000
    df = spark.createDataFrame([(5, "u", big), (5, "u", big), (2, "u", big), (None, "u", big), (5, "v", "w" * 1500), (9, "v", "w" * 1500)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    assert got == [(0, "response", 0), (2, "revisit", 5), (5, "response", 0), (5, "response", 0), (5, "revisit", 9), (9, "response", 0)]


def test_export(spark, tmp_path):
    _, df = _pages(spark)
    names = warc.export(warc.write_bundles(df), str(tmp_path))
    assert names and all(warc.read_seek_table(open(n, "rb").read()) for n in names)
