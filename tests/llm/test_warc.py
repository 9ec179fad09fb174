import base64
import hashlib
import io

import duckdb
from pyspark.sql import functions as F

from sifter.llm import warc as w

ROWS = [
    (1, "http://a/\r\nx", "<p>é 😀</p>\r\n\r\nWARC/1.1\r\n"),
    (2, "http://b", "same"),
    (9, "http://c", "same"),
    (5, None, "same"),
    (6, "http://d", None),
    (7, "http://e", ""),
    (8, "http://f", "x" * 300_000 + "\n"),
    (9, "http://c", "same"),
    (None, "http://g", "same"),
    (None, None, None),
]
SCHEMA = "page_id long, url string, html string"


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        top = max((p for p in same if p is not None), default=None)
        again = len(same) > 1 and top is not None and i != top
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), sha, "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "z") for r in ROWS], SCHEMA + ", digest string").repartition(3)
    w.write(w.records(pages), str(tmp_path / "a"))
    archive = w.read(spark, str(tmp_path / "a"))
    assert sorted((tuple(r) for r in w.round_trip(spark, str(tmp_path / "a")).collect()), key=str) == brute(ROWS)
    kept = {r.record_id: r.payload for r in archive.filter("record_type = 'response'").collect()}
    assert kept[1] == ROWS[0][2] and kept[8] == ROWS[6][2] and kept[9] == "same"
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", ROWS)
    assert sorted(con.execute(w.sql()).fetchall(), key=str) == brute(ROWS)


def test_a_hot_payload_and_long_ones(spark, tmp_path):
    rows = [(i, f"http://{i}", "hot" if i % 3 else f"page {i // 6} " * (1 + i % 5)) for i in range(4000)] + [(9000, "http://long", "é" * 2_000_000)]
    w.write(w.records(spark.createDataFrame(rows, SCHEMA).repartition(4)), str(tmp_path / "h"))
    assert sorted((tuple(r) for r in w.round_trip(spark, str(tmp_path / "h")).collect()), key=str) == brute_by_payload(rows)


def brute_by_payload(rows):
    top, many = {}, {}
    for i, _, html in rows:
        top[html], many[html] = max(i, top.get(html, -1)), many.get(html, 0) + 1
    sha = {h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in top}
    return sorted(((i, len(h.encode()), sha[h], "revisit" if i != top[h] else "response", top[h] if i != top[h] else None) for i, _, h in rows), key=str)


def test_a_payload_written_wrongly_is_seen(spark, tmp_path):
    import pytest

    rows = w.records(spark.createDataFrame([(1, "http://a", "abc")], SCHEMA)).withColumn("payload", F.lit("abd"))
    w.write(rows, str(tmp_path / "w"))
    with pytest.raises(Exception, match="payload and headers differ in record 1"):
        w.round_trip(spark, str(tmp_path / "w")).collect()


def test_filters_reach_the_reader(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    w.write(w.records(pages), str(tmp_path / "b"), compression="none")
    archive = w.read(spark, "file://" + str(tmp_path / "b"), payload="none")
    found = archive.filter((F.col("record_type") == "revisit") & F.col("record_id").isin(2, 5, 8))
    assert sorted(r.record_id for r in found.collect()) == [2, 5] and all(r.payload is None for r in archive.collect())
    reader = w.WarcReader({"path": str(tmp_path / "b")})
    rest = list(reader.pushFilters([w.EqualTo(("record_type",), "revisit"), w.EqualTo(("payload",), "x")]))
    assert len(rest) == 1 and reader.filters == {"record_type": {"revisit"}}


def test_rejected_payloads_are_not_read():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counting.taken += n
            return super().read(n)

    record = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 1000\r\n\r\n" + b"y" * 1000 + b"\r\n\r\n"
    data = record.replace(b"%s", b"response") + record.replace(b"%s", b"request")
    got = list(w.scan_file(Counting(data), {"record_type": {"request"}}, True))
    assert len(got) == 1 and Counting.taken == 1000


def test_small_payloads_stay_and_no_rows_pass(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    kinds = {(r.record_id, r.record_type) for r in w.records(pages, w.Warc(min_revisit_bytes=5)).collect()}
    assert all(t == "response" for _, t in kinds)
    w.write(w.records(pages.limit(0)), str(tmp_path / "c"))
    assert w.read(spark, str(tmp_path / "c")).count() == 0
