import datetime as dt
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sifter.functions import text as t
from sifter.operators import clipboard as cb
from sifter.operators import extras, jobs, listings, search
from sifter.operators import files as fl
from sifter.operators.phrases import phrase_hits
from sifter.operators.query import parse
from sifter.sources import archives, catalog, changes, records, stored, texts
from sifter.streaming import history

CLIP = "id int, text string, files array<string>, image_bytes long, image_width int, image_height int, source_id string, types array<string>, enabled boolean, paused boolean"


def clip(i, text=None, files=None, image=(None, None, None), types=(), enabled=True, paused=False):
    return (i, text, files, *image, "app", list(types), enabled, paused)


def test_sensitive_types_are_those_listed(spark):
    marks = [*cb.SENSITIVE, "My-Marker"]
    rows = [clip(i, "t", types=["public.text", m.upper() if m == "My-Marker" else f"org.x.{m.title()}Type"]) for i, m in enumerate(marks)]
    rows += [clip(100 + i, "t", types=[f"org.x.{m}"]) for i, m in enumerate(("private", "secret", "one-time", "my-marker-more"))]
    got = {r.id for r in cb.acceptable(spark.createDataFrame(rows, CLIP), marker="my-marker").collect()}
    assert got == {100, 101, 102, 103}
    assert history.acceptable is cb.acceptable


def test_captures(spark):
    rows = [
        clip(1, "x"), clip(2, "x", ["/a"]), clip(3, None, ["/a", "b"]), clip(4, None, ["/" + "é" * 5000]), clip(5, None, ["/a"]), clip(6, image=(10, 100, 200)),
        clip(7, image=(10, 9000, 1)), clip(8, image=(10, 8000, 4000)), clip(9, image=(5_000_000, 10, 10)), clip(10), clip(11, None, [f"/{i}" for i in range(101)]), clip(12, "x", paused=True),
    ]
    df = spark.createDataFrame(rows, CLIP)
    assert {r.id for r in cb.acceptable(df).collect()} == {1, 5, 6}
    got = {r.id: r for r in cb.prioritised(df).select("id", "kind", cb.title().alias("title"), cb.payload_bytes().alias("n")).collect()}
    assert (got[2].kind, got[2].title, got[2].n) == ("files", "a", 2) and (got[6].kind, got[6].title, got[6].n) == ("image", "image of 10 bytes", 10) and got[3].title == "a and 1 more"
    assert got[1].title == "x" and got[10].kind is None
    stored_rows = [(1, "a", True, 5), (1, "b", False, 7)]
    h = spark.createDataFrame(stored_rows, "id int, fingerprint string, pinned boolean, bytes long")
    assert [r.problem for r in cb.load_problems(h).collect()] == ["id"] and tuple(cb.totals(h).first()) == (2, 1, 12)
    assert sorted(r.problem for r in cb.load_problems(h, cb.Limits(rows=1, pinned=0, total_bytes=11)).collect()) == ["bytes", "id", "pinned", "rows"]
    assert [r.id for r in df.filter(cb.matches("AND 1 ")).collect()] == [3]


def test_records_of_other_paths_stay(spark, tmp_path):
    at, base = dt.datetime(2024, 1, 1), str(tmp_path / "r")
    row = lambda p, x: spark.createDataFrame([(p, at, 1, x, 1, False, "i", [])], records.SCHEMA)
    held = lambda: {r.path: r.text for r in records.load(spark, base).collect()}
    assert held() == {}
    for i in range(6):
        records.save(row(f"/{i}", "old"), base)
    records.save(row("/3", "new"), base)
    assert held() == {f"/{i}": "new" if i == 3 else "old" for i in range(6)}
    records.remove(spark, spark.createDataFrame([("/3",), ("/none",)], "path string"), base)
    assert held() == {f"/{i}": "old" for i in range(6) if i != 3}
    records.clear(spark, base)
    assert held() == {}
    files = spark.createDataFrame([("/a", at, 1, "i9")], "path string, modified timestamp_ntz, size long, identity string")
    for target, identity in (("/a", None), ("/b", "i9")):
        with pytest.raises(ValueError):
            records.export(row("/a", "x"), files, target, identity)
    records.export(row("/a", "some\ntext"), files, str(tmp_path / "out"), "i1")
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value.strip() == "some\ntext"
    moved = records.rebase(spark.createDataFrame([("/old/x", ["/old", "/older"])], "p string, q array<string>"), ["p", "q"], "/old", "/new").first()
    assert (moved.p, moved.q) == ("/new/x", ["/new", "/older"])
    assert [r.path for r in records.joined_paths(spark.createDataFrame([("/b",), ("/a",)], "path string")).collect()] == ["/a", "/b"]


def test_hits_of_accented_words(spark):
    glyph = "struct<at:int,length:int,x:double,y:double,w:double,h:double>"
    schema = f"path string, spans array<struct<page:int,text:string,x:double,y:double,w:double,h:double,glyphs:array<{glyph}>>>"
    rows = spark.createDataFrame([("/a", [(1, "Le Café", 0.0, 0.0, 1.0, 1.0, [])])], schema)
    assert [extras.text_hits(rows, w).count() for w in ("café", "CAFE", "cafe", "")] == [1, 1, 1, 0]


def test_menus_of_any_depth(spark):
    items = [(i, i - 1 if i else None, f"m{i}", "do", False) for i in range(40)]
    got = {r.id: r.title for r in extras.flatten_menu(spark.createDataFrame(items, "id int, parent int, title string, action string, separator boolean")).collect()}
    assert got[39] == " › ".join(f"m{i}" for i in range(40)) and len(got) == 40
    assert extras.flatten_menu(spark.createDataFrame(items, "id int, parent int, title string, action string, separator boolean"), 3).count() == 4


def test_snapshots_survive_failed_and_circular_writes(spark, tmp_path):
    base, roots = str(tmp_path / "s"), ["/r"]
    old = spark.createDataFrame([("/r/a", 1), ("/r/b", 2)], "path string, size long")
    catalog.save_snapshot(old, base, roots)
    broken = old.withColumn("size", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        catalog.save_snapshot(broken, base, roots)
    assert catalog.load_snapshot(spark, base, roots).count() == 2
    catalog.save_snapshot(catalog.load_snapshot(spark, base, roots).filter("size = 2"), base, roots)  # reads what it replaces
    assert [r.path for r in catalog.load_snapshot(spark, base, roots).collect()] == ["/r/b"]
    catalog.invalidate(spark, base, roots)
    assert catalog.load_snapshot(spark, base, roots) is None
    both = spark.createDataFrame([("/r/a", 1), ("/q/b", 2)], "path string, size long")
    catalog.save_by_root(both, base, ["/r", "/q"])
    assert [r.path for r in catalog.load_snapshot(spark, base, ["/q"]).collect()] == ["/q/b"]
    fresh = spark.createDataFrame([("/r/new", 5), ("/q/none", 1)], "path string, size long")
    assert {r.path for r in catalog.rebuilt(both, "/r", fresh).collect()} == {"/q/b", "/r/new"}
    assert catalog.limited(both, 1)[1] and not catalog.limited(both, 2)[1] and catalog.limited(both, 1)[0].count() == 1


def test_jobs(spark, tmp_path):
    events = [("/a", 1, "queue"), ("/a", 2, "start"), ("/a", 3, "change"), ("/a", 4, "start"), ("/a", 5, "finish"), ("/b", 1, "queue"), ("/b", 2, "cancel"), ("/c", 1, "finish"), ("/d", 1, "queue"), ("/d", 2, "start"), ("/d", 3, "fail"), ("/d", 4, "retry"), ("/e", 1, "queue"), ("/e", 2, "cancel"), ("/e", 3, "resume")]
    df = spark.createDataFrame(events, "path string, at int, event string")
    want = {"/a": "done", "/b": "cancelled", "/c": None, "/d": "waiting", "/e": "waiting"}
    assert {r.path: r.state for r in jobs.states(df).collect()} == want
    src = str(tmp_path / "e")
    for turn in (1, 2, 3, 4, 5):
        df.filter(F.col("at") == turn).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = history.job_stream(stream).writeStream.outputMode("update").format("memory").queryName("jobs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.path for r in spark.table("jobs").collect()} == {"/a", "/b", "/d", "/e"} and {"/a", "/d"} <= {r.path for r in spark.table("jobs").filter("state in ('done', 'waiting')").collect()}
    rows = spark.createDataFrame([("/x10", "done", "n"), ("/x9", "done", "n"), ("/y", "changed", "Üb")], "path string, state string, note string")
    assert [r.path for r in rows.orderBy(*jobs.job_order()).collect()] == ["/y", "/x9", "/x10"] and jobs.matching(rows, "ub").count() == 1
    assert jobs.counts(rows).first().n_done == 2
    base = str(tmp_path / "jobs")
    assert jobs.load_jobs(spark, base) is None
    jobs.save_jobs(rows.withColumn("state", F.when(F.col("path") == "/x9", "running").otherwise(F.col("state"))), base)
    assert {r.path: r.state for r in jobs.load_jobs(spark, base).collect()} == {"/x9": "waiting", "/x10": "done", "/y": "changed"}
    names = search.with_folded(spark.createDataFrame([("/s/a.pdf", False), ("/s/cache/b.png", False), ("/out/c.png", False), ("/s/d.txt", False)], "path string, is_dir boolean"))
    assert [r.path for r in names.filter(jobs.eligible(["/out"], "/s/cache")).collect()] == ["/s/a.pdf"]


def test_change_stream_maintains_the_catalog(spark, tmp_path):
    root = tmp_path / "tree"
    for i in range(6):
        (root / f"d{i % 2}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 2}" / f"f{i}").write_text("x" * i)
    scan = lambda: catalog.scan(spark, [str(root)]).select("path", "is_dir", "size")
    held = {"now": spark.createDataFrame(scan().collect(), "path string, is_dir boolean, size long"), "scans": 0}

    def write(df):
        held["now"] = spark.createDataFrame(df.collect(), df.schema)

    def rescan():
        held["scans"] += 1
        return scan()

    start = time.time_ns()
    time.sleep(0.05)
    (root / "d0" / "f0").unlink()
    (root / "d1" / "new").write_text("abc")
    (root / "d1" / "f1").write_text("longer")
    time.sleep(0.05)

    def run(above):
        stream = changes.changes(spark, [str(root)], since=start, latency=0.0).select("path")
        return history.maintain_catalog(stream, lambda paths: scan(), lambda: held["now"], write, rescan, above).start().awaitTermination(120)

    assert run(2048) and held["scans"] == 0
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(held["now"]) == rows(scan())
    assert run(1) and held["scans"] == 1 and rows(held["now"]) == rows(scan())


def test_taps_are_sorted_over_parts(spark, tmp_path):
    quick = [(k * 1.0 + s, p) for k in range(40) for s, p in ((0.0, True), (0.08, False), (0.2, True), (0.28, False))]
    rows = [("u", at, p, False) for at, p in quick]
    schema = "user string, time double, press boolean, other boolean"
    src = str(tmp_path / "taps")
    spark.createDataFrame(rows[::-1], schema).coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        q = history.double_tap_stream(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("append").format("memory").queryName("taps").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = fl.double_taps(spark.createDataFrame(rows, schema), "user")
    assert sorted(r.time for r in spark.table("taps").collect()) == sorted(r.time for r in batch.collect()) and batch.count() == 40


def test_listings(spark):
    names = ["/h/b10.txt", "/h/b9.txt", "/h/.hid", "/h/sub", "/h/sub/x.txt"]
    cat = search.with_folded(spark.createDataFrame([(p, p == "/h/sub", 1, dt.datetime(2024, 1, 1)) for p in names], "path string, is_dir boolean, size long, modified timestamp_ntz"))
    assert [r.name for r in listings.browse(cat, "/h").collect()] == ["sub", "b9.txt", "b10.txt"]
    text = spark.createDataFrame([("AnnualBudget",), ("none",), (None,)], "x string").withColumn("n", t.fold(F.col("x")))
    got = [r.h for r in text.select(listings.highlights(F.col("x"), F.col("n"), ["ab", "ud"]).alias("h")).collect()]
    assert [tuple(s) for s in got[0]] == [(0, 1), (6, 1), (7, 2)] and got[1] == [] and got[2] is None
    assert listings.restore('{"name": "n", "query": "q", "date": 9, "size": -1, "more": 1}') == listings.SavedSearch("n", "q", date=4, size=0)
    gone = listings.SavedSearch("n", "x", all=False, folder="/nowhere")
    assert listings.run_saved(cat.withColumn("tags", F.array().cast("array<string>")), gone, dt.datetime(2024, 1, 2)).count() == 0
    steps = listings.phases(spark.createDataFrame([(1, "/d/A", "/d/B"), (2, "/d/B", "/d/A")], "ord int, original string, target string"))
    back = listings.undo(steps, steps.select("phase", "ord").filter("phase = 1 or ord = 1")).orderBy("turn").collect()
    assert [(r.destination, r.source.startswith("/d/.sifter")) for r in back[1:]] == [("/d/B", True), ("/d/A", True)] and back[0].source == "/d/B"


def test_small_functions(spark):
    row = spark.createDataFrame([("  My \t Rèport ", "k", "data", "o f\nthe", "ﬁle Ⅳ Ünï")], "a string, k string, v string, s string, g string").select(
        t.collapse(F.col("a")).alias("a"), t.fingerprint(F.col("k"), F.col("v")).alias("f"), t.spaced_offsets(F.col("s"), ["ofthe", "ofnone"]).alias("s"), t.fold_general(F.col("g")).alias("g")
    ).first()
    import hashlib

    assert row.a == "my report" and row.f == hashlib.sha256(b"k\0data").hexdigest() and [tuple(x) for x in row.s] == [(0, 7)] and row.g == "file iv uni"
    assert parse("ext:ĞIF").extensions == {t.fold_value("ĞIF")}
    shown = spark.createDataFrame([(999, dt.datetime(2024, 3, 4, 5, 6, 7)), (1500, None), (20_000_000, None)], "n long, at timestamp_ntz")
    assert [tuple(r) for r in shown.select(t.size_text(F.col("n")), t.day_text(F.col("at"))).collect()] == [("999 bytes", "2024-03-04 05:06"), ("1.5 KB", ""), ("20.0 MB", "")]
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.3).alias("w"), F.lit(0.4).alias("h"))
    turned = spark.range(1).select(*[t.rotated_box(box, F.lit(k)).alias(f"t{k}") for k in (0, 90, 180, 270)]).first()
    assert [tuple(round(v, 6) for v in b) for b in turned] == [(0.1, 0.2, 0.3, 0.4), (0.2, 0.6, 0.4, 0.3), (0.6, 0.4, 0.3, 0.4), (0.4, 0.1, 0.4, 0.3)]
    groups = spark.createDataFrame([("a", 5, 1, 5), ("b", 9, 1, 0), ("c", 7, 2, 5)], "first_path string, size int, files int, extra_bytes int")
    assert [r.first_path for r in groups.orderBy(*fl.duplicate_order()).collect()] == ["c", "a", "b"]


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.md").write_bytes("wörld".encode("utf-16"))
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "big.log").write_text("x" * 100)
    (tmp_path / "bad.csv").write_bytes(b"\xff\xd8\x00")
    got = {os.path.basename(r.path): r.text for r in texts.read_plain(spark, str(tmp_path), texts.Bounds(plain_bytes=50)).collect()}
    assert got == {"a.txt": "héllo", "b.md": "wörld"}
    files = spark.createDataFrame([("/p", b"one|two|three"), ("/q", b"!"), ("/r", b"x" * 90)], "path string, content binary")

    def extractor(path, raw):
        if raw == b"!":
            raise ValueError("locked")
        return raw.decode().split("|")

    out = {r.path: r for r in texts.extract_pages(files, extractor, texts.Bounds(file_bytes=50, pages=2)).collect()}
    assert list(out) == ["/p"] and (out["/p"].pages, out["/p"].limited) == (2, True) and out["/p"].text == "\n[page 1]\none\n[page 2]\ntwo"
    short = texts.extract_pages(files, extractor, texts.Bounds(characters=16)).filter("path = '/p'").first()
    assert (short.pages, short.limited, len(short.text)) == (2, True, 16)


def test_archive_members_by_udf(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/One", "line\n" * 50)
        z.writestr("x/one", "two")
    df = spark.createDataFrame([("a", (tmp_path / "a.zip").read_bytes())], "path string, content binary")
    found = archives.listing(df)
    both = found.join(df.withColumnRenamed("path", "archive"), "archive")
    got = both.select("name", archives.member_bytes("content", "offset", "compressed", "size", "crc", "method", "flags").alias("b")).collect()
    assert {r.name: bytes(r.b) for r in got} == {"x/One": b"line\n" * 50, "x/one": b"two"}
    assert [(r.members, r.names, r.acceptable) for r in archives.totals(found).collect()] == [(2, 1, False)]
    assert archives.still_there(found, found.filter("name = 'x/one'")).count() == 1


def test_placed_and_stored(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = stored.placed(rows.repartition(8), [F.col("v").desc()]).collect()
    assert len(got) == 1000 and all(r.place == 1000 - r.v for r in got)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert stored.stored(spark, "t x", make).count() == stored.stored(spark, "t x", make).count() == 3 and len(made) == 1
    stored.forget(spark, "t ")
    stored.stored(spark, "t x", make)
    assert len(made) == 2


def test_phrases_of_any_length(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, f"x{body}y"), (2, body), (3, "beta gamma"), (4, ""), (5, None), (6, "alpha beta gamma delta  epsilon zeta")]
    phrases = [(1, body), (2, "beta gamma"), (3, "a"), (4, ""), (5, None), (6, body), (7, "pha beta gamma delta epsilon zet")]
    got = phrase_hits(spark.createDataFrame(docs, "d long, norm_text string"), spark.createDataFrame(phrases, "p long, phrase string"), "d", "p").collect()
    assert sorted((r.p, r.d) for r in got) == sorted((p, d) for p, x in phrases for d, y in docs if x and y and x in y)


def test_filters_reach_the_scan(spark, tmp_path):
    rows = search.with_folded(spark.createDataFrame([("/a/b.pdf", False, 5, dt.datetime(2024, 1, 1))], "path string, is_dir boolean, size long, modified timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "c"))
    cat = spark.read.parquet(str(tmp_path / "c")).withColumn("tags", F.array().cast("array<string>"))

    def pushed(condition):
        plan = cat.filter(condition).select("path")._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PushedFilters") :].split("]")[0]

    day = dt.datetime(2024, 1, 2)
    assert "GreaterThanOrEqual(modified" in pushed(search.days_filter("modified", day, 7)) and "LessThan(modified" in pushed(search.natural_filter(parse("昨天"), day))
    assert "StringEndsWith(norm_name" in pushed(search.extension_filter(parse("ext:pdf"))) and "size" in pushed(search.natural_filter(parse("大于1KB"), day))
    plan = search.search(cat, "b pdf", as_of=day)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(norm_name,b)" in plan or "Contains(norm_name" in plan
