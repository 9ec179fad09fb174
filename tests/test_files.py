import datetime as dt
import os
import random
import zipfile

from pyspark.sql import functions as F

from sifter.operators import files as fl
from sifter.sources import archives, catalog, records
from sifter.streaming import history


def test_duplicates(spark):
    rows = [("/a/x", "abcde", "1"), ("/b/x", "vwxyz", "2"), ("/c/y", "abcde", "3"), ("/d/e", "", "4"), ("/d/f", "", "5"), ("/e/link", "abcde", "1"), ("/q", "lonely one", "6")]
    df = spark.createDataFrame([(p, len(c), c, i) for p, c, i in rows], "path string, size long, content string, identity string")
    got = {r.size: r for r in fl.duplicate_groups(fl.duplicate_members(df)).collect()}
    assert (got[5].paths, got[5].files, got[5].extra_bytes) == (3, 2, 5) and got[0].paths == 2 and len(got) == 2


def test_incremental_equals_full_scan(spark, tmp_path):
    root = tmp_path / "root"
    for i in range(30):
        p = root / f"d{i % 3}" / f"s{i % 2}" / f"f{i}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * i)
    for skipped in (".hidden", "d0/node_modules/z", "d1/pack.app/inner"):
        (root / skipped).mkdir(parents=True)
    (root / "d1/pack.app/inner/t").write_text("")
    os.symlink(root / "d0", root / "link")
    full = lambda: catalog.scan(spark, [str(root), str(root / "d0")], [str(root / "d2/s1")], 2).select("path", "is_dir", "size")
    before = full().collect()
    names = {r.path[len(str(root)) + 1 :] for r in before}
    assert len(names) == len(before) and "link" in names and "link/s0" not in names and "d1/pack.app" in names and "d1/pack.app/inner" not in names and not any("node_modules" in n or n.startswith("d2/s1/") for n in names)
    old = spark.createDataFrame(before, "path string, is_dir boolean, size long")
    os.rename(root / "d0", root / "moved")
    (root / "d1" / ".hidden-file").write_text("")
    (root / "d1" / "new.txt").write_text("abc")
    changed = spark.createDataFrame([(str(root / x),) for x in ("d0", "moved", "d1/.hidden-file", "d1/new.txt", "moved/s0")], "path string")
    after = sorted(map(tuple, full().collect()))
    assert sorted(map(tuple, fl.apply_changes(old, changed, full()).collect())) == after
    catalog.save_snapshot(full(), str(tmp_path / "snap"), [str(root)])
    assert sorted(map(tuple, catalog.load_snapshot(spark, str(tmp_path / "snap"), [str(root)]).collect())) == after
    assert catalog.load_snapshot(spark, str(tmp_path / "snap"), ["/other"]) is None


def test_minimal_cover_equals_brute_force(spark):
    rng = random.Random(1)
    paths = {"/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(40)}
    want = {p for p in paths if not any(p.startswith(o + "/") for o in paths)}
    assert {r.path for r in fl.minimal_cover(spark.createDataFrame([(p,) for p in paths], "path string")).collect()} == want


def test_rename(spark):
    sel = spark.createDataFrame([(1, "/d/A.txt", False), (2, "/d/B.v2", True)], "ord long, path string, is_dir boolean")
    plan = {r.original: r.target for r in fl.rename_plan(sel, fl.Rename(prefix="2026-", numbered=True, start=7, digits=3)).collect()}
    assert plan == {"/d/A.txt": "/d/2026-A-007.txt", "/d/B.v2": "/d/2026-B.v2-008"}
    pairs = lambda *v: spark.createDataFrame([(1, a, b) for a, b in v], "ord long, original string, target string")
    there = spark.createDataFrame([("/d/A",), ("/d/B",), ("/d/C",)], "path string")
    problems = lambda *v: sorted({r.problem for r in fl.rename_violations(pairs(*v), there).collect()})
    assert problems(("/d/A", "/d/B"), ("/d/B", "/d/A")) == [] and problems(("/d/A", "/d/B")) == ["exists"]
    assert problems(("/d/A", "/d/x"), ("/d/B", "/d/X")) == ["collision"] and problems(("/d", "/e"), ("/d/A", "/d/Q")) == ["nested"]
    assert problems(("/d/A", "/d/" + "é" * 130)) == ["name"]


def test_retention_and_taps(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [(f"f{i:03}", now - dt.timedelta(minutes=i), i == 150, 10) for i in range(205)] + [("old", now - dt.timedelta(days=31), False, 1), ("pin", now - dt.timedelta(days=90), True, 1)]
    df = spark.createDataFrame(rows, "fingerprint string, created timestamp_ntz, pinned boolean, bytes long")
    kept = {r.fingerprint for r in fl.retained(df, now).collect()}
    assert len(kept) == 200 and {"pin", "f150"} <= kept and "old" not in kept
    assert {r.fingerprint for r in fl.retained(df, now + dt.timedelta(days=31)).collect()} == {"pin", "f150"}
    taps = lambda *v: fl.double_taps(spark.createDataFrame([("u", t, p, o) for t, p, o in v], "user string, time double, press boolean, other boolean"), "user").count()
    assert taps((0.0, True, False), (0.08, False, False), (0.2, True, False), (0.28, False, False)) == 1
    assert taps((0.0, True, False), (0.08, False, False), (0.1, True, True), (0.2, True, False), (0.28, False, False)) == 0
    assert taps((0.0, True, False), (0.5, False, False), (0.6, True, False), (0.7, False, False)) == 0
    assert taps((0.0, True, False), (0.08, False, False), (0.98, True, False), (1.0, False, False)) == 0


def test_archives(spark, tmp_path):
    name = "乐乐[2026]*?.txt"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, "line\n" * 2000)
        z.writestr("../escape.txt", "x")
        z.writestr("dir/", "")
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    data = [(p.name, p.read_bytes()) for p in sorted(tmp_path.glob("*.zip"))]
    found = archives.listing(spark.createDataFrame(data, "path string, content binary"))
    rows = {r.name: r for r in found.collect()}
    assert rows[name].safe and not rows["../escape.txt"].safe and rows["dir/"].is_dir and not rows[name].symlink and len(rows) == 3
    r = rows[name]
    out = archives.extract(data[0][1], r.offset, r.compressed, r.size, r.crc, r.method, r.flags)
    assert out == b"line\n" * 2000 and archives.extract(data[0][1], r.offset, r.compressed, r.size, r.crc + 1, r.method, r.flags) is None
    assert [x.name for x in archives.search_members(found, ["2026"]).collect()] == [name]


def test_records(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("/a", t, 1, "x", 1, False, "i", []), ("/b", t, 2, "y", 1, False, "j", [])], records.SCHEMA)
    records.save(rows, str(tmp_path / "r"))
    files = spark.createDataFrame([("/a", t, 1), ("/b", t, 3)], "path string, modified timestamp_ntz, size long")
    assert [r.path for r in records.current(records.load(spark, str(tmp_path / "r")), files).collect()] == ["/a"]
    runs = spark.createDataFrame([("/c", "failed", 1), ("/c", "cancelled", 2)], "path string, outcome string, at int")
    more = files.unionByName(spark.createDataFrame([("/c", t, 1), ("/d", t, 1)], files.schema))
    assert {r.path: r.state for r in history.job_states(rows, more, runs).collect()} == {"/a": "done", "/b": "changed", "/c": "cancelled", "/d": "waiting"}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", 1, dt.datetime(2024, 1, 1), False), ("a", 2, dt.datetime(2024, 1, 3), True), ("b", 3, dt.datetime(2024, 1, 2), False)]
    schema = "fingerprint string, id long, created timestamp, pinned boolean"
    src = str(tmp_path / "src")
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = history.upsert_stream(stream).writeStream.outputMode("update").format("memory").queryName("upserts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("upserts").groupBy("fingerprint").agg(F.max_by("id", "created").alias("id"), F.max("created").alias("created"), F.bool_or("pinned").alias("pinned"))
    batch = fl.merge_history(spark.createDataFrame(rows, schema).withColumn("bytes", F.lit(1))).select("fingerprint", "created", "pinned")
    assert sorted(map(tuple, got.select("fingerprint", "created", "pinned").collect())) == sorted(map(tuple, batch.collect()))
    ok = spark.createDataFrame([("t", None, "app", ["x.Concealed"], True, False), ("t", None, "app", [], True, False), ("t", None, "no", [], True, False), ("x" * 200_001, None, "app", [], True, False), (None, ["/f"], "app", None, True, False), ("t", None, "app", [], False, False)], "text string, files array<string>, source_id string, types array<string>, enabled boolean, paused boolean")
    assert history.acceptable(ok, ["no"]).count() == 2


def test_registered_queries_agree_with_sql(spark):
    import duckdb

    from sifter.plans import registry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    con = duckdb.connect()
    for file in os.listdir(d):
        path = f"{d}/{file}"
        con.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    assert set(registry.queries()) == set(registry.oracle_sql())
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    empty = []
    for name, run in registry.queries().items():
        df = run(spark, d)
        cur = con.execute(registry.oracle_sql()[name])
        cols = [c[0] for c in cur.description]
        got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
        assert got == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str), name
        empty += [name] * (not got)
    print('no rows:', empty)
