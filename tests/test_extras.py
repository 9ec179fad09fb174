from pyspark.sql import functions as F

from sifter.operators import extras as x


def test_menu_and_palette(spark):
    items = [(1, None, "File", None, False), (2, 1, "Open", "o", False), (3, 1, "-", None, True), (4, 1, "Recent", None, False), (5, 4, "a.txt", "r", False), (6, None, "Quit", "q", False)]
    got = x.flatten_menu(spark.createDataFrame(items, "id int, parent int, title string, action string, separator boolean"))
    assert {r.title for r in got.collect()} == {"File › Open", "File › Recent › a.txt", "Quit"}
    rows = got.select(F.col("id").alias("ord"), "title", F.array().cast("array<string>").alias("forms"))
    assert [r.ord for r in x.palette(rows, "open file").collect()] == [2]


def test_recovery(spark):
    journal = spark.createDataFrame([("/a", "/t1", "/b", "i"), ("/c", "/t2", "/d", "j"), ("/e", "/t3", "/f", "k")], "original string, temporary string, target string, identity string")
    live = spark.createDataFrame([("/b", "i"), ("/t2", "j"), ("/e", "other")], "path string, identity string")
    assert {r.original: r.found for r in x.recovery(journal, live).collect()} == {"/a": "/b", "/c": "/t2", "/e": None}


def test_hits_on_pages(spark):
    glyph = "struct<at:int,length:int,x:double,y:double,w:double,h:double>"
    schema = f"path string, spans array<struct<page:int,text:string,x:double,y:double,w:double,h:double,glyphs:array<{glyph}>>>"
    glyphs = [(i, 1, float(i), 0.0, 1.0, 2.0) for i in range(6)]
    rows = spark.createDataFrame([("/a", [(1, "abcdef", 9.0, 9.0, 9.0, 9.0, glyphs), (2, "xCDx", 5.0, 5.0, 1.0, 1.0, []), (3, "none", 0.0, 0.0, 1.0, 1.0, [])])], schema)
    got = {r.page: tuple(r.box) for r in x.text_hits(rows, "cd").collect()}
    assert got == {1: (2.0, 0.0, 2.0, 2.0), 2: (5.0, 5.0, 1.0, 1.0)}
    assert [r.limited for r in x.text_hits(rows, "cd", 1).collect()] == [True]


def test_validation(spark):
    rows = [("1.2", 3, ["n"], "a" * 64, 5, "https://h.example/x"), ("1.2", 0, ["n"], "a" * 64, 5, "https://h.example/x"), ("1.2", 1, [], "a" * 64, 5, "http://h.example/x"), (None, 1, [], "a" * 64, 5, "https://u@h.example/x")]
    df = spark.createDataFrame(rows, "version string, build int, notes array<string>, digest string, bytes long, url string")
    assert [r.v for r in df.select(x.valid_manifest(["h.example"]).alias("v")).collect()] == [True, False, False, False]
    ids = spark.createDataFrame([([" B.c ", "a.b", "b.c"],), (["nodot"],)], "i array<string>")
    assert [r.v for r in ids.select(x.valid_sources(F.col("i")).alias("v")).collect()] == [["a.b", "b.c"], None]


def test_histories(spark):
    s = spark.createDataFrame([("u", "a", 0.0), ("u", "ab", 1.0), ("u", "AB", 9.0), ("u", "c", 20.0), ("u", " ", 30.0)], "user string, text string, at double")
    assert sorted((r.key, r.text) for r in x.search_history(s).collect()) == [("ab", "AB"), ("c", "c")]
    c = spark.createDataFrame([("k", "/auto", False, 9), ("k", "/hand", True, 1), ("m", "/x", False, 1), ("m", "/y", False, 2)], "key string, path string, manual boolean, at int")
    assert {r.key: r.path for r in x.learned_choices(c).collect()} == {"k": "/hand", "m": "/y"}
    r = spark.createDataFrame([("k", f"/{i}", i) for i in range(5)], "key string, path string, at int")
    assert {v.path for v in x.rejected_paths(r, 2).collect()} == {"/3", "/4"} and x.choice_of("filename", "A b") == "filename:a\x1fb"


def test_hits_have_no_cap_unless_given(spark):
    from sifter.functions import text as t

    many = spark.createDataFrame([("ab " * 2500,)], "n string")
    assert many.select(F.size(t.match_offsets(F.col("n"), ["ab"])), F.size(t.match_offsets(F.col("n"), ["ab"], 7))).first()[:] == (2500, 7)
    glyph = "struct<at:int,length:int,x:double,y:double,w:double,h:double>"
    schema = f"path string, spans array<struct<page:int,text:string,x:double,y:double,w:double,h:double,glyphs:array<{glyph}>>>"
    rows = spark.createDataFrame([("/a", [(i, "ab", 0.0, 0.0, 1.0, 1.0, []) for i in range(600)])], schema)
    got = x.text_hits(rows, "ab").collect()
    assert [r.page for r in got] == list(range(600)) and not any(r.limited for r in got)
