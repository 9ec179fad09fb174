import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sifter.functions import text as t
from sifter.operators import search as s
from sifter.operators.query import parse

AS_OF = dt.datetime(2024, 1, 31, 12)


def table(spark, paths, **more):
    rows = [(p, more.get("dirs", {}).get(p, False), more.get("sizes", {}).get(p, 10), more.get("times", {}).get(p), more.get("tags", {}).get(p, [])) for p in paths]
    return s.with_folded(spark.createDataFrame(rows, "path string, is_dir boolean, size long, modified timestamp_ntz, tags array<string>"), phonetic_names=True)


def slow_fuzzy(text, word):
    if not word:
        return 0
    if text == word:
        return 1000
    if text.startswith(word):
        return 850
    if word in text:
        return 700 - min(120, 3 * text.index(word))
    if len(word) < 2 or not word.isascii():
        return None
    # Leftmost places of the letters in order, then the score from the places alone.
    places = []
    for c in word:
        places.append(text.find(c, places[-1] + 1 if places else 0))
        if places[-1] < 0:
            return None
    starts = sum(p == 0 or not text[p - 1].isalnum() for p in places)
    gaps = [b - a - 1 for a, b in zip(places, places[1:], strict=False)]
    joins = 18 * gaps.count(0) - sum(min(140, 9 * g) for g in gaps if g)
    return max(40, 380 + 28 * starts + joins - min(100, 3 * places[0]))


def test_fuzzy_equals_a_slow_version(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc-_é1.") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.fold(F.col("x")).alias("n"))
    for word in ("ab", "a", "abc", "c1", "a-b", "é", "cab1", "%a", ""):
        got = rows.select("n", s.fuzzy_score(F.col("n"), word).alias("v")).collect()
        assert [r.v for r in got] == [slow_fuzzy(r.n, t.fold_value(word)) for r in got], word


@pytest.mark.parametrize(
    ("path", "words", "precision", "score"),
    [
        ("/d/preview.txt", "preview", "fuzzy", 2000),
        ("/d/preview-notes.txt", "preview", "fuzzy", 1050),
        ("/d/my-preview.txt", "preview", "fuzzy", 891),
        ("/d/preview-notes.txt", "view", "fuzzy", 891),
        ("/d/my-preview.txt", "view", "fuzzy", 882),
        ("/d/AnnualBudget2026.xlsx", "ab26", "fuzzy", 500),
        ("/tmp/reports/AnnualBudget2026.xlsx", "reports budget", "path", 1224),
        ("/tmp/reports/AnnualBudget2026.xlsx", "reports budget", "fuzzy", None),
        ("/tmp/abc.txt", "cba", "path", None),
        ("/d/preview-notes.txt", "preview", "exact", None),
        ("/d/乐乐/资料.txt", "乐乐", "fuzzy", None),
        ("/d/重庆音乐资料.txt", "chongqing", "fuzzy", 550),
        ("/d/重庆音乐资料.txt", "yinyue", "fuzzy", 450),
        ("/d/重庆音乐资料.txt", "cqyyzl", "fuzzy", 600),
        ("/d/重庆音乐资料.txt", "ciqu", "fuzzy", None),
        ("/d/乐清银行.txt", "yqyh", "fuzzy", 600),
    ],
)
def test_golden_scores(spark, path, words, precision, score):
    assert table(spark, [path]).select(s.query_score(parse(words), precision).alias("v")).first().v == score


def test_order_and_injected_rows(spark):
    cat = table(spark, ["/d/my-preview.txt", "/d/preview-notes.txt", "/d/preview.txt", "/d/other.txt"])
    usage = spark.createDataFrame([("/d/my-preview.txt", 100)], "path string, n long")
    names = lambda **k: [r.path[3:] for r in s.search(cat, k.pop("text", "preview"), as_of=AS_OF, prefs=s.Preferences(**k)).collect()]
    assert names(opens=usage) == ["preview.txt", "preview-notes.txt", "my-preview.txt"]
    assert names(manual="/d/other.txt")[0] == "other.txt"
    assert names(rejected=cat.filter("path like '%/preview.txt'").select("path"))[-1] == "preview.txt"
    assert names(text="preview -other", manual="/d/other.txt")[0] == "preview.txt" and names(text="ext:a..b") == []


def test_boundaries(spark):
    size = {"/a": 1_000_000, "/b": 999_999, "/c": 100_000_001, "/f": 5_000_000}
    day = {"/a": dt.datetime(2024, 1, 25), "/b": dt.datetime(2024, 2, 1), "/c": dt.datetime(2024, 1, 31, 23, 59), "/g": None}
    cat = table(spark, ["/a", "/b", "/c", "/f", "/g"], sizes=size, dirs={"/f": True}, times=day, tags={"/a": ["Wörk"]})
    got = lambda c: sorted(r.path for r in cat.filter(c).collect())
    assert [got(s.size_band(b)) for b in (1, 2, 3)] == [["/b", "/g"], ["/a"], ["/c"]]
    assert got(s.days_filter("modified", AS_OF, 7)) == ["/a", "/c"] and got(s.tag_filter("WORK")) == ["/a"]
    assert got(s.in_scope(["/a"])) == ["/a"] and got(s.type_filter("folders")) == ["/f"]
    assert got(s.extension_filter(parse("-ext:x"))) == ["/a", "/b", "/c", "/f", "/g"]


def test_content(spark):
    rows = spark.createDataFrame([("ANNUAL CONTRACT 2026",), ("annual contract draft",), ("annual other contract",), ("合同 草\n稿",)], "x string")
    keep = lambda q: [r.x for r in rows.filter(s.content_filter(parse(q), t.fold(F.col("x")))).collect()]
    assert keep('ext:pdf "annual contract" -draft') == ["ANNUAL CONTRACT 2026"] and keep("合同 -草稿") == []


def test_texts_and_places(spark):
    rows = spark.createDataFrame([("café ALPHA alpha",)], "x string").withColumn("n", t.fold(F.col("x")))
    assert len(rows.select(t.match_offsets(F.col("n"), ["cafe", "alpha"])).first()[0]) == 3
    paths = ["/tmp/a/same.txt", "/tmp/b/same.txt", "/tmp/b/one.txt"]
    places = {r.path: r.place for r in s.compact_location(table(spark, paths)).collect()}
    assert places == {paths[0]: "a", paths[1]: "b", paths[2]: "/tmp/b"}
    assert [r[0] for r in s.near_names(table(spark, ["/x/乐乐.txt", "/x/乐乐资料.txt"]), "乐了").collect()] == ["乐乐"]
    keys = ["f10", "F2", "f002b", "f1"]
    assert [r.x for r in spark.createDataFrame([(k,) for k in keys], "x string").orderBy(t.natural_key(F.col("x"))).collect()] == ["f1", "F2", "f002b", "f10"]
    d = spark.createDataFrame([("abc", "acb", 2), ("乐乐", "乐了", 1), ("", "a", 1), ("a" * 65, "a", 100)], "a string, b string, d int")
    assert all(r.d == r.v for r in d.select("d", t.edit_distance(F.col("a"), F.col("b")).alias("v")).collect())
