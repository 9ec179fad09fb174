"""Registered queries of what the main registry has not: parsing, collections, captures, jobs, renames, archives, pages."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions import text as t
from sifter.operators import clipboard as cb
from sifter.operators import extras as x
from sifter.operators import files as fl
from sifter.operators import jobs as jb
from sifter.operators import listings as ls
from sifter.operators import search as s
from sifter.operators.query import parse
from sifter.plans.registry import AS_OF, CATALOG, DOCS, FOLD, ORDERS, _score_sql, _table, catalog, documents, fuzzy_sql, orders, query
from sifter.sources import archives, records, texts

# Parsing

_CASES = (
    # text, words, phrases, excluded, extensions, type, days, above, tag, valid
    ('ext:PDF "年度合同" -草稿', "", "年度合同", "草稿", "pdf", "all", None, None, None, True),
    ('"今天"', "", "今天", "", "", "all", None, None, None, True),
    ("最近7天的PDF 合同 -草稿", "合同", "", "草稿", "", "pdf", 7, None, None, True),
    ("最近一周的 PDF", "", "", "", "", "pdf", 7, None, None, True),
    ("大于100MB的视频", "", "", "", "", "video", None, 100_000_000, None, True),
    ("昨天的合同的PDF", "合同", "", "", "", "pdf", None, None, None, True),
    ("标签:工作 合同", "合同", "", "", "", "all", None, None, "工作", True),
    ("pdf 合同 年度", "合同 年度", "", "", "", "pdf", None, None, None, True),
    ("ext:../pdf", "", "", "", "", "all", None, None, None, False),
    ("ext:pdf,png -ext:png", "", "", "", "pdf png", "all", None, None, None, True),
    ('"ext:pdf"', "", "ext:pdf", "", "", "all", None, None, None, True),
    ('ext:"PDF"', "", "", "", "pdf", "all", None, None, None, True),
    ('-"草稿 版本" "annual \\"contract\\""', "", 'annual "contract"', "草稿 版本", "", "all", None, None, None, True),
    ("tag:red 近2周 小于5KB", "", "", "", "", "all", 14, None, "red", True),
)
_CASE_SCHEMA = "input string, words string, phrases string, excluded string, extensions string, type string, days int, above long, tag string, valid boolean"


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


@query("parser_cases", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, c)) + ")" for c in _CASES) + ") AS t(input, words, phrases, excluded, extensions, type, days, above, tag, valid)")
def parser_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for (text, *_) in _CASES:
        q = parse(text)
        n = q.natural
        rows.append((text, " ".join(q.words), " ".join(q.phrases), " ".join(q.excluded), " ".join(sorted(q.extensions)), q.type, n.days, n.above, n.tag, q.valid))
    return spark.createDataFrame(rows, _CASE_SCHEMA)


# Names


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return s.with_folded(orders(spark, d)).withColumn("tags", F.array().cast("array<string>"))


_NAMED = ORDERS + ", nam AS (SELECT *, id || '.pdf' AS norm_name, CAST(id AS VARCHAR) AS norm_stem, '/orders' AS norm_parent, path AS norm_path FROM ord)"
query("type_filter", f"WITH {ORDERS} SELECT id FROM ord WHERE NOT is_dir")(lambda spark, d: _ordered(spark, d).filter(s.type_filter("pdf")).select("id"))
query("type_folders", f"WITH {ORDERS} SELECT id FROM ord WHERE is_dir")(lambda spark, d: _ordered(spark, d).filter(s.type_filter("folders")).select("id"))
query("type_documents", f"WITH {DOCS} SELECT doc_id FROM docs")(
    lambda spark, d: s.with_folded(documents(spark, d).withColumn("is_dir", F.lit(False))).filter(s.type_filter("documents")).select("doc_id")
)
query("precision_exact", f"WITH {_NAMED} SELECT id, 2000 AS score FROM nam WHERE norm_stem = '7' OR norm_name = '7'")(
    lambda spark, d: _ordered(spark, d).select("id", s.query_score(parse("7"), "exact").cast("int").alias("score")).filter("score is not null")
)


@query("hidden_paths", "SELECT page_id FROM pages WHERE page_id % 5 = 0")
def hidden_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/srv/"), F.when(F.col("page_id") % 5 == 0, ".cache/").otherwise("a.b/"), F.col("page_id"))
    return _table(spark, d, "pages").withColumn("path", path).filter(s.hidden()).select("page_id")


_KIND = "CASE WHEN n_chars % 4 = 0 THEN '/home/u/Library/Caches/' WHEN n_chars % 4 = 1 THEN '/home/u/Library/Mobile Documents/' WHEN n_chars % 4 = 2 THEN '/home/u/Library/CloudStorage/' ELSE '/home/u/docs/' END"


@query("library_paths", f"SELECT doc_id, {_KIND} || doc_id AS path FROM documents WHERE n_chars % 4 <> 0")
def library_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", F.concat(F.expr(_KIND), F.col("doc_id")).alias("path"))
    return rows.filter(ls.outside_library("/home/u"))


@query("edit_distance", f"SELECT p_partkey, CAST(CASE WHEN length(p_name) > 64 THEN 100 ELSE levenshtein({FOLD.format('p_name')}, {FOLD.format('p_type')}) END AS INTEGER) AS distance FROM part")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", t.edit_distance(F.col("p_name"), F.col("p_type")).alias("distance"))


@query("highlights", f"""WITH {CATALOG}, h AS (SELECT id, norm_name AS x, strpos(norm_name, 're') AS hit, strpos(norm_name, 'r') AS r FROM cat),
e AS (SELECT *, CASE WHEN r > 0 AND strpos(substr(x, r + 1), 'e') > 0 THEN r + strpos(substr(x, r + 1), 'e') END AS e FROM h)
SELECT id, CAST(CASE WHEN hit > 0 THEN (length(x) - length(replace(x, 're', ''))) // 2 WHEN e IS NOT NULL THEN 2 ELSE 0 END AS INTEGER) AS spans,
  CAST(CASE WHEN hit > 0 THEN hit - 1 WHEN e IS NOT NULL THEN r - 1 END AS INTEGER) AS first, CAST(CASE WHEN hit > 0 THEN 2 WHEN e IS NOT NULL THEN 1 END AS INTEGER) AS length FROM e""")  # fmt: skip
def highlights(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d).select("id", ls.highlights(F.col("name"), F.col("norm_name"), ["RE"]).alias("h"))
    return rows.select("id", F.size("h").alias("spans"), F.get("h", F.lit(0))["at"].alias("first"), F.get("h", F.lit(0))["length"].alias("length"))


@query("spaced_offsets", f"""WITH {DOCS}, h AS (SELECT doc_id, regexp_extract_all(lower(text), 'o\\s*f\\s*t\\s*h\\s*e') AS hits, lower(text) AS x FROM docs WHERE NOT contains(norm_text, 'ofthe'))
SELECT doc_id, CAST(len(hits) AS INTEGER) AS n, CAST(strpos(x, hits[1]) - 1 AS INTEGER) AS first, CAST(length(hits[1]) AS INTEGER) AS length FROM h WHERE len(hits) > 0""")  # fmt: skip
def spaced_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", t.spaced_offsets(F.col("text"), ["ofthe"]).alias("h")).filter(F.size("h") > 0)
    return rows.select("doc_id", F.size("h").alias("n"), F.col("h")[0]["at"].alias("first"), F.col("h")[0]["length"].alias("length"))


@query("fingerprints", "SELECT event_id, sha256(event_type || chr(0) || props) AS fingerprint FROM events")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", t.fingerprint(F.col("event_type"), F.col("props")).alias("fingerprint"))


@query("allowed_urls", "SELECT page_id, starts_with(u, 'https://') AND regexp_matches(u, '^https://[^/]*\\.example\\.org/.') AND page_id % 3 = 0 AS allowed FROM (SELECT page_id, replace(url, 'http://', 'https://') AS u FROM pages)")
def allowed_urls(spark: SparkSession, d: str) -> DataFrame:
    """Every third page's host is asked for as it stands, the others with a user before it."""
    rows = _table(spark, d, "pages").withColumn("u", F.regexp_replace("url", "^http://", "https://"))
    rows = rows.withColumn("u", F.when(F.col("page_id") % 3 == 0, F.col("u")).otherwise(F.regexp_replace("u", "^https://", "https://user@")))
    hosts = [r.h for r in rows.select(F.call_function("try_parse_url", "url", F.lit("HOST")).alias("h")).filter("h like '%.example.org'").distinct().limit(10_000).collect()]
    return rows.select("page_id", x.allowed_url(F.col("u"), hosts or [""]).alias("allowed"))


# Collections

_FOLDER = "/parts/Brand-11/1"
query("browse", f"WITH {CATALOG} SELECT id, name FROM cat WHERE regexp_replace(path, '/[^/]*$', '') = '{_FOLDER}' AND NOT starts_with(name, '.')")(
    lambda spark, d: ls.browse(catalog(spark, d), _FOLDER).select("id", "name")
)


@query("pinned_collection", f"""WITH {ORDERS}, p AS (SELECT id AS ord, path FROM ord WHERE id % 20 = 0 UNION ALL SELECT id, path || '.gone' FROM ord WHERE id % 20 = 1)
SELECT ord, path, path IN (SELECT path FROM ord) AS present FROM p WHERE starts_with(path, '/orders/') AND ord % 3 <> 0""")  # fmt: skip
def pinned_collection(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    pins = o.filter("id % 20 = 0").select(F.col("id").alias("ord"), "path").unionByName(o.filter("id % 20 = 1").select(F.col("id").alias("ord"), F.concat("path", F.lit(".gone")).alias("path")))
    return ls.pinned(pins, o, ["/orders"]).filter("ord % 3 <> 0")


@query("catalog_summary", f"""WITH {CATALOG}, b AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM cat WHERE id % 7 = 0)
SELECT (SELECT count(*) FROM cat) AS items, (SELECT count(*) FROM b) AS unreadable, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM b ORDER BY path LIMIT 10)) AS first_unreadable""")  # fmt: skip
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    out = ls.summary(cat, cat.filter("id % 7 = 0").select(t.parent_of(F.col("path")).alias("path")))
    return out.withColumn("first_unreadable", F.array_join("first_unreadable", ","))


_CLOUD = "/home/u/Library/Mobile Documents/com~apple~CloudDocs"
_PLACED = f"CASE WHEN id % 30 = 0 THEN '{_CLOUD}' WHEN id % 3 = 0 THEN '{_CLOUD}/p' || id % 7 WHEN id % 30 = 1 THEN '/home/u' WHEN id % 3 = 1 THEN '/home/u/docs/' || id % 5 ELSE '/srv/' || id % 5 END || '/n' || id || '.txt'"


@query("cloud_places", f"""WITH {ORDERS} SELECT {_PLACED} AS path, CASE WHEN id % 30 = 0 THEN 'iCloud' WHEN id % 3 = 0 THEN 'iCloud/p' || id % 7 WHEN id % 30 = 1 THEN '~' WHEN id % 3 = 1 THEN '~/docs/' || id % 5 ELSE '/srv/' || id % 5 END AS place FROM ord""")
def cloud_places(spark: SparkSession, d: str) -> DataFrame:
    return ls.places(s.with_folded(orders(spark, d).select(F.expr(_PLACED).alias("path"))), "/home/u")


@query("assembled_results", f"WITH {ORDERS} SELECT id, CASE WHEN id = 1 THEN 3 WHEN id % 5 = 0 THEN 2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS list FROM ord WHERE id % 2 = 0 OR id % 3 = 0 OR id % 5 = 0 OR id = 1")
def assembled_results(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("path", "id")
    lists = [o.filter(f"id % {k} = 0").withColumn("list", F.lit(n)) for n, k in enumerate((2, 3, 5))]
    rows = ls.assembled(*lists)
    return ls.with_targets(rows, o.withColumn("list", F.lit(3)), ["/orders/1.pdf", "/orders/none.pdf"], ["/orders"]).select("id", "list")


_SAVED = ls.SavedSearch("mine", "pdf 7", False, "/orders", date=4, start="1995-01-01", end="1996-12-31", size=3, precision="fuzzy")


@query("saved_search", f"""WITH {_NAMED} SELECT id, score FROM (SELECT *, CAST({_score_sql(["7"], "fuzzy")} AS INTEGER) AS score FROM nam)
WHERE score IS NOT NULL AND NOT is_dir AND size > 100000000 AND modified >= TIMESTAMP '1995-01-01' AND modified < TIMESTAMP '1997-01-01'""")  # fmt: skip
def saved_search(spark: SparkSession, d: str) -> DataFrame:
    saved = ls.restore(ls.capture(_SAVED))
    return ls.run_saved(_ordered(spark, d), saved, AS_OF, limit=None).select("id", "score")


# Renames and moves

_STEPS = "SELECT id, path AS original, '/orders/moved-' || id || '.pdf' AS target, '/orders/.sifter-rename-' || sha256(path) AS temporary FROM ord WHERE id % 4 = 0"


@query("rename_phases", f"WITH {ORDERS}, p AS ({_STEPS}) SELECT 1 AS phase, original AS source, temporary AS destination FROM p UNION ALL SELECT 2, temporary, target FROM p")
def rename_phases(spark: SparkSession, d: str) -> DataFrame:
    plan = orders(spark, d).filter("id % 4 = 0").select(F.col("id").alias("ord"), F.col("path").alias("original"), F.concat(F.lit("/orders/moved-"), "id", F.lit(".pdf")).alias("target"))
    return ls.phases(plan).select("phase", "source", "destination")


_VIOLATING = """p AS (SELECT path AS original, CASE id % 5 WHEN 0 THEN '/orders/a:' || id WHEN 1 THEN '/orders/X' || id // 20 ELSE '/orders/' || (id + 1) || '.pdf' END AS target FROM ord WHERE id % 5 < 3
UNION ALL SELECT path || '/inner', '/orders/in' || id FROM ord WHERE id % 10 = 0)"""


@query("rename_problems", f"""WITH {ORDERS}, {_VIOLATING}, k AS (SELECT *, count(*) OVER (PARTITION BY lower(target)) AS n FROM p)
SELECT original, 'name' AS problem FROM p WHERE contains(target, ':') UNION SELECT original, 'collision' FROM k WHERE n > 1
UNION SELECT original, 'exists' FROM p WHERE target IN (SELECT path FROM ord) AND target NOT IN (SELECT original FROM p)
UNION SELECT original, 'nested' FROM p WHERE ends_with(original, '/inner')""")  # fmt: skip
def rename_problems(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    target = F.when(F.col("id") % 5 == 0, F.concat(F.lit("/orders/a:"), "id")).when(F.col("id") % 5 == 1, F.concat(F.lit("/orders/X"), F.floor(F.col("id") / 20)))
    target = target.otherwise(F.concat(F.lit("/orders/"), F.col("id") + 1, F.lit(".pdf")))
    plan = o.filter("id % 5 < 3").select(F.col("path").alias("original"), target.alias("target"))
    inner = o.filter("id % 10 = 0").select(F.concat("path", F.lit("/inner")).alias("original"), F.concat(F.lit("/orders/in"), "id").alias("target"))
    return fl.rename_violations(plan.unionByName(inner), o.select("path"))


@query("rename_recovery", f"""WITH {ORDERS} SELECT path AS original, CASE id % 4 WHEN 0 THEN '/tmp/' || id WHEN 1 THEN path WHEN 2 THEN '/new/' || id END AS found FROM ord WHERE id % 2 = 0 OR id % 3 = 0""")
def rename_recovery(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the files each are at the temporary place, the old one, the target, and nowhere."""
    o = orders(spark, d)
    name = lambda folder: F.concat(F.lit(folder), F.col("id"))
    journal = o.filter("id % 2 = 0 or id % 3 = 0").select(F.col("path").alias("original"), name("/tmp/").alias("temporary"), name("/new/").alias("target"), F.col("id").alias("identity"))
    at = F.when(F.col("id") % 4 == 0, name("/tmp/")).when(F.col("id") % 4 == 1, F.col("path")).when(F.col("id") % 4 == 2, name("/new/"))
    return x.recovery(journal, o.filter("id % 4 < 3").select(at.alias("path"), F.col("id").alias("identity")))


@query("moved_files", f"WITH {ORDERS} SELECT path AS old_path, '/elsewhere/' || id AS path FROM ord WHERE id % 3 = 0")
def moved_files(spark: SparkSession, d: str) -> DataFrame:
    old = orders(spark, d).withColumn("identity", F.col("id"))
    return fl.moved(old, old.withColumn("path", F.when(F.col("id") % 3 == 0, F.concat(F.lit("/elsewhere/"), "id")).otherwise(F.col("path"))))


@query("incremental_catalog", f"""WITH {DOCS} SELECT path, size FROM docs WHERE doc_id % 9 NOT IN (0, 5) UNION ALL SELECT path, size + 1 FROM docs WHERE doc_id % 18 = 0 UNION ALL SELECT path || '/part', 1 FROM docs WHERE doc_id % 9 = 5""")
def incremental_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Of every nine documents one changes or goes, and one becomes a folder with a part."""
    docs = documents(spark, d).select("doc_id", "path", "size")
    present = docs.filter("doc_id % 18 = 0").select("path", (F.col("size") + 1).alias("size"))
    present = present.unionByName(docs.filter("doc_id % 9 = 5").select(F.concat("path", F.lit("/part")).alias("path"), F.lit(1).cast("long").alias("size")))
    return fl.apply_changes(docs.select("path", "size"), docs.filter("doc_id % 9 in (0, 5)").select("path"), present)


@query("current_records", f"WITH {ORDERS} SELECT path FROM ord WHERE id % 4 IN (0, 3)")
def current_records(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    size = F.when(F.col("id") % 4 == 1, F.col("size") + 1).otherwise(F.col("size"))
    modified = F.when(F.col("id") % 4 == 2, F.col("modified") + F.expr("interval 1 second")).otherwise(F.col("modified"))
    return records.current(o.select("path", "size", "modified"), o.select("path", size.alias("size"), modified.alias("modified"))).select("path")


# Jobs


@query("job_queue", f"""WITH {ORDERS} SELECT CASE WHEN id % 5 = 1 THEN '/elsewhere/' || id ELSE path END AS path, CASE WHEN id % 5 IN (0, 1) THEN 'done' ELSE 'waiting' END AS state,
  CASE id % 5 WHEN 0 THEN 'cached' WHEN 1 THEN 'followed' ELSE '' END AS note, CASE WHEN id % 5 = 1 THEN path END AS follows FROM ord""")  # fmt: skip
def job_queue(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d)


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Records of two in five orders, of which one has moved; one more is of another size, and one has no spans."""
    o = orders(spark, d).withColumn("identity", F.col("id"))
    kept = o.filter("id % 5 < 4").withColumn("spans", F.when(F.col("id") % 5 != 3, F.lit("[]"))).withColumn("size", F.when(F.col("id") % 5 == 2, F.col("size") + 1).otherwise(F.col("size")))
    live = o.withColumn("path", F.when(F.col("id") % 5 == 1, F.concat(F.lit("/elsewhere/"), "id")).otherwise(F.col("path")))
    return jb.enqueue(live, kept)


query("job_counts", f"WITH {ORDERS} SELECT count(*) FILTER (id % 5 > 1) AS n_waiting, 0 AS n_running, count(*) FILTER (id % 5 < 2) AS n_done, 0 AS n_failed, 0 AS n_changed, 0 AS n_cancelled FROM ord")(
    lambda spark, d: jb.counts(_jobs(spark, d))
)
query("job_filter", f"WITH {ORDERS} SELECT '/elsewhere/' || id AS path FROM ord WHERE id % 5 = 1")(lambda spark, d: jb.matching(_jobs(spark, d), "FOLLOWED").select("path"))


@query("job_states", """WITH e AS (SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('signup', 'error')),
l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM e GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS path, CASE last WHEN 'signup' THEN 'waiting' ELSE 'cancelled' END AS state FROM l
WHERE user_id IN (SELECT user_id FROM e WHERE event_type = 'signup')""")  # fmt: skip
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups queue a user's job, errors cancel it."""
    event = F.when(F.col("event_type") == "signup", "queue").when(F.col("event_type") == "error", "cancel")
    rows = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("at"), event.alias("event"))
    return jb.states(rows.filter("event is not null")).filter("state is not null")


# Captures

_TYPES = "CASE CAST(n_chars % 9 AS INT) WHEN 0 THEN 'org.x.ConcealedType' WHEN 1 THEN 'com.agilebits.OnePassword' WHEN 2 THEN 'a.SENSITIVE' WHEN 3 THEN 'my-marker' ELSE 'public.text' END"


@query("captures", "SELECT doc_id FROM documents WHERE n_chars % 9 > 3 AND lang <> 'de' AND n_chars % 7 <> 0 AND octet_length(encode(text)) <= 5000")
def captures(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select(
        "doc_id", "text", F.lit(None).cast("array<string>").alias("files"), F.col("lang").alias("source_id"), F.array(F.lit("public.data"), F.expr(_TYPES)).alias("types"),
        (F.col("n_chars") % 7 != 0).alias("enabled"), F.lit(False).alias("paused"),
    )
    return cb.acceptable(rows, ["de"], "My-Marker", cb.Limits(text_bytes=5000)).select("doc_id")


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Text, files or an image by turns; every fifth has text besides."""
    k = F.col("doc_id") % 3
    files = F.array(F.concat(F.lit("/f/"), "doc_id", F.lit(".txt")), F.concat(F.lit("/g/"), "lang"))
    image = lambda c: F.when(k == 2, c.cast("long"))
    return _table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("source_id"), F.when((k == 0) | (F.col("doc_id") % 5 == 0), F.col("text")).alias("text"), F.when(k == 1, files).alias("files"),
        image(F.col("n_chars")).alias("image_bytes"), image(F.col("n_chars") % 9000).alias("image_width"), image(F.col("n_chars") % 4000 + 1).alias("image_height"),
    )


_CLIPS = """clips AS (SELECT doc_id, source, lang, n_chars, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN text END AS text, doc_id % 3 AS k FROM documents)"""


@query("valid_captures", f"""WITH {_CLIPS} SELECT doc_id, coalesce(CASE WHEN k = 0 THEN octet_length(encode(text)) <= 200000 WHEN doc_id % 5 = 0 THEN false WHEN k = 1 THEN true
  ELSE n_chars BETWEEN 1 AND 4000000 AND n_chars % 9000 BETWEEN 1 AND 8192 AND (n_chars % 9000) * (n_chars % 4000 + 1) <= 24000000 END, false) AS ok FROM clips""")  # fmt: skip
def valid_captures(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).select("doc_id", F.coalesce(cb.valid(), F.lit(False)).alias("ok"))


@query("capture_titles", f"""WITH {_CLIPS} SELECT doc_id, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'files' ELSE 'image' END AS kind,
  CASE k WHEN 0 THEN substr(replace(text, chr(10), '  '), 1, 110) WHEN 1 THEN doc_id || '.txt and 1 more' ELSE 'image of ' || n_chars || ' bytes' END AS title,
  CAST(CASE k WHEN 0 THEN octet_length(encode(text)) WHEN 1 THEN 7 + length(CAST(doc_id AS VARCHAR)) + 3 + length(lang) ELSE n_chars END AS BIGINT) AS bytes FROM clips WHERE k > 0 OR text IS NOT NULL""")  # fmt: skip
def capture_titles(spark: SparkSession, d: str) -> DataFrame:
    return cb.prioritised(_clips(spark, d)).filter("kind is not null").select("doc_id", "kind", cb.title().alias("title"), cb.payload_bytes().alias("bytes"))


@query("capture_filter", f"""WITH {_CLIPS} SELECT doc_id FROM clips WHERE contains({FOLD.format("coalesce(text, '')")}, 'tion') OR k = 1 AND contains('/f/' || doc_id || '.txt', 'tion') OR contains(source, 'tion')""")
def capture_filter(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).filter(cb.matches("TION")).select("doc_id")


@query("capture_totals", "SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_pinned, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events")
def capture_totals(spark: SparkSession, d: str) -> DataFrame:
    return cb.totals(_stored_clips(spark, d))


def _stored_clips(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("props").alias("fingerprint"), (F.col("event_type") == "purchase").alias("pinned"), F.octet_length("props").cast("long").alias("bytes")
    )


@query("history_load_problems", """WITH t AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p, sum(strlen(props)) AS b, count(DISTINCT event_id) AS i, count(DISTINCT props) AS f FROM events)
SELECT unnest(list_filter([CASE WHEN n > 200 THEN 'rows' END, CASE WHEN p > 50 THEN 'pinned' END, CASE WHEN b > 24000000 THEN 'bytes' END, CASE WHEN i < n THEN 'id' END, CASE WHEN f < n THEN 'fingerprint' END], lambda x: x IS NOT NULL)) AS problem FROM t""")  # fmt: skip
def history_load_problems(spark: SparkSession, d: str) -> DataFrame:
    return cb.load_problems(_stored_clips(spark, d))


# Learned preferences


@query("search_history", """WITH s AS (SELECT user_id AS "user", event_type AS text, epoch_us(ts) / 1000000.0 AS "at", event_id FROM events),
n AS (SELECT *, lead("at") OVER (PARTITION BY "user" ORDER BY "at") AS following FROM s), r AS (SELECT * FROM n WHERE (following IS NULL OR following - "at" >= 900) AND text <> 'click'),
l AS (SELECT "user", text AS key, max("at") AS "at" FROM r GROUP BY ALL) SELECT "user", key, "at" FROM l QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY "at" DESC, key) <= 3""")  # fmt: skip
def search_history(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("text"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"))
    return x.search_history(rows, 900.0, 3, suppressed=" CLICK ").select("user", "key", "at")


_CHOICES = '''c AS (SELECT 'k' || user_id AS key, '/p/' || event_id AS path, event_type = 'purchase' AS manual, event_id AS "at" FROM events)'''


@query("learned_choices", f'''WITH {_CHOICES}, l AS (SELECT key, max("at") AS last FROM c GROUP BY key), o AS (SELECT key FROM l ORDER BY last DESC LIMIT 1) SELECT key, arg_max(path, (manual, "at")) AS path, bool_or(manual) AS manual FROM c GROUP BY key HAVING key IN (FROM o) OR key IN (SELECT key FROM l WHERE key NOT IN (FROM o) ORDER BY key DESC LIMIT 299)''')
def learned_choices(spark: SparkSession, d: str) -> DataFrame:
    return x.learned_choices(_choices(spark, d), 300)


def _choices(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(
        F.concat(F.lit("k"), "user_id").alias("key"), F.concat(F.lit("/p/"), "event_id").alias("path"), (F.col("event_type") == "purchase").alias("manual"), F.col("event_id").alias("at")
    )


@query("rejected_paths", f'''WITH {_CHOICES} SELECT key, path FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY "at" DESC) <= 5''')
def rejected_paths(spark: SparkSession, d: str) -> DataFrame:
    return x.rejected_paths(_choices(spark, d), 5)


# Menus


@query("menu_items", "SELECT 'c' || c_custkey AS id, r_name || ' › ' || n_name || ' › ' || c_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def menu_items(spark: SparkSession, d: str) -> DataFrame:
    item = lambda p, key: F.concat(F.lit(p), key.cast("string"))
    none = F.lit(None).cast("string")
    r = _table(spark, d, "region").select(item("r", F.col("r_regionkey")).alias("id"), none.alias("parent"), F.col("r_name").alias("title"), none.alias("action"))
    n = _table(spark, d, "nation").select(item("n", F.col("n_nationkey")).alias("id"), item("r", F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("title"), none.alias("action"))
    c = _table(spark, d, "customer").select(item("c", F.col("c_custkey")).alias("id"), item("n", F.col("c_nationkey")).alias("parent"), F.col("c_name").alias("title"), F.lit("go").alias("action"))
    return x.flatten_menu(r.unionByName(n).unionByName(c).withColumn("separator", F.lit(False)))


@query("palette", f"WITH v AS (SELECT n_nationkey AS ord, n_name AS title, lower(n_name) AS norm FROM nation) SELECT ord, title, score FROM (SELECT ord, title, CAST(({fuzzy_sql('norm', 'nt')}) + ({fuzzy_sql('norm', '1')}) AS INTEGER) AS score FROM v) WHERE score IS NOT NULL")
def palette(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"), F.array().cast("array<string>").alias("forms"))
    return x.palette(rows, "nt 1").withColumn("score", F.col("score").cast("int"))


# Archives and pages

_MEMBER = "CASE CAST(page_id % 7 AS INT) WHEN 0 THEN '../up/' WHEN 1 THEN '/abs/' WHEN 2 THEN 'a/../b/' WHEN 3 THEN 'c:' WHEN 4 THEN 'ok/..x/' ELSE 'ok/' END || page_id"
query("safe_members", f"SELECT page_id, page_id % 7 > 3 AS safe FROM (SELECT page_id, {_MEMBER} AS name FROM pages)")(
    lambda spark, d: _table(spark, d, "pages").select("page_id", t.safe_member(F.expr(_MEMBER)).alias("safe"))
)


def _member_rows(spark: SparkSession, d: str, moved: Column | None = None) -> DataFrame:
    at = F.col("o_orderkey") if moved is None else moved
    return _table(spark, d, "orders").select(
        F.concat(F.lit("a"), F.col("o_custkey") % 40).alias("archive"), F.concat(F.lit("N"), F.col("o_orderkey") % 300, F.lit("/")).alias("name"), F.col("o_custkey").alias("crc"),
        (F.col("o_totalprice") * 10).cast("long").alias("size"), F.lit(0).alias("flags"), at.alias("offset"),
    )


_MEMBERS = "m AS (SELECT 'a' || o_custkey % 40 AS archive, 'n' || o_orderkey % 300 AS name, CAST(trunc(o_totalprice * 10) AS BIGINT) AS size FROM orders)"


@query("archive_totals", f"WITH {_MEMBERS}, g AS (SELECT archive, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT name) AS names FROM m GROUP BY archive) SELECT *, members < 10000 AND bytes <= 250000000 AND names = members AS acceptable FROM g")
def archive_totals(spark: SparkSession, d: str) -> DataFrame:
    return archives.totals(_member_rows(spark, d))


@query("members_still_there", "SELECT o_orderkey AS \"offset\" FROM orders WHERE o_orderkey % 3 <> 0")
def members_still_there(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return archives.still_there(_member_rows(spark, d), _member_rows(spark, d, F.when(k % 3 == 0, -k - 1).otherwise(k))).select("offset")


@query("page_evidence", f"""WITH {DOCS}, p AS (SELECT '/p/' || doc_id // 3 AS path, doc_id % 3 AS page, length(norm_text) - length(replace(norm_text, 'tion', '')) AS cut FROM docs)
SELECT path, CAST(sum(CASE WHEN page < 2 THEN cut ELSE 0 END) // 4 AS BIGINT) AS matches, max(page) >= 2 AS limited, bool_or(page < 2 AND cut > 0) AS found FROM p GROUP BY path HAVING min(page) < 2""")  # fmt: skip
def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    pages = documents(spark, d).select(F.concat(F.lit("/p/"), F.floor(F.col("doc_id") / 3)).alias("path"), (F.col("doc_id") % 3).alias("page"), "text")
    return texts.page_evidence(pages, ["tion"], 2).select("path", "matches", "limited", F.col("excerpt").isNotNull().alias("found"))


_SPAN = "struct<page:int,text:string,x:double,y:double,w:double,h:double,glyphs:array<struct<at:int,length:int,x:double,y:double,w:double,h:double>>>"


@query("text_hits", f"""WITH {DOCS} SELECT path, CAST(doc_id % 4 AS INTEGER) AS page, CAST(doc_id AS DOUBLE) AS x FROM docs WHERE contains(norm_text, 'etion')""")
def text_hits(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("doc_id").cast("double")
    span = F.struct((F.col("doc_id") % 4).cast("int").alias("page"), F.col("text"), f.alias("x"), f.alias("y"), f.alias("w"), f.alias("h"), F.array().cast("array<struct<at:int,length:int,x:double,y:double,w:double,h:double>>").alias("glyphs"))
    rows = documents(spark, d).select("doc_id", "path", "text").select("path", F.array(span.cast(_SPAN)).alias("spans"))
    return x.text_hits(rows, "ÉTION").select("path", "page", F.col("box.x").alias("x"))


@query("glyph_boxes", "SELECT l_orderkey, min(l_quantity) AS x, min(l_linenumber) AS y, max(l_quantity + 1) - min(l_quantity) AS w, max(l_linenumber * 2) - min(l_linenumber) AS h FROM lineitem GROUP BY l_orderkey")
def glyph_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.lit(1.0).alias("w"), F.col("l_linenumber").cast("double").alias("h"))
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    return rows.select("l_orderkey", t.box_union(F.col("boxes")).alias("b")).select("l_orderkey", *[F.col(f"b.{c}").alias(c) if c in "xw" else F.col(f"b.{c}").cast("int").alias(c) for c in "xywh"])


@query("rotated_boxes", """SELECT l_orderkey, l_linenumber, CASE turn WHEN 0 THEN a WHEN 90 THEN 0.25 WHEN 180 THEN 1 - a - 0.125 ELSE 1 - 0.25 - 0.5 END AS x,
  CASE turn WHEN 0 THEN 0.25 WHEN 90 THEN 1 - a - 0.125 WHEN 180 THEN 1 - 0.25 - 0.5 ELSE a END AS y FROM (SELECT l_orderkey, l_linenumber, l_linenumber / 16.0::DOUBLE AS a, l_partkey % 4 * 90 AS turn FROM lineitem)""")  # fmt: skip
def rotated_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct((F.col("l_linenumber") / 16.0).alias("x"), F.lit(0.25).alias("y"), F.lit(0.125).alias("w"), F.lit(0.5).alias("h"))
    out = t.rotated_box(box, F.col("l_partkey") % 4 * 90)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", out["x"].alias("x"), out["y"].alias("y"))


@query("valid_manifests", "SELECT p_partkey, p_partkey % 4 <> 1 AND p_size > 10 AND p_partkey % 6 <> 5 AS ok FROM part")
def valid_manifests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _table(spark, d, "part").select(
        "p_partkey", F.when(k % 4 == 1, "1.x").otherwise("1.2.3").alias("version"), F.greatest(F.col("p_size") - 10, F.lit(0)).alias("build"), F.array("p_name").alias("notes"),
        F.sha2("p_name", 256).alias("digest"), F.lit(5).alias("bytes"), F.when(k % 6 == 5, "http://h.example/x").otherwise("https://h.example/x").alias("url"),
    )
    return rows.select("p_partkey", x.valid_manifest(["h.example"]).alias("ok"))


@query("valid_sources", "SELECT user_id, CASE WHEN NOT bool_or(event_type = 'error') THEN string_agg(DISTINCT 'app.' || event_type, ',' ORDER BY 'app.' || event_type) END AS sources FROM events GROUP BY user_id")
def valid_sources(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", "no dot").otherwise(F.concat(F.lit(" App."), F.upper("event_type")))
    rows = _table(spark, d, "events").groupBy("user_id").agg(F.collect_set(name).alias("ids"))
    return rows.select("user_id", F.array_join(x.valid_sources(F.col("ids")), ",").alias("sources"))


