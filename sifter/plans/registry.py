"""The registered queries of the search engine and their DuckDB equivalents.

Catalog names come from `part` (/parts/<brand>/<name>.<type>), dated and sized rows from
`orders`, usage and histories from `events`, texts from `documents`, tags from `labels` and URL
paths from `pages`. Each entry is a function and, where SQL can express it, its SQL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions import text as t
from sifter.operators import files as fl
from sifter.operators import listings as ls
from sifter.operators import search as s
from sifter.operators.phrases import phrase_hits
from sifter.operators.query import parse
from sifter.sources.stored import placed, stored

AS_OF = dt.datetime(2024, 1, 31)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# DuckDB counterparts of the adapters and of folding.
FOLD = f"translate(lower({{}}), '{t.ACCENTED}', '{t.PLAIN}')"
CATALOG = f"""cat AS (SELECT *, regexp_replace(norm_name, '(.)\\.[^.]+$', '\\1') AS norm_stem, regexp_replace(norm_path, '/[^/]*$', '') AS norm_parent
  FROM (SELECT p_partkey AS id, path, regexp_extract(path, '[^/]*$') AS name, {FOLD.format("path")} AS norm_path, {FOLD.format("regexp_extract(path, '[^/]*$')")} AS norm_name
  FROM (SELECT p_partkey, '/parts/' || replace(p_brand, '#', '-') || '/' || p_partkey % 10 || '/' || p_name || '.' || lower(p_type) AS path FROM part)))"""
ORDERS = """ord AS (SELECT o_orderkey AS id, '/orders/' || o_orderkey || '.pdf' AS path, CAST(o_totalprice * 1000 AS BIGINT) AS size,
  o_orderdate AS modified, o_orderkey % 50 = 0 AS is_dir FROM orders)"""
DOCS = f"""docs AS (SELECT doc_id, '/corpus/' || source || '/' || lang || '/doc-' || doc_id || '.txt' AS path, text, {FOLD.format("text")} AS norm_text,
  CAST(strlen(text) AS BIGINT) AS size FROM documents)"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """The folded catalog, written once, so that filters on its columns reach the scan."""
    return stored(spark, f"{d} catalog", lambda: _catalog(spark, d))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(
        F.lit("/parts/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), (F.col("p_partkey") % 10).cast("string"),
        F.lit("/"), F.col("p_name"), F.lit("."), F.lower("p_type"),
    )
    rows = _table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), path.alias("path"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("timestamp_ntz").alias("modified"),
    )
    return s.with_folded(rows)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, f"{d} orders", lambda: _orders(spark, d))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("/orders/"), F.col("o_orderkey"), F.lit(".pdf")).alias("path"),
        F.round(F.col("o_totalprice") * 1000).cast("long").alias("size"),
        F.col("o_orderdate").alias("modified"),
        (F.col("o_orderkey") % 50 == 0).alias("is_dir"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, f"{d} documents", lambda: _documents(spark, d))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id"), F.lit(".txt"))
    return _table(spark, d, "documents").select(
        "doc_id", path.alias("path"), "text", t.fold(F.col("text")).alias("norm_text"), F.octet_length("text").cast("long").alias("size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )


def opens(spark: SparkSession, d: str) -> DataFrame:
    """Views per part: user_id stands for the part's key."""
    views = _table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("id"), "ts")
    return views.join(catalog(spark, d).select("id", "path"), "id").select("path", "ts")


OPENS = CATALOG + ", opens AS (SELECT path, ts FROM events JOIN cat ON user_id = id WHERE event_type = 'view')"


# Content


def _content(text: str, columns: tuple[str, ...] = ("doc_id", "size")):
    return lambda spark, d: documents(spark, d).filter(s.content_filter(parse(text), F.col("norm_text"))).select(*columns)


def _content_sql(where: str) -> str:
    return f"WITH {DOCS} SELECT doc_id, size FROM docs WHERE {where}"


def loose(word: str) -> str:
    return f"(contains(norm_text, '{word}') OR contains(regexp_replace(norm_text, '\\s+', '', 'g'), '{word}'))"


query("content_search", _content_sql("contains(norm_text, 'the of') AND NOT " + loose("token")))(_content('"the of" -token'))
query("content_words", _content_sql(loose("tion") + " AND " + loose("ement")))(_content("tion ement"))
query("content_exclude", _content_sql(loose("the") + " AND NOT contains(norm_text, 'of the') AND NOT " + loose("was")))(_content('the -"of the" -was'))
query("content_whitespace_tolerant", _content_sql(loose("ofthe")))(_content("ofthe"))
query("content_accents", _content_sql(loose("etion")))(_content("ÉTION"))


@query(
    "content_phrase_batch",
    f"""WITH {DOCS}, b AS (SELECT item_id, {FOLD.format("text")} AS phrase FROM benchmark WHERE text <> '')
SELECT item_id, doc_id FROM b JOIN docs ON contains(norm_text, phrase)""",
)
def content_phrase_batch(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of benchmark as phrases."""
    phrases = _table(spark, d, "benchmark").select("item_id", t.fold(F.col("text")).alias("phrase"))
    return phrase_hits(documents(spark, d).select("doc_id", "norm_text"), phrases, "doc_id", "item_id")


@query("excerpt", f"""WITH {DOCS}, h AS (SELECT *, strpos(norm_text, 'the ') AS pos FROM docs)
SELECT doc_id, CASE WHEN pos > 46 THEN '…' ELSE '' END || translate(substr(text, greatest(pos - 45, 1), least(pos + 100, length(text) + 1) - greatest(pos - 45, 1)), chr(13) || chr(10), '  ')
  || CASE WHEN pos + 100 <= length(text) THEN '…' ELSE '' END AS excerpt FROM h WHERE pos > 0""")  # fmt: skip
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).filter(F.col("norm_text").contains("the "))
    return docs.select("doc_id", t.excerpt(F.col("text"), F.col("norm_text"), ["the "]).alias("excerpt"))


@query("match_offsets", f"""WITH {DOCS}, p AS (SELECT doc_id, string_split(norm_text, 'tion') AS p FROM docs WHERE contains(norm_text, 'tion')),
i AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM p)
SELECT doc_id, CAST(list_sum([length(x) FOR x IN p[1:i]]) + 4 * (i - 1) AS INTEGER) AS at FROM i""")  # fmt: skip
def match_offsets(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).filter(F.col("norm_text").contains("tion"))
    return docs.select("doc_id", F.explode(t.match_offsets(F.col("norm_text"), ["tion"])).alias("hit")).select("doc_id", "hit.at")


# Names: filters and scores


def _cat(condition: Callable[[], Column], columns: tuple[str, ...] = ("id", "path")):
    return lambda spark, d: catalog(spark, d).filter(condition()).select(*columns)


def _cat_sql(where: str, columns: str = "id, path") -> str:
    return f"WITH {CATALOG} SELECT {columns} FROM cat WHERE {where}"


query("ext_filter", _cat_sql("ends_with(norm_name, '.promo') OR ends_with(norm_name, '.economy')"))(_cat(lambda: s.extension_filter(parse("ext:promo,ECONOMY"))))
query("ext_filter_negative", _cat_sql("NOT ends_with(norm_name, '.promo')"))(_cat(lambda: s.extension_filter(parse("-ext:promo"))))
query("scope_roots", _cat_sql("starts_with(path, '/parts/Brand-1/') OR starts_with(path, '/parts/Brand-12/') OR path = '/parts/Brand-1'"))(_cat(lambda: s.in_scope(["/parts/Brand-1", "/parts/Brand-12/"])))
query("exclusion_roots", _cat_sql("NOT starts_with(path, '/parts/Brand-11/')"))(_cat(lambda: ~s.in_scope(["/parts/Brand-11"])))
query("fold_names", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")(lambda spark, d: documents(spark, d).select("doc_id", F.col("norm_text").alias("folded")))
query("candidate_filter", _cat_sql("norm_name LIKE '%a%e%' OR norm_parent LIKE '%a%e%'"))(_cat(lambda: s.candidate_filter(parse("ae"))))

_NATURAL = "array_to_string([CASE WHEN regexp_matches(v, '^[0-9]') THEN lpad(v, greatest(20, length(v))::INTEGER, '0') ELSE v END FOR v IN regexp_extract_all(lower({0}), '([0-9]+|[^0-9]+)')], '')"


@query("natural_sort", f"WITH {CATALOG} SELECT id, row_number() OVER (ORDER BY {_NATURAL.format('path')}, path, id) AS place FROM cat")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d).select("id", "path", t.natural_key(F.col("path")).alias("key"))
    return placed(rows, [F.col("key"), F.col("path"), F.col("id")]).select("id", "place")


def fuzzy_sql(text: str, word: str) -> str:
    """S-1 in DuckDB: a recursive walk is unrolled over the word's characters."""
    at, first, score = "0", "0", "380"
    for i, c in enumerate(word):
        tail = f"strpos(substr({text}, {at} + 1), '{c}')"
        here = f"(CASE WHEN {tail} > 0 THEN {at} + {tail} END)"
        edge = f"CASE WHEN {here} = 1 OR NOT regexp_matches(substr({text}, {here} - 1, 1), '[\\pL\\pN]') THEN 28 ELSE 0 END"
        link = "0" if i == 0 else f"CASE WHEN {here} = {at} + 1 THEN 18 ELSE -least(140, 9 * ({here} - {at} - 1)) END"
        score, first, at = f"({score} + {edge} + {link})", here if i == 0 else first, here
    # greatest and least leave nulls out, so that a missing character is asked for by itself.
    walk = f"CASE WHEN {at} IS NOT NULL THEN greatest(40, {score} - least(100, 3 * ({first} - 1))) END"
    return (
        f"CASE WHEN {text} = '{word}' THEN 1000 WHEN starts_with({text}, '{word}') THEN 850 "
        f"WHEN contains({text}, '{word}') THEN 700 - least(120, 3 * (strpos({text}, '{word}') - 1)) ELSE {walk} END"
    )


@query("fuzzy_score", f"WITH {CATALOG} SELECT id, CAST({fuzzy_sql('norm_name', 'aes')} AS INTEGER) AS score FROM cat")
def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", s.fuzzy_score(F.col("norm_name"), "aes").cast("int").alias("score"))


def _score_sql(words: list[str], precision: str) -> str:
    joined = " ".join(words)
    if precision == "exact":
        total = "CAST(NULL AS INTEGER)"
    else:
        each = []
        for w in words:
            parts = [f"({fuzzy_sql('norm_name', w)}) + 200"]
            if precision == "path":
                path = fuzzy_sql("norm_parent", w)
                parts.append(f"CASE WHEN ({path}) IS NOT NULL THEN least(350, ({path}) // 2) END")
            each.append(f"coalesce({', '.join(parts)})")
        total = " + ".join(each)
    return f"CASE WHEN norm_name = '{joined}' OR norm_stem = '{joined}' THEN {2000 * len(words)} ELSE {total} END"


def _scored(words: str, precision: str):
    return lambda spark, d: catalog(spark, d).select("id", s.query_score(parse(words), precision).cast("int").alias("score")).filter("score is not null")


def _scored_sql(words: list[str], precision: str) -> str:
    return f"WITH {CATALOG} SELECT * FROM (SELECT id, CAST({_score_sql(words, precision)} AS INTEGER) AS score FROM cat) WHERE score IS NOT NULL"


query("precision_fuzzy", _scored_sql(["re", "al"], "fuzzy"))(_scored("re al", "fuzzy"))
query("precision_path", _scored_sql(["brand", "re"], "path"))(_scored("brand re", "path"))
query(
    "phrase_bonus",
    f"""WITH {CATALOG} SELECT id, CAST(({_score_sql(["e"], "path")}) + CASE WHEN norm_name = 'red' OR norm_stem = 'red' THEN 2000 WHEN contains(norm_name, 'red') THEN 1000 ELSE 400 END AS INTEGER) AS score
FROM cat WHERE contains(norm_path, 'red') AND ({_score_sql(["e"], "path")}) IS NOT NULL""",
)(_scored('e "red"', "path"))


@query("match_reasons", f"""WITH {CATALOG} SELECT id, CASE WHEN ({fuzzy_sql('norm_name', 'ae')}) IS NOT NULL THEN CASE WHEN contains(norm_name, 'ae') THEN 'name' ELSE 'initials' END
  WHEN ({fuzzy_sql('norm_parent', 'ae')}) IS NOT NULL THEN 'path' ELSE '' END AS reasons FROM cat""")  # fmt: skip
def match_reasons(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", F.array_join(s.reasons(["ae"]), ",").alias("reasons"))


# Ranking


def _ranked(text: str, precision: str, with_opens: bool, with_rejected: bool, n: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        cat = catalog(spark, d)
        prefs = s.Preferences(
            opens=fl.usage(opens(spark, d), None) if with_opens else None,
            rejected=cat.filter("id % 7 = 0").select("path") if with_rejected else None,
        )
        rows = s.search(cat, text, precision=precision, as_of=AS_OF, prefs=prefs, limit=None)
        return rows.orderBy(*s.relevance_order(), "id").limit(n).select("id", "score", "opens", "demoted")

    return run


def _ranked_sql(words: list[str], precision: str, with_opens: bool, with_rejected: bool, n: int) -> str:
    opened = "LEFT JOIN (SELECT path, count(*) AS n FROM opens GROUP BY path) USING (path)" if with_opens else ""
    return f"""WITH {OPENS}, r AS (SELECT id, path, CAST({_score_sql(words, precision)} AS INTEGER) AS score,
  CAST({"least(20, coalesce(n, 0))" if with_opens else "0"} AS INTEGER) AS opens,
  {"CAST(path IN (SELECT path FROM cat WHERE id % 7 = 0) AS INTEGER)" if with_rejected else "0"} AS demoted FROM cat {opened})
SELECT id, score, opens, demoted FROM r WHERE score IS NOT NULL ORDER BY demoted, score DESC, opens DESC, {_NATURAL.format("path")}, path, id LIMIT {n}"""


query("rank_full", _ranked_sql(["re", "al"], "path", True, True, 2000))(_ranked("re al", "path", True, True, 2000))
query("rank_usage", _ranked_sql(["re"], "fuzzy", True, False, 2000))(_ranked("re", "fuzzy", True, False, 2000))
query("rank_feedback", _ranked_sql(["re"], "fuzzy", False, True, 2000))(_ranked("re", "fuzzy", False, True, 2000))


@query("near_names", f"""WITH {CATALOG}, st AS (SELECT DISTINCT norm_stem FROM cat WHERE length(norm_stem) <= 64), t AS (SELECT min(norm_stem) || 'x' AS t FROM cat)
SELECT norm_stem, CAST(levenshtein(norm_stem, t) AS INTEGER) AS distance FROM st, t WHERE levenshtein(norm_stem, t) BETWEEN 1 AND 2 ORDER BY distance, norm_stem LIMIT 5""")  # fmt: skip
def near_names(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    return s.near_names(cat, (cat.agg(F.min("norm_stem")).first()[0] or "") + "x")


@query("compact_location", f"""WITH {CATALOG}, p AS (SELECT DISTINCT path, norm_name, [x FOR x IN string_split(regexp_replace(path, '/[^/]*$', ''), '/') IF x <> ''] AS p FROM cat),
e AS (SELECT path, norm_name, depth, array_to_string(p[len(p) - depth + 1:], '/') AS tail FROM (SELECT *, unnest(range(1, len(p) + 1)) AS depth FROM p)),
n AS (SELECT *, count(*) OVER (PARTITION BY norm_name, depth, tail) AS n FROM e),
b AS (SELECT path, min(depth) AS depth FROM n WHERE n = 1 GROUP BY path)
SELECT p.path, CASE WHEN count(*) OVER (PARTITION BY p.norm_name) > 1 AND e.tail IS NOT NULL THEN e.tail ELSE '/' || array_to_string(p.p, '/') END AS place
FROM p LEFT JOIN b USING (path) LEFT JOIN e ON e.path = p.path AND e.depth = b.depth""")  # fmt: skip
def compact_location(spark: SparkSession, d: str) -> DataFrame:
    return s.compact_location(catalog(spark, d).dropDuplicates(["path"]))


# Dates, sizes, tags, orders


def _ord(condition: Callable[[], Column]):
    return lambda spark, d: orders(spark, d).filter(condition()).select("id", "size", "modified")


def _ord_sql(where: str) -> str:
    return f"WITH {ORDERS} SELECT id, size, modified FROM ord WHERE {where}"


_LATE = dt.datetime(1998, 8, 2, 15)
query("date_last7", _ord_sql("modified >= TIMESTAMP '1998-07-27' AND modified < TIMESTAMP '1998-08-03'"))(_ord(lambda: s.natural_filter(parse("最近7天"), _LATE)))
query("date_yesterday", _ord_sql("modified >= TIMESTAMP '1996-03-09' AND modified < TIMESTAMP '1996-03-10'"))(_ord(lambda: s.natural_filter(parse("昨天"), dt.datetime(1996, 3, 10, 9))))
query("date_custom", _ord_sql("modified >= TIMESTAMP '1995-01-01' AND modified < TIMESTAMP '1995-02-01'"))(_ord(lambda: s.between_days("modified", dt.date(1995, 1, 1), dt.date(1995, 1, 31))))
query("size_band_small", f"WITH {ORDERS} SELECT id, size // 200 AS size FROM ord WHERE NOT is_dir AND size // 200 < 1000000")(
    lambda spark, d: orders(spark, d).withColumn("size", F.floor(F.col("size") / 200)).filter(s.size_band(1)).select("id", "size")
)
query("size_bands", _ord_sql("NOT is_dir AND size BETWEEN 1000000 AND 100000000"))(_ord(lambda: s.size_band(2)))
query("size_band_large", _ord_sql("NOT is_dir AND size > 100000000"))(_ord(lambda: s.size_band(3)))
query("size_gt_strict", _ord_sql("NOT is_dir AND size > 100000000"))(_ord(lambda: s.natural_filter(parse("大于100MB"), AS_OF)))


def _sorted(mode: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = orders(spark, d).withColumn("name", t.name_of(F.col("path")))
        return placed(rows, s.sort_order(mode)).select("id", "place")

    return run


def _sorted_sql(first: str) -> str:
    return f"WITH {ORDERS} SELECT id, row_number() OVER (ORDER BY {first}{_NATURAL.format('path')}, path) AS place FROM ord"


query("sort_newest", _sorted_sql("modified DESC NULLS LAST, "))(_sorted(1))
query("sort_names", _sorted_sql(""))(_sorted(2))
query("sort_modes", _sorted_sql("is_dir, size DESC, "))(_sorted(3))


@query("recent_files", f"WITH {ORDERS} SELECT id, modified FROM ord WHERE NOT is_dir AND modified >= TIMESTAMP '1998-06-03' ORDER BY modified DESC, path LIMIT 80")
def recent_files(spark: SparkSession, d: str) -> DataFrame:
    return ls.recent(orders(spark, d), dt.datetime(1998, 6, 3)).select("id", "modified")


@query("tag_filter", f"""WITH {DOCS}, l AS (SELECT doc_id, bool_or(quality = 1) AS good FROM labels GROUP BY doc_id) SELECT doc_id, path FROM docs JOIN l USING (doc_id) WHERE good""")
def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_distinct(F.flatten(F.collect_list(F.array(F.when(F.col("quality") == 1, "Good").otherwise("bad")))))
    tags = _table(spark, d, "labels").groupBy("doc_id").agg(names.alias("tags"))
    return documents(spark, d).select("doc_id", "path").join(tags, "doc_id").filter(s.tag_filter("GOOD")).select("doc_id", "path")


# Duplicates

_DUP = f"""{DOCS}, m AS (SELECT path, size, sha256(text) AS digest, doc_id // 3 AS identity FROM docs), g AS (SELECT size, digest FROM m GROUP BY ALL HAVING count(*) > 1)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Three documents in a row with one text stand for one physical file."""
    return fl.repeated(documents(spark, d).select("path", "size", "digest", (F.col("doc_id") / 3).cast("long").cast("string").alias("identity")))


@query("dedup_candidates", f"WITH {DOCS} SELECT path, size FROM docs WHERE size IN (SELECT size FROM docs GROUP BY size HAVING count(*) > 1)")
def dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    return fl.duplicate_candidates(documents(spark, d).select("path", "size")).select("path", "size")


@query("duplicate_groups", f"WITH {_DUP} SELECT digest, size, count(*) AS paths, count(DISTINCT identity) AS files, min(path) AS first_path, (count(DISTINCT identity) - 1) * size AS extra_bytes FROM m JOIN g USING (size, digest) GROUP BY digest, size")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return fl.duplicate_groups(_members(spark, d))


@query("duplicate_summary", f"WITH {_DUP}, x AS (SELECT (count(DISTINCT identity) - 1) * any_value(size) AS extra FROM m JOIN g USING (size, digest) GROUP BY digest, size) SELECT count(*) AS n_groups, CAST(coalesce(sum(extra), 0) AS BIGINT) AS extra_bytes FROM x")
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    return fl.duplicate_groups(_members(spark, d)).agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("extra_bytes"), F.lit(0)).alias("extra_bytes"))


@query("duplicate_filter_group", f"WITH {_DUP}, x AS (SELECT path, size, digest FROM m JOIN g USING (size, digest)) SELECT path, digest FROM x WHERE (digest, size) IN (SELECT (digest, size) FROM x WHERE contains(path, '/en/'))")
def duplicate_filter_group(spark: SparkSession, d: str) -> DataFrame:
    return fl.duplicate_filter(_members(spark, d), "/EN/").select("path", "digest")


# Usage and histories

_CLIP = "clip AS (SELECT event_id AS id, sha256(event_type || chr(0) || CAST(props AS VARCHAR)) AS fingerprint, ts AS created, event_type = 'purchase' AS pinned, CAST(strlen(props) AS BIGINT) AS bytes, user_id FROM events)"


def history(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.sha2(F.concat_ws("\0", "event_type", "props"), 256).alias("fingerprint"), F.col("ts").alias("created"),
        (F.col("event_type") == "purchase").alias("pinned"), F.octet_length("props").cast("long").alias("bytes"), "user_id",
    )


@query("usage_topn", f"WITH {OPENS} SELECT path, count(*) AS n, max(ts) AS last FROM opens GROUP BY path ORDER BY n DESC, path LIMIT 1000")
def usage_topn(spark: SparkSession, d: str) -> DataFrame:
    return fl.usage(opens(spark, d), 1000)


@query("opened_collection", f"WITH {OPENS} SELECT path, max(ts) AS last FROM opens WHERE starts_with(path, '/parts/Brand-1') GROUP BY path ORDER BY last DESC, path LIMIT 300")
def opened_collection(spark: SparkSession, d: str) -> DataFrame:
    brands = [r.b for r in catalog(spark, d).select(F.regexp_extract("path", "^(/parts/[^/]+)", 1).alias("b")).distinct().collect()]  # two dozen
    return ls.opened(opens(spark, d), [b for b in brands if b.startswith("/parts/Brand-1")], 300)


@query("clipboard_upsert", f"WITH {_CLIP} SELECT fingerprint, arg_min(id, (created, id)) AS id, max(created) AS created, bool_or(pinned) AS pinned, max(bytes) AS bytes FROM clip GROUP BY fingerprint")
def clipboard_upsert(spark: SparkSession, d: str) -> DataFrame:
    return fl.merge_history(history(spark, d))


_KEPT = """SELECT user_id, fingerprint FROM (SELECT *, row_number() OVER w AS place, sum(bytes) OVER w AS held FROM u WHERE pinned OR created >= TIMESTAMP '{0}'
  WINDOW w AS (PARTITION BY user_id ORDER BY pinned DESC, created DESC, fingerprint)) WHERE pinned OR place <= {1} AND held <= {2}"""
_USER = f"WITH {_CLIP}, u AS (SELECT user_id, sha256(fingerprint || user_id) AS fingerprint, max(created) AS created, bool_or(pinned) AS pinned, max(bytes) AS bytes FROM clip GROUP BY ALL) "


def _per_user(spark: SparkSession, d: str) -> DataFrame:
    rows = history(spark, d).withColumn("fingerprint", F.sha2(F.concat("fingerprint", F.col("user_id").cast("string")), 256))
    return rows.groupBy("user_id", "fingerprint").agg(F.max("created").alias("created"), F.bool_or("pinned").alias("pinned"), F.max("bytes").alias("bytes"))


query("clipboard_retention", f"WITH {_CLIP}, u AS (SELECT user_id, sha256(fingerprint || user_id) AS fingerprint, max(created) AS created, bool_or(pinned) AS pinned, max(bytes) AS bytes FROM clip GROUP BY user_id, fingerprint) " + _KEPT.format("2024-01-24", 20, 24_000_000))(
    lambda spark, d: fl.retained(_per_user(spark, d), AS_OF, 7, 20, per="user_id").select("user_id", "fingerprint")
)
query("clipboard_bytes_cap", f"WITH {_CLIP}, u AS (SELECT user_id, sha256(fingerprint || user_id) AS fingerprint, max(created) AS created, bool_or(pinned) AS pinned, max(bytes) AS bytes FROM clip GROUP BY user_id, fingerprint) " + _KEPT.format("2024-01-01", 200, 400))(
    lambda spark, d: fl.retained(_per_user(spark, d), AS_OF, 30, 200, 400, per="user_id").select("user_id", "fingerprint")
)


@query("double_tap", """WITH k AS (SELECT user_id, epoch_us(ts) / 3600000000.0 AS time, event_id % 2 = 0 AS press, event_type = 'error' AS other, event_id FROM events),
l AS (SELECT *, lag(press, 1) OVER w AS p1, lag(press, 2) OVER w AS p2, lag(press, 3) OVER w AS p3, lag(other, 1) OVER w AS o1, lag(other, 2) OVER w AS o2, lag(other, 3) OVER w AS o3,
  lag(time, 1) OVER w AS t1, lag(time, 2) OVER w AS t2, lag(time, 3) OVER w AS t3 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY time))
SELECT user_id, count(*) AS taps FROM l WHERE NOT press AND p1 AND NOT p2 AND p3 AND NOT other AND NOT o1 AND NOT o2 AND NOT o3 AND time - t1 <= 24 AND t1 - t2 <= 24 AND t2 - t3 <= 24 GROUP BY user_id""")  # fmt: skip
def double_tap(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0).alias("time"), (F.col("event_id") % 2 == 0).alias("press"), (F.col("event_type") == "error").alias("other"))
    return fl.double_taps(e, "user_id", 24.0, 24.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("taps"))


# Renaming, paths, change sets, diagnosis

_PLAN = "plan AS (SELECT id AS ord, path AS original, regexp_replace(path, '/[^/]*$', '') || '/n-' || replace(regexp_replace(name, '(.)\\.[^.]+$', '\\1'), 'red', 'RED') || '-' || lpad(CAST(id + 6 AS VARCHAR), greatest(3, length(CAST(id + 6 AS VARCHAR)))::INTEGER, '0') || regexp_extract(name, '\\.[^.]+$') AS target FROM cat)"
_RULE = fl.Rename(prefix="n-", find="red", replace="RED", numbered=True, start=7, digits=3)


def _plan(spark: SparkSession, d: str, rule: fl.Rename) -> DataFrame:
    return fl.rename_plan(catalog(spark, d).select(F.col("id").alias("ord"), "path", "is_dir"), rule)


query("rename_plan", f"WITH {CATALOG}, {_PLAN} SELECT ord, original, target FROM plan WHERE original <> target")(lambda spark, d: _plan(spark, d, _RULE))


@query("path_ancestors", f"WITH {DOCS}, p AS (SELECT DISTINCT source, lang FROM documents) SELECT above, count(*) AS n FROM (SELECT unnest(['/', '/corpus', '/corpus/' || source, '/corpus/' || source || '/' || lang]) AS above FROM documents) GROUP BY above")
def path_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.explode(t.ancestors(F.col("path"))).alias("above")).groupBy("above").agg(F.count(F.lit(1)).alias("n"))


def _changed(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return docs.filter("doc_id % 9 = 0").select("path").unionByName(docs.select(t.parent_of(F.col("path")).alias("path")).filter("path like '%/fr'").distinct())


_CHANGED = f"{DOCS}, ch AS (SELECT path FROM docs WHERE doc_id % 9 = 0 UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM docs WHERE path LIKE '%/fr/%')"
query("changed_minimal_cover", f"WITH {_CHANGED} SELECT path FROM ch c WHERE NOT EXISTS (FROM ch o WHERE starts_with(c.path, o.path || '/'))")(lambda spark, d: fl.minimal_cover(_changed(spark, d)))
query("subtree_delete", f"WITH {_CHANGED} SELECT doc_id, path FROM docs WHERE doc_id % 9 <> 0 AND path NOT LIKE '%/fr/%'")(
    lambda spark, d: fl.without_subtrees(documents(spark, d).select("doc_id", "path"), fl.minimal_cover(_changed(spark, d)))
)


@query("version_order", "SELECT item_id, CASE WHEN item_id % 7 < 3 OR item_id % 7 = 3 AND item_id % 11 < 4 THEN -1 WHEN item_id % 7 = 3 AND item_id % 11 = 4 THEN 0 ELSE 1 END AS cmp FROM benchmark")
def version_order(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat((F.col("item_id") % 7).cast("string"), F.lit("."), (F.col("item_id") % 11).cast("string"), F.lit(".x"))
    return _table(spark, d, "benchmark").select("item_id", t.version_order(v, F.lit("3.4")).alias("cmp"))


@query("filter_attrition", f"""WITH {CATALOG}, f AS (SELECT NOT ends_with(norm_name, '.promo') AS e, contains(norm_path, 'red') AND ({_score_sql(["e"], "path")}) IS NOT NULL AS n FROM cat)
SELECT count(*) AS n_all, count(*) AS n_type, count(*) FILTER (e) AS n_extension, count(*) FILTER (e) AS n_detail, count(*) FILTER (e AND n) AS n_name FROM f""")  # fmt: skip
def filter_attrition(spark: SparkSession, d: str) -> DataFrame:
    return fl.attrition(catalog(spark, d).withColumn("tags", F.array().cast("array<string>")), 'e "red" -ext:promo', AS_OF)


@query("miss_diagnosis", f"""WITH {CATALOG}, x AS (SELECT path, id FROM cat WHERE id % 3 <> 0), k AS (SELECT DISTINCT path, norm_name, norm_stem, norm_parent, norm_path FROM cat),
m AS (SELECT *, path IN (SELECT path FROM x) AS indexed, NOT starts_with(path, '/parts/Brand-2') AS in_scope, CASE WHEN starts_with(path, '/parts/Brand-11/') THEN '/parts/Brand-11' END AS excluded_by FROM k)
SELECT path, indexed, in_scope, excluded_by, false AS hidden, false AS skipped_dir, true AS type_ok, true AS detail_ok, indexed AND ({_score_sql(["re"], "path")}) IS NOT NULL AS name_ok,
  in_scope AND excluded_by IS NULL AND NOT indexed AS can_repair, regexp_replace(path, '/[^/]*$', '') AS repair_dir FROM m""")  # fmt: skip
def miss_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d).withColumn("tags", F.array().cast("array<string>"))
    brands = [r.b for r in cat.select(F.regexp_extract("path", "^(/parts/[^/]+)", 1).alias("b")).distinct().collect()]  # two dozen
    roots = sorted(b for b in brands if not b.startswith("/parts/Brand-2"))
    return fl.diagnose(cat.filter("id % 3 <> 0").dropDuplicates(["path"]), cat, "re", roots, ["/parts/Brand-11"], AS_OF)


from sifter.plans import more  # noqa: E402, F401  registers the rest
