"""Filters, name scores and ranking over a catalog, compiled from a parsed query.

A catalog has path, name, is_dir, size, modified, created, tags and, materialised once by
`with_folded`, the columns that queries test directly: norm_name, norm_stem, norm_parent,
norm_path and forms (phonetic). Whole numbers throughout, so that results compare exactly.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.functions.text import compact, fold, fold_value, inside, name_of, natural_key, parent_of, phonetic, phonetic_score, stem_of
from sifter.operators.query import Query, parse

#: File types by extension; documents include pdf.
TYPES = {
    "pdf": ("pdf",),
    "documents": ("pdf", "txt", "md", "rtf", "doc", "docx", "pages", "ppt", "pptx", "key", "xls", "xlsx", "numbers", "csv", "html"),
    "images": ("png", "jpg", "jpeg", "gif", "heic", "tiff", "webp", "bmp", "svg"),
    "audio": ("mp3", "m4a", "wav", "aac", "flac", "aiff", "ogg"),
    "video": ("mp4", "mov", "m4v", "avi", "mkv", "webm"),
}
PRECISIONS = ("path", "fuzzy", "exact")


def with_folded(catalog: DataFrame, phonetic_names: bool = False) -> DataFrame:
    """The catalog with its name parts folded; store the result, as every query reads it."""
    out = catalog.withColumn("name", name_of(F.col("path")))
    none = F.array().cast("array<string>")
    return out.withColumns(
        {
            "norm_name": fold(F.col("name")),
            "norm_stem": fold(stem_of(F.col("name"))),
            "norm_parent": fold(parent_of(F.col("path"))),
            "norm_path": fold(F.col("path")),
            "forms": F.when(F.col("name").rlike("[㐀-鿿]"), phonetic(stem_of(F.col("name")))).otherwise(none) if phonetic_names else none,
        }
    )


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# Predicates


def type_filter(kind: str) -> Column:
    if kind == "all":
        return F.lit(True)
    if kind == "folders":
        return F.col("is_dir")
    return ~F.col("is_dir") & _any([F.col("norm_name").endswith(f".{x}") for x in TYPES[kind]])


def extension_filter(q: Query) -> Column:
    """Folders pass unless extensions are asked for; plain comparisons throughout, which reach the scan."""
    ends = lambda values: _any([F.col("norm_name").endswith(f".{x}") for x in sorted(values)])
    parts = [~F.col("is_dir") & ends(q.extensions)] if q.extensions else []
    if q.excluded_extensions:
        parts.append(F.col("is_dir") | ~ends(q.excluded_extensions))
    return _all(parts)


def name_filter(q: Query, precision: str = "path") -> Column:
    """Phrases and exclusions of a name search."""
    text = F.col("norm_path" if precision == "path" else "norm_name")
    return _all([text.contains(fold_value(p)) for p in q.phrases] + [~text.contains(fold_value(x)) for x in q.excluded])


def content_filter(q: Query, folded: Column) -> Column:
    """Words and unquoted exclusions also match across white space; phrases are literal."""
    if not q.valid:
        return F.lit(False)
    tight = compact(folded)
    loose = lambda w: folded.contains(fold_value(w)) | tight.contains("".join(fold_value(w).split()))
    parts = [loose(w) for w in q.words] + [folded.contains(fold_value(p)) for p in q.phrases]
    for x in q.excluded:
        parts.append(~(folded.contains(fold_value(x)) if x in q.excluded_phrases else loose(x)))
    return _all(parts)


def _day(as_of: dt.datetime, back: int) -> Column:
    day = dt.datetime.combine(as_of.date(), dt.time()) - dt.timedelta(days=back)
    return F.lit(day.isoformat(sep=" ")).cast("timestamp_ntz")


def days_filter(column: str, as_of: dt.datetime, days: int) -> Column:
    """The last `days` calendar days, today included; a missing date fails."""
    c = F.col(column)  # plain comparisons reach the scan; the null test makes them total
    return c.isNotNull() & (c >= _day(as_of, days - 1)) & (c < _day(as_of, -1))


def between_days(column: str, first: dt.date, last: dt.date) -> Column:
    at = lambda d: dt.datetime.combine(d, dt.time())
    c = F.col(column)
    return c.isNotNull() & (c >= _day(at(first), 0)) & (c < _day(at(last), -1))


def natural_filter(q: Query, as_of: dt.datetime) -> Column:
    n, parts = q.natural, []
    if n.days is not None:
        parts.append(days_filter("modified", as_of, n.days))
    if n.yesterday:
        parts.append(F.col("modified").isNotNull() & (F.col("modified") >= _day(as_of, 1)) & (F.col("modified") < _day(as_of, 0)))
    if n.above is not None or n.below is not None:
        parts.append(~F.col("is_dir"))
    if n.above is not None:
        parts.append(F.col("size") > n.above)
    if n.below is not None:
        parts.append(F.col("size") < n.below)
    if n.tag is not None:
        parts.append(tag_filter(n.tag))
    return _all(parts)


def tag_filter(tag: str) -> Column:
    return F.coalesce(F.exists("tags", lambda t: fold(t) == fold_value(tag)), F.lit(False))


def size_band(band: int) -> Column:
    """1: below 1 MB, 2: 1 to 100 MB, 3: above 100 MB, decimal; folders have none."""
    s = F.col("size")
    return ~F.col("is_dir") & {1: s < 1_000_000, 2: s.between(1_000_000, 100_000_000), 3: s > 100_000_000}[band]


def in_scope(roots: list[str], path: str = "path") -> Column:
    return _any([inside(F.col(path), r) for r in roots])


def hidden(path: str = "path") -> Column:
    return F.col(path).rlike(r"(^|/)\.")


def candidate_filter(q: Query, precision: str = "path") -> Column:
    """A cheap superset of what the name score accepts: each word's letters in order; names with phonetic forms stay."""
    columns = [F.col("norm_name"), F.col("norm_parent")] if precision == "path" else [F.col("norm_name")]
    joined, parts = fold_value(" ".join(q.words)), []
    for w in map(fold_value, q.words):
        if len(w) >= 2 and w.isascii() and not any(c in "*?\\%_" for c in w):
            gaps = "%" + "%".join(w) + "%"
            parts.append(_any([c.like(gaps) for c in columns]))
        else:
            parts.append(_any([c.contains(w) for c in columns]))
    whole = [(F.col("norm_name") == joined) | (F.col("norm_stem") == joined)] if q.words else []
    return _any([_all(parts), F.size("forms") > 0, *whole])


# Scores


def fuzzy_score(text: Column, word: str) -> Column:
    """Of a folded text: equal 1000, prefix 850, contained 700 less 3 a place (at most 120),
    else for two or more ASCII characters the leftmost subsequence by its gaps; null for none."""
    w = fold_value(word)
    if not w:
        return F.lit(0)
    score = F.when(text == w, 1000).when(text.startswith(w), 850).when(text.contains(w), 700 - F.least(F.lit(120), 3 * (F.locate(w, text) - 1)))
    if len(w) < 2 or not w.isascii():
        return score
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(380).alias("score"))

    def step(acc: Column, c: Column) -> Column:
        at = F.when(acc["at"] >= 0, F.call_function("locate", c, text, acc["at"] + 1)).otherwise(0)
        edge = (at == 1) | ~F.substring(text, at - 1, 1).rlike(r"[\p{L}\p{N}]")
        gap = at - acc["at"] - 1
        linked = F.when(acc["at"] == 0, 0).when(gap == 0, 18).otherwise(-F.least(F.lit(140), 9 * gap))
        hit = F.struct(
            at.alias("at"),
            F.when(acc["at"] == 0, at).otherwise(acc["first"]).alias("first"),
            (acc["score"] + F.when(edge, 28).otherwise(0) + linked).alias("score"),
        )
        return F.when(at > 0, hit).otherwise(F.struct(F.lit(-1).alias("at"), acc["first"].alias("first"), acc["score"].alias("score")))

    sparse = F.aggregate(
        F.array(*[F.lit(c) for c in w]),
        start,
        step,
        lambda acc: F.when(acc["at"] > 0, F.greatest(F.lit(40), acc["score"] - F.least(F.lit(100), 3 * (acc["first"] - 1)))),
    )
    # Only texts that hold the letters in order are worth the walk.
    return score.when(text.like("%" + "%".join(x if x not in "%_\\" else "\\" + x for x in w) + "%"), sparse)


def name_score(words: list[str], precision: str = "path") -> Column:
    """The sum over words; null if one of them has no score. No words score 0."""
    if not words:
        return F.lit(0)
    joined = fold_value(" ".join(words))
    whole = (F.col("norm_name") == joined) | (F.col("norm_stem") == joined)
    total = F.lit(None).cast("int")
    if precision != "exact":
        total = F.lit(0)
        for w in words:
            one = fuzzy_score(F.col("norm_name"), w) + 200
            if precision == "path" and len(fold_value(w)) >= 2:
                at_path = fuzzy_score(F.col("norm_parent"), w)
                one = F.coalesce(one, F.when(at_path.isNotNull(), F.least(F.lit(350), F.floor(at_path / 2).cast("int"))))
            total = total + F.coalesce(one, phonetic_score(F.col("forms"), w))
    return F.when(whole, 2000 * len(words)).otherwise(total)


def phrase_bonus(q: Query) -> Column:
    total = F.lit(0)
    for p in map(fold_value, q.phrases):
        n = F.col("norm_name")
        total = total + F.when((n == p) | (F.col("norm_stem") == p), 2000).when(n.contains(p), 1000).otherwise(400)
    return total


def query_score(q: Query, precision: str = "path") -> Column:
    """Null unless the query accepts the name."""
    if not q.valid:
        return F.lit(None).cast("int")
    ok = extension_filter(q) & name_filter(q, precision)
    return F.when(ok, name_score(q.words, precision) + phrase_bonus(q))


def reasons(words: list[str]) -> Column:
    """Why a row matches: name, initials, path or phonetic, each once, in order of the words."""
    out = []
    for w in words:
        f, n = fold_value(w), F.col("norm_name")
        at_path = fuzzy_score(F.col("norm_parent"), w).isNotNull() if len(f) >= 2 else F.lit(False)
        out.append(
            F.when(fuzzy_score(n, w).isNotNull(), F.when(n.contains(f), "name").otherwise("initials"))
            .when(at_path, "path")
            .when(phonetic_score(F.col("forms"), w).isNotNull(), "phonetic")
        )
    return F.array_distinct(F.array_compact(F.array(*out))) if out else F.array().cast("array<string>")


# Ranking


@dataclass
class Preferences:
    """What a user's history adds. opens: path, n. rejected: path. Both are joined, not broadcast."""

    manual: str | None = None
    alias: str | None = None
    preferred: str | None = None
    opens: DataFrame | None = None
    rejected: DataFrame | None = None
    pinned: list[str] = field(default_factory=list)


def rank(rows: DataFrame, score: Column, n_words: int, prefs: Preferences) -> DataFrame:
    """Rows with score, opens and demoted; see relevance_order."""
    chosen = F.col("path").isin(*[p for p in (prefs.manual, prefs.alias) if p]) if prefs.manual or prefs.alias else F.lit(False)
    out = rows.withColumn("score", F.when(chosen, 3000 * max(1, n_words)).otherwise(score).cast("int")).filter(F.col("score").isNotNull())
    if prefs.opens is not None:
        out = out.join(prefs.opens.select("path", F.col("n").alias("opens")), "path", "left")
    else:
        out = out.withColumn("opens", F.lit(0))
    out = out.withColumn("opens", F.least(F.lit(20), F.coalesce("opens", F.lit(0))).cast("int"))
    if prefs.rejected is not None:
        marks = prefs.rejected.select("path").distinct().withColumn("demoted", F.lit(1))
        out = out.join(marks, "path", "left")
    else:
        out = out.withColumn("demoted", F.lit(0))
    is_ = lambda p: (F.col("path") == p).cast("int") if p else F.lit(0)
    return out.withColumns({"demoted": F.coalesce("demoted", F.lit(0)), "manual": is_(prefs.manual), "preferred": is_(prefs.preferred)})


def relevance_order() -> list[Column]:
    return [
        F.col("demoted").asc(), F.col("manual").desc(), F.col("score").desc(), F.col("preferred").desc(), F.col("opens").desc(),
        F.col("modified").desc_nulls_last(), natural_key(F.col("path")).asc(), F.col("path").asc(),
    ]


def sort_order(mode: int) -> list[Column]:
    """0 relevance, 1 newest, 2 name, 3 files before folders and largest first."""
    tie = [natural_key(F.col("name")).asc(), F.col("path").asc()]
    first = {1: [F.col("modified").desc_nulls_last()], 2: [], 3: [F.col("is_dir").asc(), F.col("size").desc()]}
    return relevance_order() if mode == 0 else first[mode] + tie


def search(
    catalog: DataFrame,
    text: str,
    *,
    mode: str = "filename",
    precision: str = "path",
    as_of: dt.datetime,
    prefs: Preferences | None = None,
    roots: list[str] | None = None,
    exclusions: list[str] | None = None,
    panel: Column | None = None,
    sort: int = 0,
    limit: int | None = 2000,
    text_col: str = "norm_text",
) -> DataFrame:
    """The whole search as one lazy plan: filters, score, ranking, order, then the limit."""
    q, prefs = parse(text), prefs or Preferences()
    rows = catalog.filter(in_scope(roots)) if roots else catalog
    rows = rows.filter(~in_scope(exclusions)) if exclusions else rows
    keep = type_filter(q.type) & natural_filter(q, as_of)
    if mode == "content":
        keep = keep & extension_filter(q) & content_filter(q, F.col(text_col))
        score, words = F.lit(0), 0
    else:
        keep = keep & (extension_filter(q) & name_filter(q, precision) if q.valid else F.lit(False))
        targets = [p for p in (prefs.manual, prefs.alias) if p]
        first = candidate_filter(q, precision)  # a cheap superset of what has a score
        rows = rows.filter(first | F.col("path").isin(*targets) if targets else first)
        score, words = query_score(q, precision), len(q.words)
    rows = rank(rows.filter(keep if panel is None else keep & panel), score, words, prefs).orderBy(*sort_order(sort))
    return rows.limit(limit) if limit else rows


def near_names(catalog: DataFrame, term: str, most: int | None = 5) -> DataFrame:
    """Stems within edit distance 1 (terms of up to four characters) or 2, nearest first."""
    t = fold_value(term)
    reach = 1 if len(term) <= 4 else 2
    stems = catalog.select("norm_stem").filter(F.length("norm_stem") <= 64).distinct()
    d = F.levenshtein(F.col("norm_stem"), F.lit(t), reach)
    found = stems.withColumn("distance", d).filter((F.col("distance") > 0) & (F.abs(F.length("norm_stem") - len(t)) <= reach))
    found = found.orderBy("distance", "norm_stem")
    return found.limit(most) if most else found


def compact_location(catalog: DataFrame) -> DataFrame:
    """path and place: the shortest end of the parent that no other file of that name shares.

    Ends are counted by (name, end), so a name that very many files share is never in one task.
    """
    parts = F.filter(F.split(parent_of(F.col("path")), "/"), lambda x: x != "")
    rows = catalog.select("path", "norm_name", parts.alias("parts")).withColumn(
        "end", F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("parts", F.greatest(F.size("parts") - n + 1, F.lit(1)), n), "/").alias("tail"))))
    ).select("path", "norm_name", "end.depth", "end.tail")
    counts = rows.groupBy("norm_name", "depth", "tail").agg(F.count(F.lit(1)).alias("n"))
    peers = catalog.groupBy("norm_name").agg(F.count(F.lit(1)).alias("peers"))
    alone = rows.join(counts, ["norm_name", "depth", "tail"]).groupBy("path", "norm_name").agg(F.min(F.when(F.col("n") == 1, F.struct("depth", "tail"))).alias("best"))
    place = F.when((F.col("peers") > 1) & F.col("best").isNotNull(), F.col("best.tail")).otherwise(parent_of(F.col("path")))
    return alone.join(peers, "norm_name").select("path", place.alias("place"))
