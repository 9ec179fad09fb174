"""Smaller operators: menus, palettes, recovery, hits on pages, validation and learned choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.functions.text import box_union, fold, fold_value, phonetic_score
from sifter.operators.query import choice_key, parse
from sifter.operators.search import fuzzy_score


def flatten_menu(items: DataFrame, depth: int | None = None) -> DataFrame:
    """id, title (`group › item`) of the items that do something, in no order.

    items: id, parent (null at the top), title, action, separator. Titles grow by as many levels a
    round as they did in all rounds before, until no item has a group left; with `depth`, items
    below that level are left out. Items on a cycle of groups have no title.
    """
    paths = items.select("id", "parent", "title", F.lit(1).alias("level"))
    rounds = 0
    while paths.filter("parent is not null").limit(1).count() and rounds < 32:
        up = paths.select(F.col("id").alias("up"), F.col("parent").alias("above"), F.col("title").alias("group"), F.col("level").alias("levels"))
        paths = paths.join(up, F.col("parent") == F.col("up"), "left").select(
            "id", F.col("above").alias("parent"), F.concat_ws(" › ", "group", "title").alias("title"), (F.col("level") + F.coalesce("levels", F.lit(0))).alias("level")
        )
        paths, rounds = paths.checkpoint() if rounds % 4 == 3 else paths, rounds + 1
    whole = paths.filter("parent is null" + (f" and level <= {depth + 1}" if depth is not None else "")).select("id", "title")
    return whole.join(items.filter("not separator and action is not null").select("id"), "id", "left_semi")


def palette(commands: DataFrame, text: str) -> DataFrame:
    """Commands (ord, title, forms) whose title every word matches, best first."""
    rows = commands.withColumn("norm_title", fold(F.col("title")))
    total = F.lit(0)
    for w in text.split():
        total = total + F.coalesce(fuzzy_score(F.col("norm_title"), w), phonetic_score(F.col("forms"), w))
    return rows.withColumn("score", total).filter("score is not null").orderBy(F.desc("score"), "ord").select("ord", "title", "score")


def recovery(journal: DataFrame, live: DataFrame) -> DataFrame:
    """original, found: where an interrupted rename left each file, by identity.

    journal: original, temporary, target, identity; live: path, identity. The first place that
    holds the file counts, in that order.
    """
    places = F.posexplode(F.array("temporary", "original", "target")).alias("turn", "path")
    held = journal.select("original", "identity", places).join(live.select("path", "identity"), ["path", "identity"], "left_semi")
    found = held.groupBy("original").agg(F.min_by("path", "turn").alias("found"))
    return journal.select("original").join(found, "original", "left")


def text_hits(records: DataFrame, word: str, most: int | None = None) -> DataFrame:
    """path, page, box of each span's hit, in order; at most `most` a path, if given, with `limited` where cut.

    A hit's box is the union of the glyphs it covers (spans.glyphs: at, length, x, y, w, h), or
    the span's own where it has none.
    """
    from pyspark.sql import Window

    w = fold_value(word)
    spans = records.select("path", F.posexplode("spans").alias("turn", "span"))
    at = F.locate(w, fold(F.col("span.text"))) - 1
    hits = spans.withColumn("at", at).filter((F.col("at") >= 0) & F.lit(len(w) > 0))
    covered = F.filter("span.glyphs", lambda g: (g["at"] < F.col("at") + len(word)) & (g["at"] + g["length"] > F.col("at")))
    own = F.struct(*[F.col(f"span.{c}").alias(c) for c in "xywh"])
    boxed = hits.select("path", "turn", F.col("span.page").alias("page"), F.coalesce(box_union(covered), own).alias("box"))
    order = Window.partitionBy("path").orderBy("turn")
    if most is None:
        return boxed.orderBy("path", "turn").select("path", "page", "box", F.lit(False).alias("limited"))
    counted = boxed.withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("path"))})
    return counted.filter(F.col("place") <= most).select("path", "page", "box", (F.col("n") > most).alias("limited"))


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, one of the hosts, a path, no user."""
    part = lambda p: F.call_function("try_parse_url", url, F.lit(p))
    return F.coalesce((part("PROTOCOL") == "https") & part("HOST").isin(*hosts) & (F.length(part("PATH")) > 1) & part("USERINFO").isNull(), F.lit(False))


def valid_manifest(hosts: list[str]) -> Column:
    """Of columns version, build, notes (array), digest, bytes, url."""
    return F.coalesce(
        F.col("version").rlike(r"^[0-9]+(\.[0-9]+){0,3}$")
        & (F.col("build") > 0)
        & (F.size("notes") <= 30)
        & F.forall("notes", lambda n: F.length(n) <= 1000)
        & F.col("digest").rlike("^[0-9a-fA-F]{64}$")
        & F.col("bytes").between(1, 100_000_000)
        & allowed_url(F.col("url"), hosts),
        F.lit(False),
    )


def valid_sources(ids: Column) -> Column:
    """Excluded application ids, trimmed, lower-cased, distinct and sorted; null if one is not valid."""
    tidy = F.array_sort(F.array_distinct(F.transform(ids, lambda x: F.lower(F.trim(x)))))
    good = F.forall(tidy, lambda x: (F.octet_length(x) <= 200) & x.contains(".") & x.rlike("^[a-z0-9._-]+$"))
    return F.when((F.size(tidy) <= 100) & good, tidy)


def search_history(searches: DataFrame, idle: float = 1.5, most: int | None = None, suppressed: str | None = None) -> DataFrame:
    """key, text, at: what was typed and left for `idle` seconds, once by folded text; a user's `most` newest, if given.

    searches: user, text, at (seconds). A suppressed text, such as one just removed, is not recorded.
    """
    from pyspark.sql import Window

    following = F.lead("at").over(Window.partitionBy("user").orderBy("at"))
    rest = searches.withColumn("following", following).filter((F.trim("text") != "") & (F.col("following").isNull() | (F.col("following") - F.col("at") >= idle)))
    if suppressed is not None:
        rest = rest.filter(fold(F.trim("text")) != fold_value(suppressed.strip()))
    last = rest.groupBy("user", fold(F.trim("text")).alias("key")).agg(F.max_by("text", "at").alias("text"), F.max("at").alias("at"))
    if most is None:
        return last
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("at"), "key"))
    return last.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def learned_choices(choices: DataFrame, most: int | None = None) -> DataFrame:
    """key, path: what was chosen for a search; a manual choice beats any automatic one, then the newest.

    choices: key (see choice_of), path, manual, at. With `most`, no more keys are remembered; the
    one of the newest choice stays, and of the others the smallest go.
    """
    out = choices.groupBy("key").agg(F.max_by("path", F.struct("manual", "at", "path")).alias("path"), F.bool_or("manual").alias("manual"), F.max("at").alias("last"))
    if most is not None:
        newest = out.orderBy(F.desc("last"), F.desc("key")).limit(1)
        rest = out.join(newest.select("key"), "key", "left_anti").orderBy(F.desc("key")).limit(most - 1)
        out = newest.unionByName(rest)
    return out.drop("last")


def rejected_paths(rejections: DataFrame, most: int | None = None) -> DataFrame:
    """key, path of each search's last rejections, as many as `most` if given."""
    from pyspark.sql import Window

    last = rejections.groupBy("key", "path").agg(F.max("at").alias("at"))
    if most is None:
        return last.select("key", "path")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), "path"))
    return last.withColumn("place", place).filter(F.col("place") <= most).select("key", "path")


def choice_of(mode: str, text: str) -> str:
    return choice_key(mode, parse(text), text)
