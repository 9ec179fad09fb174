"""Scalar functions over names, paths and texts, as Column expressions.

Folding here is lower case plus the accents of the Latin letters listed below; ß stays. The
general case (any script, width forms) is `fold_general`, a pandas UDF over NFKD.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Accented letters of the corpus' languages and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """Case and accents off; a JVM-side expression."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def fold_value(text: str) -> str:
    """fold() of a value, on the driver; query words and stored columns must agree."""
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def fold_any(text: str) -> str:
    """Compatibility forms, case and combining marks off, in any script."""
    parts = unicodedata.normalize("NFKD", text.lower())
    return unicodedata.normalize("NFC", "".join(c for c in parts if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def fold_general(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else fold_any(x))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(name: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def extension_of(name: Column) -> Column:
    return F.regexp_extract(name, r".\.([^.]+)$", 1)


def parent_of(path: Column) -> Column:
    parent = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(parent == "", F.lit("/")).otherwise(parent)


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest first, down to the root."""
    parts = F.split(path, "/")
    above = F.transform(
        F.reverse(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))),
        lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")),
    )
    return F.when((path == "/") | (path == ""), F.array().cast("array<string>")).otherwise(above)


def inside(path: Column, root: str) -> Column:
    """The root itself or below it; never a plain prefix."""
    if root == "/":
        return path.startswith("/")
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def natural_key(text: Column) -> Column:
    """A sort key by which runs of digits compare as numbers (up to 20 digits)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda v: F.when(v.rlike("^[0-9]"), F.lpad(v, F.greatest(F.length(v), F.lit(20)), "0")).otherwise(v)), "")


def collapse(text: Column) -> Column:
    """Blanks collapsed, folded: the key of an alias."""
    return fold(F.trim(F.regexp_replace(text, r"\s+", " ")))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def edit_distance(a: Column, b: Column, most: int = 64) -> Column:
    """Levenshtein distance of folded values; 100 when either is longer than `most`."""
    x, y = fold(a), fold(b)
    return F.when((F.length(x) > most) | (F.length(y) > most), F.lit(100)).otherwise(F.levenshtein(x, y))


def version_key(version: Column) -> Column:
    """Numbers between dots, non-numbers as 0, padded to eight places: compares as an array."""
    parts = F.transform(F.split(F.coalesce(version, F.lit("")), r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("long"), 8)), 1, F.greatest(F.size(parts), F.lit(8)))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _piece_ends(pieces: Column, n: int) -> Column:
    """Where the pieces but the last end, when n characters stand between them."""
    return F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,length:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p) + n).alias("pos"),
            F.concat(acc["out"], F.array(F.struct((acc["pos"] + F.length(p)).alias("at"), F.lit(n).alias("length")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def match_offsets(text: Column, words: list[str], most: int | None = None) -> Column:
    """(at, length) of non-overlapping hits of each distinct word in an already folded text; at most `most`, if given."""
    found = None
    for word in dict.fromkeys(fold_value(w) for w in words if w):
        pieces = F.split(text, "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
        hits = _piece_ends(pieces, len(word))
        hits = F.when(text.contains(word), hits).otherwise(F.array().cast("array<struct<at:int,length:int>>"))
        found = hits if found is None else F.concat(found, hits)
    if found is None:
        return F.array().cast("array<struct<at:int,length:int>>")
    return F.sort_array(found) if most is None else F.slice(F.sort_array(found), 1, most)


def spaced_offsets(text: Column, words: list[str], most_length: int = 80) -> Column:
    """(at, length) of words with no hit as they stand, with white space allowed between their characters.

    Case is ignored, accents are not; words longer than `most_length` are left out.
    """
    lower, out = F.lower(text), []
    for word in dict.fromkeys(w.lower() for w in words if w.strip() and len(w) <= most_length):
        pattern = "\\s*".join(re.escape(c) for c in word if not c.isspace())
        hits = F.regexp_extract_all(lower, F.lit(f"({pattern})"), F.lit(1))
        start = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<at:int,length:int>>").alias("out"))

        def step(acc: Column, hit: Column) -> Column:
            at = F.call_function("locate", hit, lower, acc["from"])
            span = F.array(F.struct((at - 1).alias("at"), F.length(hit).alias("length")))
            return F.struct((at + F.length(hit)).alias("from"), F.concat(acc["out"], span).alias("out"))

        direct = fold(text).contains(fold_value(word))
        out.append(F.when(~direct, F.aggregate(hits, start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<at:int,length:int>>")))
    return F.sort_array(F.concat(*out)) if out else F.array().cast("array<struct<at:int,length:int>>")


def excerpt(text: Column, folded: Column, words: list[str], before: int = 45, after: int = 100) -> Column:
    """The surroundings of the first hit, with … where text is cut; null without a hit."""
    hits = [F.when(F.locate(fold_value(w), folded) > 0, F.locate(fold_value(w), folded)) for w in words if w]
    if not hits:
        return F.lit(None).cast("string")
    at = F.least(*hits) if len(hits) > 1 else hits[0]
    start = F.greatest(at - before, F.lit(1))
    stop = F.least(at + after, F.length(text) + 1)
    cut = F.translate(F.substring(text, start, stop - start), "\r\n", "  ")
    return F.when(
        at.isNotNull(),
        F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(stop <= F.length(text), "…").otherwise("")),
    )


def size_text(size: Column) -> Column:
    """Bytes for people, in decimal units: 999 bytes, 1.5 KB, 20.0 MB."""
    units = [(10**12, "TB"), (10**9, "GB"), (10**6, "MB"), (1000, "KB")]
    out = F.concat(size.cast("string"), F.lit(" bytes"))
    for least, name in reversed(units):
        out = F.when(size >= least, F.format_string(f"%.1f {name}", (size / least).cast("double"))).otherwise(out)
    return out


def day_text(at: Column) -> Column:
    """A time for people, to the minute; empty where there is none."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(""))


def fingerprint(kind: Column, data: Column) -> Column:
    """SHA-256 of kind, a zero byte and the data."""
    return F.sha2(F.concat(kind.cast("binary"), F.unhex(F.lit("00")), data.cast("binary")), 256)


def safe_member(name: Column) -> Column:
    """Whether an archive member's name stays inside: not empty or absolute, no `..`, no odd signs."""
    return (
        (F.length(name) > 0)
        & ~name.startswith("/")
        & ~name.rlike(r"[\\:\x00-\x1f\x7f]")
        & ~F.array_contains(F.split(name, "/"), "..")
    )


def box_union(boxes: Column) -> Column:
    """The box around an array of boxes (x, y, w, h); null for none."""
    low = lambda f: F.array_min(F.transform(boxes, lambda b: b[f]))
    high = lambda f, s: F.array_max(F.transform(boxes, lambda b: b[f] + b[s]))
    return F.when(
        F.size(boxes) > 0,
        F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h")),
    )


def rotated_box(box: Column, turn: Column) -> Column:
    """A box in unit coordinates on a page turned by 0, 90, 180 or 270 degrees clockwise."""
    x, y, w, h = (box[c] for c in "xywh")
    put = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h"))
    return (
        F.when(turn == 90, put(y, 1 - x - w, h, w))
        .when(turn == 180, put(1 - x - w, 1 - y - h, w, h))
        .when(turn == 270, put(1 - y - h, x, h, w))
        .otherwise(put(x, y, w, h))
    )


# Phonetic names

#: Names whose characters take another reading together.
PHRASE_READINGS = {
    "重庆": "chong qing", "重阳": "chong yang", "重新": "chong xin", "重量": "zhong liang", "音乐": "yin yue", "乐器": "yue qi",
    "乐清": "yue qing", "长乐": "chang le", "快乐": "kuai le", "乐乐": "le le", "长沙": "chang sha", "长安": "chang an",
    "长大": "zhang da", "银行": "yin hang", "行长": "hang zhang", "行业": "hang ye", "朝阳": "chao yang", "厦门": "xia men",
}
#: A small table of single readings; callers pass their own for more.
CHAR_READINGS = {
    "重": "zhong", "庆": "qing", "阳": "yang", "新": "xin", "量": "liang", "音": "yin", "乐": "le", "器": "qi", "清": "qing", "长": "zhang",
    "快": "kuai", "沙": "sha", "安": "an", "大": "da", "银": "yin", "行": "xing", "业": "ye", "朝": "chao", "厦": "sha", "门": "men",
    "资": "zi", "料": "liao", "年": "nian", "度": "du", "合": "he", "同": "tong", "草": "cao", "稿": "gao", "文": "wen", "件": "jian",
}


def phonetic_forms(name: str, readings: dict[str, str] = CHAR_READINGS) -> list[str]:
    """The joined reading and the initials; none for names without Han characters.

    A phrase's default reading is replaced wherever it occurs in the whole reading, as soon as
    the name holds the phrase.
    """
    if not any("㐀" <= c <= "鿿" for c in name):
        return []
    spell = lambda text: "".join(f" {readings[c]} " if c in readings else c for c in text)
    tidy = lambda text: " ".join(fold_any(text).split())
    latin = tidy(spell(name))
    for phrase in sorted(PHRASE_READINGS):
        if phrase in name:
            latin = latin.replace(tidy(spell(phrase)), PHRASE_READINGS[phrase])
    parts = "".join(c if c.isalnum() else " " for c in latin).split()
    return ["".join(parts), "".join(p[0] for p in parts)]


@F.pandas_udf(ArrayType(StringType()))
def phonetic(name: pd.Series) -> pd.Series:
    """phonetic_forms of a column; stored once, so that queries match it with native expressions."""
    return name.map(lambda x: phonetic_forms(x) if x else [])


def phonetic_score(forms: Column, word: str) -> Column:
    """600 for a form that equals the word, 550 where one starts with it, 450 where one holds it."""
    word = fold_any(word)
    if len(word) < 2 or not (word.isascii() and word.isalnum()):
        return F.lit(None).cast("int")
    return F.array_max(F.transform(forms, lambda f: F.when(f == word, 600).when(f.startswith(word), 550).when(f.contains(word), 450)))
