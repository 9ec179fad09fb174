"""Captures of a clipboard history: which may enter, their titles, sizes, and checks of a stored history.

A capture has text, files (absolute paths) or an image, of which image_bytes, image_width and
image_height are known; see `Limits` for what may be stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.functions.text import fold, fold_value, name_of

#: A content type with one of these in its name is sensitive, as is the marker itself.
SENSITIVE = ("concealed", "sensitive", "password", "transient", "autogenerated", "onepassword", "1password")


@dataclass(frozen=True)
class Limits:
    """What a history may hold."""

    text_bytes: int = 200_000
    image_bytes: int = 4_000_000
    image_side: int = 8192
    image_pixels: int = 24_000_000
    files: int = 100
    path_bytes: int = 8192
    rows: int = 200
    pinned: int = 50
    total_bytes: int = 24_000_000


def sensitive(types: Column, marker: str | None = None) -> Column:
    """Whether one of the content types is sensitive; no types are not."""
    names = "|".join(SENSITIVE)
    hit = lambda x: F.lower(x).rlike(names) | (F.lower(x) == (marker or "").lower())
    return F.coalesce(F.exists(types, hit), F.lit(False))


def valid_image(limits: Limits = Limits()) -> Column:
    """Bounds of image_bytes, image_width and image_height; no image is not valid."""
    sides = [F.col(c).between(1, limits.image_side) for c in ("image_width", "image_height")]
    pixels = F.col("image_width").cast("long") * F.col("image_height") <= limits.image_pixels
    return F.coalesce(F.col("image_bytes").between(1, limits.image_bytes) & sides[0] & sides[1] & pixels, F.lit(False))


def with_images(rows: DataFrame) -> DataFrame:
    """Rows that may lack the columns of images get empty ones."""
    missing = {c: F.lit(None).cast("long") for c in ("image_bytes", "image_width", "image_height") if c not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def prioritised(rows: DataFrame) -> DataFrame:
    """Captures with one kind each: files before an image before text."""
    out = with_images(rows)
    kind = F.when(F.size("files") > 0, "files").when(F.col("image_bytes").isNotNull(), "image").when(F.col("text").isNotNull(), "text")
    only = lambda k, *columns: {c: F.when(F.col("kind") == k, F.col(c)) for c in columns}
    return out.withColumn("kind", kind).withColumns(only("files", "files") | only("image", "image_bytes", "image_width", "image_height") | only("text", "text"))


def valid(limits: Limits = Limits()) -> Column:
    """Of rows with all payload columns: exactly one kind of payload, within its bounds."""
    kinds = F.col("text").isNotNull().cast("int") + (F.coalesce(F.size("files"), F.lit(0)) > 0).cast("int") + F.col("image_bytes").isNotNull().cast("int")
    path = lambda f: f.startswith("/") & (F.octet_length(f) <= limits.path_bytes) & ~f.contains("\0")
    files = F.col("files").isNull() | ((F.size("files") <= limits.files) & F.forall("files", path))
    text = F.col("text").isNull() | (F.octet_length("text") <= limits.text_bytes)
    return (kinds == 1) & F.coalesce(files, F.lit(False)) & text & (F.col("image_bytes").isNull() | valid_image(limits))


def acceptable(rows: DataFrame, excluded: list[str] | None = None, marker: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Captures that may enter the history: enabled, not paused, no sensitive type, no excluded source, valid."""
    full = with_images(rows)
    source = ~F.coalesce(F.col("source_id"), F.lit("")).isin(*excluded) if excluded else F.lit(True)
    return full.filter(F.col("enabled") & ~F.col("paused") & ~sensitive(F.col("types"), marker) & valid(limits) & source).select(*rows.columns)


def payload_bytes() -> Column:
    """UTF-8 bytes of the text and of all paths, and the image's bytes."""
    files = F.aggregate(F.coalesce("files", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, f: a + F.octet_length(f))
    return F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + files + F.coalesce(F.col("image_bytes").cast("long"), F.lit(0))


def title() -> Column:
    """The text's first 110 characters with line ends as two blanks, the first file's name, or the image's size."""
    files = F.concat(name_of(F.element_at("files", 1)), F.when(F.size("files") > 1, F.format_string(" and %d more", F.size("files") - 1)).otherwise(""))
    return (
        F.when(F.col("text").isNotNull(), F.substring(F.replace("text", F.lit("\n"), F.lit("  ")), 1, 110))
        .when(F.size("files") > 0, files)
        .otherwise(F.format_string("image of %d bytes", F.col("image_bytes")))
    )


def matches(needle: str) -> Column:
    """Whether the folded text, paths, source and title hold the needle; an empty one is everywhere."""
    searchable = F.concat_ws("\n", "text", F.array_join("files", "\n"), "source_id", title())
    return fold(searchable).contains(fold_value(needle))


def list_order() -> list[Column]:
    return [F.col("pinned").desc(), F.col("created").desc()]


def _totals() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if("pinned").alias("n_pinned"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes")]


def totals(history: DataFrame) -> DataFrame:
    """One row: rows, pinned rows and payload bytes."""
    return history.agg(*_totals())


def load_problems(history: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """problem: why a stored history (id, fingerprint, pinned, bytes) is refused as a whole; no rows if it may be used."""
    sums = history.agg(*_totals(), F.count_distinct("id").alias("ids"), F.count_distinct("fingerprint").alias("prints"))
    found = {
        "rows": F.col("n") > limits.rows,
        "pinned": F.col("n_pinned") > limits.pinned,
        "bytes": F.col("bytes") > limits.total_bytes,
        "id": F.col("ids") < F.col("n"),
        "fingerprint": F.col("prints") < F.col("n"),
    }
    problems = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]))
    return sums.select(F.explode(problems).alias("problem"))
