"""ZIP archives as tables of members, from the directory at the end of the file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sifter.functions.text import fold, natural_key, safe_member

MEMBERS = "archive string, name string, size long, compressed long, crc long, method int, flags int, attributes long, offset long"
#: Fixed values of the format: signatures and the least and most bytes of the end record.
END, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END_BYTES, COMMENT = 22, 65_535
MAX_DIRECTORY, MAX_MEMBER = 50_000_000, 100_000_000


def members(data: bytes) -> list[tuple]:
    """Rows of an archive's directory; ValueError for split, 64-bit, oversized or broken ones."""
    at = data.rfind(END, max(0, len(data) - END_BYTES - COMMENT))
    if at < 0 or len(data) - at < END_BYTES:
        raise ValueError("no end record")
    disk, start_disk, here, total, size, offset = struct.unpack_from("<4H2I", data, at + 4)
    if disk or start_disk or here != total or total == 0xFFFF or offset == 0xFFFFFFFF:
        raise ValueError("split and 64-bit archives are not read")
    if size > MAX_DIRECTORY or offset + size > at:
        raise ValueError("the directory is too large or broken")
    out, pos = [], offset
    for _ in range(total):
        if data[pos : pos + 4] != ENTRY:
            raise ValueError("an entry is broken")
        flags, method = struct.unpack_from("<2H", data, pos + 8)
        crc, compressed, plain, n, extra, comment = struct.unpack_from("<3I3H", data, pos + 16)
        attributes, local = struct.unpack_from("<2I", data, pos + 38)
        raw = data[pos + 46 : pos + 46 + n]
        out.append((raw.decode("utf-8" if flags & 0x800 else "cp437", "replace"), plain, compressed, crc, method, flags, attributes, local))
        pos += 46 + n + extra + comment
    return out


def extract(data: bytes, offset: int, compressed: int, size: int, crc: int, method: int, flags: int) -> bytes | None:
    """A member's bytes; None if encrypted, too large, of another method, or not as listed."""
    if flags & 1 or method not in (0, 8) or size > MAX_MEMBER or data[offset : offset + 4] != LOCAL:
        return None
    n, extra = struct.unpack_from("<2H", data, offset + 26)
    raw = data[offset + 30 + n + extra :][:compressed]
    try:
        out = raw if method == 0 else zlib.decompressobj(-15).decompress(raw, MAX_MEMBER + 1)
    except zlib.error:
        return None
    return out if len(out) == size and zlib.crc32(out) == crc else None


def listing(files: DataFrame) -> DataFrame:
    """Members of archives; files: path, content. Archives that can't be read give no rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found += [(path, *m) for m in members(bytes(content))]
                except (ValueError, struct.error):
                    continue
            yield pd.DataFrame(found, columns=[c.split()[0] for c in MEMBERS.split(", ")])

    out = files.select("path", "content").mapInPandas(rows, MEMBERS)
    kind = F.shiftright("attributes", 16).bitwiseAND(F.lit(0o170000))
    return out.withColumns({"safe": safe_member(F.col("name")), "is_dir": F.col("name").endswith("/"), "symlink": kind == 0o120000})


@F.pandas_udf(BinaryType())
def member_bytes(content: pd.Series, offset: pd.Series, compressed: pd.Series, size: pd.Series, crc: pd.Series, method: pd.Series, flags: pd.Series) -> pd.Series:
    return pd.Series([extract(bytes(c), *map(int, rest)) for c, *rest in zip(content, offset, compressed, size, crc, method, flags, strict=True)])


def search_members(found: DataFrame, words: list[str], limit: int | None = None) -> DataFrame:
    """Members by name score at fuzzy precision, best first, then by natural name."""
    from sifter.operators.search import name_score

    rows = found.withColumns({"norm_name": fold(F.element_at(F.split("name", "/"), -1)), "forms": F.array().cast("array<string>")})
    rows = rows.withColumn("norm_stem", F.regexp_replace("norm_name", r"(?<=.)\.[^.]+$", ""))
    scored = rows.withColumn("score", name_score(words, "fuzzy")).filter("score is not null and safe")
    found = scored.orderBy(F.desc("score"), natural_key(F.col("name")), "archive").drop("norm_name", "norm_stem", "forms")
    return found.limit(limit) if limit else found


def totals(found: DataFrame, most_members: int = 10_000, most_bytes: int = 250_000_000) -> DataFrame:
    """archive, members, bytes, names and whether it may be unpacked: few and small enough members, no name twice."""
    name = fold(F.trim(F.col("name"), F.lit("/")))
    out = found.groupBy("archive").agg(F.count(F.lit(1)).alias("members"), F.sum("size").cast("long").alias("bytes"), F.count_distinct(name).alias("names"))
    good = (F.col("members") < most_members) & (F.col("bytes") <= most_bytes) & (F.col("names") == F.col("members"))
    return out.withColumn("acceptable", good)


def still_there(chosen: DataFrame, current: DataFrame) -> DataFrame:
    """Chosen members that a new listing of their archive still has as they were."""
    keys = ["archive", "name", "crc", "size", "flags", "offset"]
    return chosen.join(current.select(*keys).distinct(), keys, "left_semi")
