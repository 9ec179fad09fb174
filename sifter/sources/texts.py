"""Reading texts for evidence: plain files, pages with a pluggable extractor, and hits on pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.text import excerpt, fold, match_offsets

#: Extensions read as plain text, besides txt.
PLAIN = ("txt", "md", "csv", "log", "json", "yaml", "yml", "swift", "py", "js", "ts")


@dataclass(frozen=True)
class Bounds:
    """What is read of a file; None is no bound."""

    plain_bytes: int | None = 4 << 20
    file_bytes: int | None = 100_000_000
    pages: int | None = 30
    characters: int | None = 500_000


def decode(raw: bytes) -> str | None:
    """UTF-8, else UTF-16, else nothing."""
    for encoding in ("utf-8", "utf-16"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def read_plain(spark: SparkSession, path: str, bounds: Bounds = Bounds()) -> DataFrame:
    """path, text of the plain-text files below a path that are small enough and can be decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*PLAIN))
    kept = kept if bounds.plain_bytes is None else kept.filter(F.col("length") <= bounds.plain_bytes)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [decode(bytes(c)) for c in pdf["content"]]})

    return kept.select("path", "content").mapInPandas(texts, "path string, text string").filter("text is not null")


def extract_pages(files: DataFrame, extractor: Callable[[str, bytes], list[str]], bounds: Bounds = Bounds()) -> DataFrame:
    """path, text, pages, limited of files (path, content): each page of the extractor after a header line.

    The extractor gives a file's pages, or raises; such a file has no row. Reading stops after the
    bound of pages, or after the page that reaches that of characters.
    """
    small = files if bounds.file_bytes is None else files.filter(F.octet_length("content") <= bounds.file_bytes)

    def joined(pages: list[str]) -> tuple[str, int, bool]:
        out, size, limited = [], 0, bounds.pages is not None and len(pages) > bounds.pages
        for k, page in enumerate(pages[: bounds.pages], 1):
            out.append(f"\n[page {k}]\n{page}")
            size += len(out[-1])
            if bounds.characters is not None and size >= bounds.characters:
                limited = True
                break
        return "".join(out)[: bounds.characters], len(out), limited

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, *joined(extractor(path, bytes(content)))))
                except Exception:  # what an extractor can't read
                    continue
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "limited"])

    return small.select("path", "content").mapInPandas(read, "path string, text string, pages int, limited boolean")


def page_evidence(pages: DataFrame, words: list[str], most_pages: int | None = None) -> DataFrame:
    """path, excerpt, matches, limited of paged texts (path, page from 0, text): the first page with a hit
    gives the excerpt; all hits on the pages read are counted."""
    kept = pages if most_pages is None else pages.filter(F.col("page") < most_pages)
    hit = kept.withColumn("folded", fold(F.col("text")))
    hit = hit.select("path", "page", F.size(match_offsets(F.col("folded"), words)).alias("n"), excerpt(F.col("text"), F.col("folded"), words).alias("excerpt"))
    found = hit.groupBy("path").agg(F.min_by("excerpt", F.when(F.col("excerpt").isNotNull(), F.col("page"))).alias("excerpt"), F.sum("n").cast("long").alias("matches"))
    over = pages.groupBy("path").agg((F.max("page") >= most_pages if most_pages is not None else F.lit(False)).alias("limited"))
    return found.join(over, "path")
