"""WARC archives: a writer, and a Python data source that reads them back.

Writing uses Spark's text writer: a record's header block and payload are one value, and the
writer's line separator is the two line ends that close a record, so any file system that Spark
knows takes the files. Of records with equal payloads of at least ``min_revisit_bytes`` bytes the
one with the largest id is the response and the others revisit it, without a payload.

Reading (format ``warc``) plans one partition for a group of whole files. Equality and IN filters
on ``record_type`` and on the header columns are pushed down: each record's headers are parsed
first, and the payload of a record that a filter rejects, or any payload where the option
``payload`` is ``none``, is skipped by its length: without being read in a plain file. In a gzip one,
which is a single stream, it is still inflated, but neither decoded nor handed on.

Defined cases: a null payload is taken as empty; rows with a null id are written without one and
come last among equal payloads; repeated rows are written once each, and rows that share the
largest id of equal payloads are all responses; a response's header block keeps no line ends from
the url; very long payloads are written and read whole; other columns are ignored; no rows make an
archive without records.
"""

from __future__ import annotations

import base64
import glob
import gzip
import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StringType, StructType

from sifter.llm.common import staged

#: Record-ending line ends of the format.
RECORD_END = "\r\n\r\n"
SCHEMA = (
    "record_type string, record_id long, target_uri string, refers_to long, payload_digest string, "
    "payload_bytes long, content_length long, payload string"
)
HEADER_OF = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "content_length": "Content-Length",
}


@F.pandas_udf(StringType())
def _base32(hexed: pd.Series) -> pd.Series:
    return hexed.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())


@dataclass(frozen=True)
class Warc:
    """Parameters; the defaults are those of the registered query."""

    min_revisit_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"
    #: Bytes of files that one partition reads; a larger file is one partition.
    partition_bytes: int = 64 << 20


def records(pages: DataFrame, spec: Warc = Warc(), id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row a page: record_id, url, payload, digest, bytes, record_type, refers_to."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("sha1"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    # Counted with partial sums, so a payload that many pages share is one row here.
    repeated = (
        base.filter(F.col("bytes") >= spec.min_revisit_bytes)
        .groupBy(F.col("sha1").alias("same"))
        .agg(F.max("record_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    # Payloads that a thousandth of all pages share, a thousand at most, are told by a broadcast, so
    # that none of them meets in one task; the others in a join, which the hot ones are spread over.
    total = pages.count()
    repeated = staged(repeated)
    hot = F.col("n") >= max(1000, -(-total // 1000))
    told = base.join(F.broadcast(repeated.filter(hot).select(F.col("same").alias("hot"), F.col("first_id").alias("hot_id"))), F.col("sha1") == F.col("hot"), "left")
    told = told.withColumn("key", F.when(F.col("hot").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("hot "), F.xxhash64("record_id", "url").cast("string"))))
    joined = told.join(repeated.filter(~hot).select("same", "first_id"), F.col("key") == F.col("same"), "left").withColumn("first_id", F.coalesce("first_id", "hot_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "record_id",
        "url",
        "payload",
        _base32("sha1").alias("digest"),
        "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), id_.cast("string"), F.lit(">"))


def write(rows: DataFrame, path: str, spec: Warc = Warc(), compression: str = "gzip") -> None:
    """Write rows of records() as WARC files below path; compression may be gzip or none."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")

    def header(name: str, value: Column) -> Column:  # concat_ws leaves nulls out
        return F.concat(F.lit(f"{name}: "), value)

    block = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", _urn(F.col("record_id"))),
        header("WARC-Date", F.lit(spec.date)),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        header("WARC-Refers-To", _urn(F.col("refers_to"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("X-Payload-Length", F.col("bytes").cast("string")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(body).cast("string")),
    )
    rows.select(F.concat(block, F.lit("\r\n\r\n"), body).alias("value")).write.option("lineSep", RECORD_END).option("compression", compression).text(path)


# Reading


def _files(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the data files at a path: a file, a folder or a pattern of local files."""
    local = unquote(urlsplit(path).path) if path.startswith("file:") else path
    if "://" not in local:
        found = glob.glob(local) if any(c in local for c in "*?[") else [local]
        names = [n for f in found for n in ([os.path.join(f, x) for x in sorted(os.listdir(f))] if os.path.isdir(f) else [f])]
        return [(n, os.path.getsize(n)) for n in names if not os.path.basename(n).startswith((".", "_"))]
    from pyarrow import fs

    path = _uri(path)
    system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    infos = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    scheme = path.split("://", 1)[0] + "://" + urlsplit(path).netloc
    return [(scheme + i.path, i.size) for i in sorted(infos, key=lambda i: i.path) if i.is_file and not i.base_name.startswith((".", "_"))]


def _uri(path: str) -> str:
    """A URI as pyarrow spells it."""
    return re.sub("^s3[an]://", "s3://", path)


def _opened(uri: str):
    if "://" not in uri:
        stream = open(uri, "rb", buffering=1 << 20)
    else:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(uri)
        stream = io.BufferedReader(system.open_input_file(at), 1 << 20)
    return gzip.GzipFile(fileobj=stream) if uri.endswith(".gz") else stream


def _value(column: str, headers: dict[str, str]) -> str | int | None:
    raw = headers.get(HEADER_OF[column].lower())
    if raw is None:
        return None
    if column in ("record_id", "refers_to"):
        m = re.fullmatch(r"<urn:page:(-?\d+)>", raw)
        return int(m[1]) if m else None
    if column == "payload_digest":
        return raw.removeprefix("sha1:")
    return int(raw) if column in ("payload_bytes", "content_length") else raw


def scan_file(stream, filters: dict[str, set], want_payload: bool) -> Iterator[tuple]:
    """Records of an open file as tuples in the order of SCHEMA."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")][:-1]
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {stream.tell() - len(line)}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        values = tuple(_value(c, headers) for c in columns)
        if any(values[columns.index(c)] not in allowed for c, allowed in filters.items()):
            stream.seek(length, 1)
        elif want_payload:
            yield (*values, stream.read(length).decode("utf-8", "replace"))
        else:
            stream.seek(length, 1)
            yield (*values, None)


class Files(InputPartition):
    def __init__(self, uris: list[str]) -> None:
        self.uris = uris


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.want_payload = options.get("payload", "text") != "none"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", Warc.partition_bytes)))
        self.filters: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.filters[name] = self.filters.get(name, allowed) & allowed
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        groups, now, size = [], [], 0
        for uri, n in _files(self.path):
            if now and size + n > self.partition_bytes:
                groups.append(Files(now))
                now, size = [], 0
            now.append(uri)
            size += n
        return groups + [Files(now)] * bool(now) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for uri in partition.uris:
            with _opened(uri) as stream:
                yield from scan_file(stream, self.filters, self.want_payload)


class WarcDataSource(DataSource):
    """Options: path; payload (text or none); partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: str = "text") -> DataFrame:
    """The records of archives as a table; filters on headers reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def digest(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """A row a record: of responses the size and digest of the payload as read, of revisits what their headers say.

    A response whose header tells another size or digest than its payload has stops the job.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    read = responses.select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", F.octet_length(payload).cast("long").alias("size"), _base32(F.sha1(payload.cast("binary"))).alias("sha"))
    same = (F.col("size") == F.col("payload_bytes")) & (F.col("sha") == F.col("payload_digest"))
    checked = F.when(same, F.col("sha")).otherwise(F.raise_error(F.concat(F.lit("payload and headers differ in record "), F.col("record_id").cast("string"))))
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = read.select(F.col("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")
    return first.unionByName(revisits.withColumnRenamed("record_id", "page_id").select(*out))


def round_trip(spark: SparkSession, path: str) -> DataFrame:
    """digest() of the archives at a path; each kind of record is asked of the reader, payloads of responses only."""
    responses = read(spark, path).filter(F.col("record_type") == "response")
    return digest(responses, read(spark, path, payload="none").filter(F.col("record_type") == "revisit"))


def sql(min_revisit_bytes: int = 0, table: str = "pages") -> str:
    """The digest in DuckDB SQL; base32 takes five hex digits (four symbols) at a time."""
    group = "[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((n >> s) & 31), 1) FOR s IN [15, 10, 5, 0]]"
    return f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM {table}),
g AS (SELECT h, max(page_id) AS first_id FROM p WHERE payload_bytes >= {min_revisit_bytes} GROUP BY h HAVING count(*) > 1),
j AS (SELECT p.*, first_id, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM p LEFT JOIN g USING (h))
SELECT page_id, payload_bytes,
    array_to_string([array_to_string({group}, '') FOR n IN [CAST('0x' || substr(h, 1 + 5 * i, 5) AS INTEGER) FOR i IN range(8)]], '') AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM j"""
