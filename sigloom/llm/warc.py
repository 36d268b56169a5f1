"""WARC archives with revisit records, and their resolution when read back."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import keep, new_path, sent

#: Shortest payload in bytes that others revisit, and most records of one archive file.
LEAST_BYTES, FILE_RECORDS = 100, 2000
END = "\r\n\r\n"
#: Names of the headers beside the standard ones: the page's id in Base64.
PAGE = "X-Page-Id"


def assign_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """id, url, payload, bytes, digest, refers_to (null for responses).

    Only headers (digest, id) are shuffled by digest, pre-aggregated in each task; digests that occur again meet the pages where these are,
    up to a counted bound. Null payloads count as empty. The smallest id is the response; rows that repeat its
    id and payload are responses too, null ids revisit when another id has their payload.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))
    again = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first")
    again, _ = keep(pages.sparkSession, again, "again")
    both = rows.join(sent(again), (rows["digest"] == again["d"]) & (rows["bytes"] >= least), "left")
    return both.select("id", "url", "payload", "bytes", "digest", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to"))


def _urn(id_: Column, digest: Column) -> Column:
    """A record's id: of its page's id and payload; a response's tells those that revisit it what to refer to."""
    h = F.md5(F.concat_ws(":", F.when(id_.isNull(), "none").otherwise("id"), id_.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(roles: DataFrame, path: str) -> None:
    """One record a row, in gzipped archives under path, through Spark's own committed writer: a lost task leaves no half file.

    A record's header is fresh: its own id, the time of writing, the payload's digest; a revisit's block is empty and names the response.
    Rows that repeat an id and payload are copies of one record.
    """
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace("url", r"[\r\n]+", "%0A")
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"), F.col("digest"))),
        F.lit(f"WARC-Date: {now}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit(f"{PAGE}: "), F.translate(F.base64(F.encode(F.col("id").cast("string"), "utf-8")), "\r\n", "")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to"), F.col("digest")))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.when(revisit, "").otherwise(F.col("payload")))
    roles.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Records:
    """Records of one archive from its bytes as they come: a block may hold anything, and no more than one record is held."""

    def __init__(self):
        self.held: list[bytes] = []
        self.size, self.need = 0, 1

    def feed(self, more: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held.append(more)
        self.size += len(more)
        while self.size >= self.need:
            data = b"".join(self.held)
            end = data.find(b"\r\n\r\n")
            if end < 0:
                self.held, self.need = [data], self.size + 1
                return
            version, *lines = data[:end].decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("no WARC record here")
            headers = dict(x.split(": ", 1) for x in lines)
            whole = end + 4 + int(headers["Content-Length"]) + 4
            if len(data) < whole:
                self.held, self.need = [data], whole
                return
            yield headers, data[end + 4 : whole - 4]
            self.held, self.size, self.need = [data[whole:]], len(data) - whole, 1

    def close(self) -> None:
        if self.size:
            raise ValueError("an archive ends within a record")


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by Content-Length."""
    records = Records()
    yield from records.feed(archive)
    records.close()


def _records(spark, path: str) -> DataFrame:
    """(record, page, kind, digest, bytes, refers): a row for each record under path, read as a stream of each archive's bytes.

    A response's digest and length are taken from its block and held against its headers; a revisit has no length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, records = None, Records()
        names = ["record", "page", "kind", "digest", "bytes", "refers"]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for file, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if file != at:
                    records.close()
                    at, records = file, Records()
                for h, block in records.feed(piece.as_py() + b"\r\n\r\n"):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = h["WARC-Type"] == "response"
                    if response and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError("a block differs from its header")
                    rows.append((h["WARC-Record-ID"], h.get(PAGE), h["WARC-Type"], digest, len(block) if response else None, h.get("WARC-Refers-To")))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        records.close()

    lines = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, "record string, page string, kind string, digest string, bytes long, refers string")


def read_archives(pages: DataFrame, path: str, id_col: str = "page_id") -> DataFrame:
    """A row for each record of the archives under path. A revisit's page, length and digest come from the response that it refers to, by a join of headers."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    records, _ = keep(spark, _records(spark, path), "records")
    own = F.unbase64("page").cast("string").cast(kind)
    named = records.where("refers is not null").select(F.col("refers").alias("r")).distinct()
    originals = records.where("kind = 'response'").join(named, F.col("record") == F.col("r"), "left_semi").select(F.col("record").alias("o"), own.alias("page_o"), F.col("bytes").alias("bytes_o"), F.col("digest").alias("digest_o")).dropDuplicates(["o"])
    both = records.join(sent(originals), records["refers"] == originals["o"], "left")
    revisit = F.col("kind") == "revisit"
    lost = F.when(revisit & (F.col("o").isNull() | (F.col("digest") != F.col("digest_o"))), F.raise_error("a revisit's response is not there").cast("long"))
    return both.select(
        own.alias(id_col),
        F.coalesce(lost, F.when(revisit, F.col("bytes_o")).otherwise(F.col("bytes"))).alias("payload_bytes"),
        F.when(revisit, F.col("digest_o")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("page_o")).alias("refers_to"),
    )


def archive_pages(pages: DataFrame, id_col: str = "page_id", path: str | None = None) -> DataFrame:
    """Write deduplicated archives of pages to path (a new shared folder by default) and return what reading them gives.

    An empty table gives no records and no rows. Ids are of any type that a string can be cast to. Other columns than id, url and html are not read.
    """
    path = path or new_path(pages.sparkSession, f"warc-{uuid.uuid4().hex[:6]}")
    write_archives(assign_roles(pages, id_col), path)
    return read_archives(pages, path, id_col)


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest) as first from q)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
case when payload_bytes >= 100 and first <> page_id then first end as refers_to from r
"""
