"""WARC archives with revisit resolution.

`resolve_revisits` finds, for every payload digest, the record that keeps the payload; `write_archives` writes real
WARC/1.1 files in which repeated payloads are revisit records with fresh headers; `read_archives` parses such files
by Content-Length; `resolve_read` joins revisits back to the responses that they name.

Digests are resolved on headers (id, URL, digest, length) alone. Records then take their response from that result:
payloads too small to be revisits and those whose digest doesn't repeat are written where they are read (a bitmap of a
bounded size tells them), common digests meet theirs by broadcast, and only the others are shuffled.

Null html: an empty payload. Null page id: an empty id in the record's urn, read back as null. Ids of any type are
written as text and cast back. Null or odd URLs: line breaks become spaces. Repeated rows (same page id, same payload):
all are responses if that id is the largest; ties in it take the last URL. Very long payloads get files of their own
(FILE_BYTES). Other columns aren't read. An empty table gives one empty archive folder and no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import bitmap, join_unique, least_hot, map_rows, marked, shared_dir, table, written

#: Payloads below this many bytes are always written in full.
LEAST_BYTES = 1000
#: About the most bytes of payload in one archive file, which a reader holds at once; classes of payload sizes, each of
#: which gets files with as many records as fit at its largest. A file of the last class holds one record.
FILE_BYTES, SIZE_CLASSES = 64 << 20, (16 << 10, 256 << 10, 4 << 20, 1 << 31)
# Fixed values of the WARC/1.1 format.
VERSION, CRLF = "WARC/1.1", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"


def with_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest); the digest is the lower-case hex SHA-1."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]+", " ").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )


def resolve_revisits(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(payload_digest, original, original_url, n): for digests of n > 1 records, the page that keeps the payload.

    Only headers are shuffled, and they are aggregated before the shuffle, so a hot digest is no hot task.
    """
    headers = records.where(F.col("payload_bytes") >= least_bytes)
    groups = headers.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").select("payload_digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"), "n")


def record_text(records: DataFrame, date: str) -> DataFrame:
    """One WARC record per row as text, without the blank lines that end it."""
    name = F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{ID_PREFIX}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("original_url"))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves out the null lines
    return records.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Write one record per page under `path`; returns the digest groups that were resolved.

    `date`: when the pages were fetched. Each size class that occurs is written with its own number of records per file.
    """
    records = with_digests(pages, **columns)
    headers = written(records.drop("payload"))
    groups = written(resolve_revisits(headers))
    largest, n = headers.agg(F.coalesce(F.max("payload_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    hot = groups.where(F.col("n") >= least_hot(n)).select("payload_digest")
    marks, bits = bitmap(groups.select(F.xxhash64("payload_digest").alias("key")), "key", groups.count())
    repeats = marked(records.withColumn("key", F.xxhash64("payload_digest")), "key", marks, bits, "repeats").drop("key")
    repeats = repeats.withColumn("repeats", F.col("repeats") & (F.col("payload_bytes") >= LEAST_BYTES))
    alone = repeats.where(~F.col("repeats")).withColumns({"original": F.lit(None).cast(records.schema["page_id"].dataType), "original_url": F.lit(None).cast("string")})
    typed = alone.unionByName(join_unique(repeats.where("repeats"), groups.drop("n"), "payload_digest", hot=hot)).drop("repeats")
    typed = typed.withColumn("refers_to", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")))
    typed = typed.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
    above = -1
    for most in SIZE_CLASSES:
        if above < largest:
            own = record_text(typed.where(F.col("payload_bytes").between(above + 1, most)), date)
            own.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", max(1, FILE_BYTES // most)).mode("append").text(path)
        above = most
    return groups.drop("n")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one archive; a record that is cut short raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8").split(CRLF)
        if end < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        start, size = end + 4, int(headers["content-length"])
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, data[start : start + size]
        at = start + size + 4


def _page(text: str | None) -> str | None:
    """The page id, as text, of a record's name."""
    m = re.fullmatch(rf"<{ID_PREFIX}(.+)>", text or "")
    return m[1] if m else None


def _read(rows: Iterator[tuple]) -> Iterator[tuple]:
    for (content,) in rows:
        for headers, block in parse_records(content):
            payload = block.partition(b"\r\n\r\n")[2]
            kind, claimed = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                digest = hashlib.sha1(payload).hexdigest()
                if digest != claimed:
                    raise ValueError(f"payload of {headers['warc-record-id']} doesn't have its digest")
                yield _page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, digest, len(payload), None
            else:
                yield _page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, claimed, None, _page(headers.get("warc-refers-to"))


def read_archives(spark, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to) as read from the archives' bytes.

    Digests and lengths of responses are computed from the payloads; revisits carry none, so their length is null.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    rows = map_rows(files, _read, "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolve_read(records: DataFrame) -> DataFrame:
    """Give every revisit of stored `records` the payload length of the response that it names (null if there is none)."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_n"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    # one row per named response; a response may be named by a third of all records, so hot names are broadcast
    named = revisits.select("refers_to", "payload_digest").distinct()
    lengths = named.join(responses, ["refers_to", "payload_digest"]).groupBy("payload_digest").agg(F.max("_n").alias("payload_bytes"))
    joined = join_unique(revisits, lengths, "payload_digest")
    return records.where("record_type = 'response'").unionByName(joined.select(records.columns))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as archives, read the archives back, and resolve their revisits."""
    path = shared_dir(spark) + "-warc"
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolve_read(written(read_archives(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN g.original IS NOT NULL AND g.original IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.original IS DISTINCT FROM p.page_id THEN g.original END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
