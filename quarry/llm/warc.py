"""WARC archives with revisit resolution.

Only headers (id, payload digest, length) are shuffled by digest: of the records with
one payload, that with the largest id stays a response and the others become revisits
that refer to it. The decisions are joined to the pages by id, so no digest brings its
payloads together. Archives are written by Spark's text writer, whose record separator
is the two line ends that close a WARC record; so they go to any file system Spark
writes to, with its commit protocol, as gzip files. They are read back as whole
files, each unpacked and parsed as a stream.

Digests of more than one 256th of the records are at most 256; those are joined by
broadcast, all others by a shuffle whose groups are therefore small.

Defined results: a null page is an empty payload; payloads below ``least`` bytes are
always responses; rows that repeat id and payload of the response are responses too;
rows without an id can only be revisits, or responses if no record has an id; a null
URL gives a record without a target.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import lean, scratch, stored

EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HOT = 256


def headers(pages: DataFrame, html: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("n"))


def revisits(heads: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, digest, refers_to`` of the records that become revisits; ``heads`` is read three times."""
    large = heads.where(F.col("n") >= least)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND refers_to IS NOT NULL")
    hot_from = max(1000, heads.count() // HOT)
    hot = groups.where(F.col("rows") > hot_from).select("digest", "refers_to")
    cold = groups.where(F.col("rows") <= hot_from).select("digest", "refers_to")
    from_hot = large.join(F.broadcast(hot), "digest")  # at most HOT rows
    from_cold = large.join(cold, "digest")
    out = from_hot.unionByName(from_cold)
    return out.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def records(pages: DataFrame, decided: DataFrame, html: str = "html", date: str | None = None) -> DataFrame:
    """One column ``value``: each record without the two line ends that close it."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate("url", "\r\n", "").alias("url"), body.alias("body"), F.unhex(F.sha1(body.cast("binary"))).alias("digest"))
    d = decided.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = rows.join(d, rows.page_id.eqNullSafe(d._id) & (rows.digest == d._digest), "left")
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("body").cast("string"), F.lit(EOL * 2))
    length = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.octet_length("body"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    return rows.select(
        F.concat(
            F.lit(f"WARC/1.1{EOL}"),
            line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
            line("WARC-Date", F.lit(date)),
            F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("digest")))),
            F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(f">{EOL}WARC-Profile: {PROFILE}"))), F.lit("")),
            line("Content-Type", F.lit("application/http;msgtype=response")),
            line("Content-Length", length.cast("string")),
            F.lit(EOL),
            http,
            F.when(is_revisit, F.lit("")).otherwise(F.col("body")),
        ).alias("value")
    )


#: Payloads up to so many bytes are archived with so many records in a file, which is 256 MB at most;
#: of larger ones, a file has 16.
CLASSES = ((1 << 16, 4096), (1 << 20, 256), (None, 16))


def write_archives(pages: DataFrame, path: str, html: str = "html", least: int = 1000, date: str | None = None) -> None:
    """Writes every page to gzip archives below ``path``, one folder for each class of sizes; see ``CLASSES``."""
    heads = stored(headers(pages, html))
    decided = revisits(heads, least)
    size = F.octet_length(F.coalesce(F.col(html), F.lit("")).cast("binary"))
    low = -1
    for most, records_ in CLASSES:
        inside = lambda n: (n > low) & ((n <= most) if most else F.lit(True))  # noqa: B023, E731
        if low < 0 or heads.where(inside(F.col("n"))).limit(1).count():
            chosen = records(pages.where(inside(size)), decided, html, date)
            chosen.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_).text(f"{path}/upto-{most or 'any'}")
        low = most or 0


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields (lower case), HTTP header block and payload of each record in a stream of bytes."""
    held, start = bytearray(), 0

    def need(n: int) -> bool:
        nonlocal held, start
        while len(held) - start < n:
            more = next(chunks, None)
            if more is None:
                return False
            if start:
                del held[:start]
                start = 0
            held += more
        return True

    while True:
        at = held.find(b"\r\n\r\n", start)
        while at < 0:
            if not need(len(held) - start + 1):
                if bytes(held[start:]).strip():
                    raise ValueError("archive ends inside a record")
                return
            at = held.find(b"\r\n\r\n", start)
        first, *lines = held[start:at].decode("utf-8").split(EOL)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at this place: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = at + 4
        n = int(fields["content-length"])
        if not need(n + 4):
            raise ValueError("archive ends inside a record")
        head, _, payload = bytes(held[start : start + n]).partition(b"\r\n\r\n")
        start += n + 4
        yield fields, head, payload


def unpacked(content: bytes | memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """Gzip (any number of members) in pieces; other content as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while at < len(content):
        d = zlib.decompressobj(31)
        while not d.eof and at < len(content):
            piece = content[at : at + step]
            out = d.decompress(piece)
            at += len(piece) - len(d.unused_data)
            if out:
                yield out


def _id(field: str) -> int | None:
    value = field.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record, digests and lengths taken from the payload where the record has it; with ``payload``, also the payload (null in revisits)."""
    schema = RESULT + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                for fields, head, body in parse(unpacked(memoryview(content.as_buffer()).cast("B"))):
                    page = _id(fields["warc-record-id"])
                    declared = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response":
                        row = (page, len(body), hashlib.sha1(body).hexdigest(), "response", None, fields.get("warc-target-uri"), body)
                        if row[2] != declared:
                            raise ValueError(f"record {page}: payload does not match its digest")
                    else:
                        n = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        row = (page, n, declared, "revisit", _id(fields["warc-refers-to"]), fields.get("warc-target-uri"), None)
                    rows.append(row[: len(names)])
                    held += len(body) if payload else 100
                    if held > 4 << 20:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back."""
    path = scratch(pages.sparkSession)
    write_archives(pages, path, least=least)
    return read_archives(pages.sparkSession, path)


#: The query's rows; archives don't show in them.
ORACLE = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, sha1(h) AS digest, CAST(strlen(h) AS BIGINT) AS n FROM p),
top AS (SELECT digest, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest, CASE WHEN top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to, url
FROM d LEFT JOIN top ON top.digest = d.digest AND n >= 1000
"""
