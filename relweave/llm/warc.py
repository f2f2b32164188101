"""WARC archives: writing, reading back, and resolving revisit records by payload digest."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relweave.llm.scratch import clean

#: payloads below this many bytes are always stored in full
LEAST_BYTES = 100
#: records of one archive file at most; the reader takes a file at a time
FILE_RECORDS = 20_000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def mark_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds ``payload_bytes, payload_digest, record_type, refers_to`` to ``(page_id, url, html)``.

    Only headers (id, digest, length) are shuffled by digest, with partial aggregation, so a
    payload shared by a third of all pages costs one small row per task. Of equal payloads of
    at least ``least`` bytes the smallest page id is the response. Null html is an empty payload.
    A row without page id is a response of its own; rows that repeat the smallest id are all
    responses.
    """
    pages = clean(pages, page_id="long", url="string", html="string")
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("*", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    heads = pages.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    firsts = heads.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    later = heads.join(firsts, "payload_digest").filter("page_id > first").select("page_id", "payload_digest", "first").distinct()
    out = pages.join(later.withColumnRenamed("first", "refers_to"), ["page_id", "payload_digest"], "left")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def record_text(page_id: Column, url: Column, digest: Column, kind: Column, refers_to: Column, html: Column) -> Column:
    """One record without the two line ends that close it. A revisit carries an empty block.

    Line ends inside the address are percent-encoded, so that an address can't add a header.
    """
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    block = F.when(kind == "response", F.coalesce(html, F.lit(""))).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", kind), _line("WARC-Record-ID", ident(page_id)),
        F.when(url.isNull(), F.lit("")).otherwise(_line("WARC-Target-URI", safe)), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(kind == "revisit", F.concat(
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", ident(refers_to)))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(block.cast("binary")).cast("string")), F.lit(CRLF), block)


def write_archives(marked: DataFrame, path: str) -> None:
    """Write marked pages as gzip-compressed WARC files; Spark's committer makes retries safe.

    The text writer ends each record with the two line ends that the format asks for.
    """
    text = record_text(*[F.col(c) for c in ("page_id", "url", "payload_digest", "record_type", "refers_to", "html")])
    lines = marked.select(text.alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_READ = "record_id string, url string, record_type string, payload_digest string, refers_to string, payload binary"


def _inflate(data: bytes):
    """Decompressed pieces of a gzip file of one or more members."""
    while data:
        member = zlib.decompressobj(31)
        while data and not member.eof:
            yield member.decompress(data, 1 << 20)
            data = member.unconsumed_tail if not member.eof else member.unused_data


def parse_archive(data: bytes):
    """Records of one archive as ``(headers, block)``, by the length each header states.

    Holds the compressed file, and of the decompressed bytes one record at a time.
    """
    pieces, have = _inflate(data), bytearray()

    def fill(n: int) -> bool:
        while len(have) < n:
            more = next(pieces, None)
            if more is None:
                return False
            have.extend(more)
        return True

    while fill(1):
        at = have.find(b"\r\n\r\n")
        while at < 0:
            if not fill(len(have) + 1):
                raise ValueError("record header does not end")
            at = have.find(b"\r\n\r\n")
        lines = bytes(have[:at]).decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        if not fill(at + 4 + n + 4):
            raise ValueError("record is cut short")
        yield head, bytes(have[at + 4:at + 4 + n])
        del have[:at + 8 + n]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of every archive below ``path``: ids, type, digest, reference and payload.

    A payload whose digest differs from its header raises.
    """

    def parse(batches):
        for b in batches:
            for data in b.column("content"):
                rows: list[tuple] = []
                size = 0
                for head, block in parse_archive(data.as_py()):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                    rows.append((head["WARC-Record-ID"], head.get("WARC-Target-URI"), head["WARC-Type"], digest, head.get("WARC-Refers-To"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, _READ)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split(" ")[0] for f in _READ.split(", ")]
    kinds = [pa.string()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def page_number(record_id: Column) -> Column:
    """The page id inside a record id, null for a page without one."""
    return F.regexp_extract(record_id, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Join each revisit's header to its response by digest and id; payloads stay where they are.

    Returns ``page_id, url, record_type, payload_digest, refers_to, payload_bytes``; a revisit
    takes the payload length of the response it refers to, and raises if there is none.
    """
    heads = records.select(
        page_number(F.col("record_id")).alias("page_id"), "url", "record_type", "payload_digest",
        page_number(F.col("refers_to")).alias("refers_to"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    revisits = heads.filter("record_type = 'revisit'").drop("payload_bytes")
    needed = revisits.select(F.col("refers_to").alias("origin"), "payload_digest").distinct()
    found = heads.filter("record_type = 'response'").select(F.col("page_id").alias("origin"), "payload_digest", "payload_bytes")
    origins = found.join(needed, ["origin", "payload_digest"], "left_semi").distinct()
    whole = F.when(F.col("payload_bytes").isNull(), F.raise_error(F.lit("a revisit has no response"))).otherwise(F.col("payload_bytes"))
    joined = revisits.join(origins, (F.col("refers_to") == F.col("origin")) & (revisits.payload_digest == origins.payload_digest), "left").select(
        "page_id", "url", "record_type", revisits.payload_digest, "refers_to", whole.alias("payload_bytes"))
    return heads.filter("record_type = 'response'").select(*joined.columns).unionByName(joined)
