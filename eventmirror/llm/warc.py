"""WARC: write archives with Spark's text writer, normalise their gzip streams, read them back by offset.

Spark's text writer makes one gzip stream per file, which cannot be read from the middle. The
normaliser inflates each stream once, piece by piece, rewrites every record as a gzip member of its own in a new
archive and keeps the member's offset and length in a sidecar index, so any record can be read alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 16
#: Bytes of neighbouring records that are read at once, and of the index rows that are sent on at once.
READ_BYTES, INDEX_ROWS = 4 << 20, 2000
SEP = b"\r\n\r\n"
INDEX = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)
PAYLOADS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 20 bits are five hex digits and four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, keeper: the largest page_id with an equal payload if
    that is another one and the payload has `least_bytes` at least, else null.

    Counts are combined before they are shuffled. Only digests that repeat are joined back, and
    those are spread over salts, so that one very common payload is no single task's work; where its share of a salt is
    still large, adaptive execution splits the left side of this outer join further.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("payload_digest"))
    repeated = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "largest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        .join(repeated, ["payload_digest", "salt"], "left")
        .withColumn("keeper", F.when(F.col("largest") != F.col("page_id"), F.col("largest")))
        .drop("salt", "largest")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", records_per_file: int = 50_000) -> None:
    """Write every page as a WARC response, or as a revisit of the equal payload with the largest
    page_id, into monolithic gzip files under path.

    A null html is an empty payload; a null url gives no target; line breaks in a url are dropped.
    Pages that share page_id and payload are all responses.
    """
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    revisit = F.col("keeper").isNotNull()
    http = F.concat(
        line("HTTP/1.1 200 OK"),
        line("Content-Type: text/html; charset=utf-8"),
        line("Content-Length: ", F.octet_length("payload").cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    rows = with_revisits(pages, least_bytes).withColumn("block", http)
    record = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <urn:page:", page, ">"),
        line("WARC-Date: ", date),
        F.coalesce(line("WARC-Target-URI: ", F.regexp_replace("url", "[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest: sha1:", F.col("payload_digest")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                line("WARC-Refers-To: <urn:page:", F.col("keeper").cast("string"), ">"),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type: application/http;msgtype=response"),
        line("Content-Length: ", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    (
        rows.select(record.alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def folder_of(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a folder that all executors share, by its URI or path."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Archive:
    """A normalised archive being written, and the stream of the one it is made of. It appears under its name when
    it is whole, so a repeated task does no harm."""

    def __init__(self, source: str, where: fs.FileSystem, folder: str):
        self.name = source.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt").removesuffix(".warc") + ".warc.gz"
        self.fs, self.path, self.part = where, f"{folder}/{self.name}", f"{folder}/.{self.name}-{uuid.uuid4().hex}"
        self.sink = where.open_output_stream(self.part, compression=None)
        self.held, self.offset, self.need, self.headers = bytearray(), 0, 0, {}

    def add(self, piece: bytes):
        """The index rows of the records that this piece of the stream ends."""
        self.held += piece
        self.held += SEP
        while True:
            if not self.need:
                end = self.held.find(SEP)
                if end < 0 or not bytes(self.held[:end]).strip():
                    return
                self.headers = _headers(bytes(self.held[:end]))
                self.need = end + 4 + int(self.headers["content-length"]) + 4
            if len(self.held) < self.need:
                return
            member = gzip.compress(bytes(self.held[: self.need]), 6, mtime=0)
            del self.held[: self.need]
            self.need, h = 0, self.headers
            self.sink.write(member)
            yield (self.name, self.offset, len(member), h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"))
            self.offset += len(member)

    def close(self) -> None:
        if self.held.strip():
            raise ValueError(f"the archive {self.name} ends within a record: {bytes(self.held[:80])!r}")
        self.sink.close()
        self.fs.move(self.part, self.path)


def normalise(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Rewrite the gzip archives under path in `folder`, a shared one, with a member per record: the index of them.

    Store the index before it is read: it is the sidecar, and every reading of this DataFrame writes the archives anew. Streams of one
    or many members, of any length, are inflated once by Spark's text reader, in pieces between empty lines that
    are put together again by the records' lengths, so no task holds an archive. Archives of one name must not be mixed.
    """

    def run(batches):
        where, inside = folder_of(folder)
        where.create_dir(inside, recursive=True)
        own, source, out = None, None, []
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != source:
                    if own:
                        own.close()
                    own, source = Archive(name, where, inside), name
                out += own.add(piece.as_py())
                if len(out) >= INDEX_ROWS:
                    yield _batch(out, INDEX)
                    out = []
        if own:
            own.close()
        if out:
            yield _batch(out, INDEX)

    pieces = spark.read.option("lineSep", SEP.decode()).text(path)
    return pieces.select(F.col("_metadata.file_path"), F.col("value").cast("binary")).mapInArrow(run, INDEX)


_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[f.dataType]) for x, f in zip(zip(*rows), schema)], names=schema.names)


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read each record of the index from its archive in `folder` by offset and length, inflate it alone and parse it: the
    page's id, payload facts, and the payload itself. Neighbouring records are read together, READ_BYTES at most.

    Facts of a revisit, whose block has no payload, come from its headers; those of a response are
    computed from the payload and must agree with its header.
    """

    def page(urn: str | None) -> int | None:
        own = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(own) if own.lstrip("-").isdigit() else None

    def parsed(member: bytes) -> tuple:
        record = gzip.decompress(member)
        head, _, rest = record.partition(SEP)
        h = _headers(head)
        http, _, body = rest[: int(h["content-length"])].partition(SEP)
        digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(_headers(http)["content-length"])
        if h["warc-type"] == "response":
            own = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if (own, len(body)) != (digest, size):
                raise ValueError(f"damaged record {h.get('warc-record-id')}")
        return (page(h.get("warc-record-id")), size, digest, h["warc-type"], page(h.get("warc-refers-to")), h.get("warc-target-uri"), body if payloads and h["warc-type"] == "response" else None)

    def run(batches):
        where, inside = folder_of(folder)
        name, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            i = 0
            while i < len(rows):
                archive, start, length = rows[i]
                j, end = i + 1, start + length
                while j < len(rows) and rows[j][:2] == (archive, end) and end + rows[j][2] - start <= READ_BYTES:
                    end += rows[j][2]
                    j += 1
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, where.open_input_file(f"{inside}/{archive}")
                together = memoryview(file.read_at(end - start, start))
                yield _batch([parsed(together[o - start : o - start + n]) for _, o, n in rows[i:j]], PAYLOADS)
                i = j
        if file:
            file.close()

    return index.select("archive", "offset", "length").mapInArrow(run, PAYLOADS)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, sha1(html) AS hex FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT // [32768, 1024, 32, 1][1 + i % 4]) % 32)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM d
"""
