"""WARC archives: write captures, read them back, assemble transactions.

Writing: a page makes three records that stand together, a request, a response (or a
revisit of an earlier equal payload) and a metadata record; the request and the metadata name the
response in ``WARC-Concurrent-To``.  Each record is a gzip member of its own (``.warc.gz``, so readers can go to any record),
and an archive starts with a ``warcinfo`` record.  An archive is closed when it has ``ARCHIVE_BYTES``.

Spark's own text writer puts the archives in the shared folder, one row each, under its commit protocol: a gzip member ends
with the length of its contents as a little-endian 32-bit number, whose last byte is zero under 16 MB, and that
zero byte is the writer's line separator.  A larger last record is cut into members (readers join them).

Only rows whose payload occurs twice need to know of others: their digests are found in a first, narrow pass and
written to the shared folder, so the pages themselves are shuffled only where that table is too large to broadcast.

Reading: whole archives arrive through Spark's binary reader (any store that Spark reads), are
unpacked as they are read and cut by each record's ``Content-Length``, one record at a time.

Assembly: records meet by the identifier they are concurrent to, one nested row per
capture, first inside their archive and, for what has no partner there, over all archives; a revisit then takes its
payload's size and digest from the response it refers to.

Defined results: a null page counts as empty, a null URL as ``urn:unknown``; pages under ``MIN_DUPLICATE``
bytes are never revisits; of equal payloads the smallest page id is the response (null ids last), and
repeated rows of that id are responses too, each a capture of its own; rows without an id are responses unless a
row with one has their payload; page ids are whole numbers; a capture without request or
metadata has null there; an empty table gives no archives and no rows; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, staged, tidy

VERSION = "WARC/1.1"
EOL = "\r\n"
#: Payloads of fewer bytes are stored each time.
MIN_DUPLICATE = 100
#: An archive is closed when it has this many bytes, packed; bounds what a task holds.
ARCHIVE_BYTES = 16 << 20
#: Contents of one gzip member, at most, where the last byte of its length has to be zero.
MEMBER_BYTES = (1 << 24) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "file string, ordinal long, record_id string, type string, concurrent_to string, refers_to string, uri string, "
    "stated_digest string, payload_bytes long, payload_digest string, content string"
)


def record_id(kind: str, page: Column, other: Column | None = None) -> Column:
    """A record's identifier, a UUID that follows from its kind and page (from ``other`` without one)."""
    without = F.lit("null") if other is None else F.concat(F.lit("null|"), other)
    h = F.md5(F.concat(F.lit(kind + "|"), F.coalesce(page.cast("string"), without)).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record's text, without the two line ends after it."""
    size = F.octet_length(block).cast("string")
    head = [F.concat(F.lit(f"{name}: "), value, F.lit(EOL)) for name, value in [*fields, ("Content-Length", size)]]
    return F.concat(F.lit(VERSION + EOL), *head, F.lit(EOL), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page``, ``url``, ``html``, ``digest`` and ``original`` (the page that a revisit repeats, else null)."""
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("urn:unknown")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(F.col(id_col).alias("page"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    rows = rows.withColumn("digest", digest)
    # a row for each payload that occurs twice: copies are counted before they are shuffled
    large = rows.where(F.octet_length("html") >= MIN_DUPLICATE)
    repeated = large.groupBy("digest").agg(F.count("*").alias("n"), F.min("page").alias("first")).where("n > 1").select("digest", "first")
    # written first, so that its size is known and the pages are shuffled only if it is large
    repeated = staged(repeated, "repeated")
    joined = rows.join(repeated, "digest", "left")
    original = F.when(~F.col("page").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.col("first"))
    return joined.select("page", "url", "html", "digest", original.alias("original"))


def transactions(found: DataFrame, date: str) -> DataFrame:
    """Each capture's ``records``, texts of request, capture and metadata; one row per capture."""
    url, page = F.col("url"), F.col("page")
    anonymous = F.concat(F.col("digest"), url)
    stamp, own = F.lit(date), record_id("response", page, anonymous)
    payload = F.concat(F.lit("sha256:"), F.col("digest"))
    path = F.when(url.rlike("^https?://[^/]+/"), F.regexp_replace(url, "^https?://[^/]+", "")).otherwise(F.lit("/"))
    host = F.regexp_extract(url, "^https?://([^/]+)", 1)
    http = F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}")
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", page, anonymous)), ("WARC-Date", stamp), ("WARC-Target-URI", url), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL)),
    )
    response = _record(
        [("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), ("WARC-Date", stamp), ("WARC-Target-URI", url), ("WARC-Payload-Digest", payload), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.lit(EOL), F.col("html")),
    )
    revisit = _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), ("WARC-Date", stamp), ("WARC-Target-URI", url), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id("response", F.col("original"))), ("WARC-Payload-Digest", payload), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.lit(EOL)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", page, anonymous)), ("WARC-Date", stamp), ("WARC-Target-URI", url), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(EOL)),
    )
    capture = F.when(F.col("original").isNull(), response).otherwise(revisit)
    return found.select(F.array(request, capture, metadata).alias("records"))


def member(record: bytes) -> bytes:
    """A record and its two line ends as a gzip member whose last byte is zero (several for a large one)."""
    data = record + b"\r\n\r\n"
    pieces = [data[at : at + MEMBER_BYTES] for at in range(0, len(data), MEMBER_BYTES)]
    out = []
    for piece in pieces:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(piece) + packer.flush())
    return b"".join(out)


def info(date: str) -> bytes:
    """The record that an archive starts with."""
    block = f"software: tessera{EOL}format: WARC File Format 1.1{EOL}".encode()
    head = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return EOL.join([*head, "", ""]).encode() + block


def archives(transactions_: DataFrame, date: str, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Whole archives, one row each, without their last byte, which is zero."""

    def run(batches):
        def closed(parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["value"])

        held: list[bytes] = []
        length = 0
        for batch in batches:
            for n in range(batch.num_rows):
                packed = b"".join(member(r.as_buffer().to_pybytes()) for r in batch.column(0)[n].values.cast(pa.binary()))
                if held and length + len(packed) > size:
                    yield closed(held)
                    held, length = [], 0
                if not held:
                    held = [member(info(date))]
                held.append(packed)
                length += len(packed)
        if held:
            yield closed(held)

    return transactions_.mapInArrow(tidy(run), "value binary")


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", size: int = ARCHIVE_BYTES, **columns: str) -> None:
    """Write archives of the pages into the folder ``path``, each of about ``size`` bytes at most."""
    rows = archives(transactions(captures(pages, **columns), date), date, size)
    text = rows.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    _name_archives(pages.sparkSession, path)


def _name_archives(spark: SparkSession, path: str) -> None:
    """Rename the committed files to what they are; an archive without rows leaves no file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            if status.getLen() == 0:
                fs.delete(status.getPath(), False)
            else:
                fs.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, name.removesuffix(".txt") + ".warc.gz"))


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Contents of a gzip stream of any number of members, piece by piece; other data as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while len(rest):
        one = zlib.decompressobj(31)
        while not one.eof and len(rest):
            fed = rest[:step]
            out = one.decompress(fed)
            rest = rest[len(fed) - len(one.unused_data) :]
            if out:
                yield out
        if not one.eof:
            raise ValueError("the archive is cut short")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record of an archive, gzipped or not; one record is held at a time."""
    pieces = unpacked(data)
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held += piece
        return True

    while True:
        while held[at : at + 2] == b"\r\n":
            at += 2
        if len(held) - at < 5:
            if more():
                continue
            if not held[at:].strip(b"\r\n"):
                return
        if not held.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record: {bytes(held[at : at + 20])!r}")
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("a record's header is cut short")
        fields: dict[str, str] = {}
        for line in held[at:end].decode("utf-8").split(EOL)[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size, skip = int(fields["content-length"]), end + 4 - at
        while len(held) - at < skip + size:
            if not more():
                raise ValueError("a record is cut short")
        yield fields, bytes(held[at + skip : at + skip + size])
        at += skip + size


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives (``.warc``, ``.warc.gz``) in ``path``, ``warcinfo`` records apart.

    ``content`` is a response's payload (null unless ``payload``) or another record's block.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for n, (fields, block) in enumerate(parse(data)):
                    kind, content, size, digest = fields.get("warc-type"), None, None, None
                    if kind == "warcinfo":
                        continue
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                        content = body.decode("utf-8", "replace") if payload else None
                    else:
                        content = block.decode("utf-8", "replace")
                    own = [fields.get(f) for f in ("warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-payload-digest")]
                    rows.append((name, n, own[0], kind, own[1], own[2], own[3], own[4], size, digest, content))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInArrow(tidy(run), RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"ordinal": pa.int64(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, ``request``, ``metadata`` (structs of a record's fields).

    Records meet by the identifier of the response or revisit that they are or that they
    are concurrent to, in their archive first: captures there that share an identifier (pages without an id, repeated
    pages) are told apart by their order, and however many rows share one, a group is no larger than an
    archive.  Requests and metadata without a capture in their archive go to captures of that identifier elsewhere.
    """
    fields = ["file", "ordinal", *[c for c in records.columns if c not in ("file", "ordinal")]]
    one = F.struct(*fields)
    is_capture = F.col("type").isin("response", "revisit")
    keyed = records.withColumn("transaction", F.when(is_capture, F.col("record_id")).otherwise(F.col("concurrent_to")))

    def those(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, one)))

    grouped = keyed.where("transaction is not null").groupBy("transaction", "file").agg(
        those(is_capture).alias("c"), those(F.col("type") == "request").alias("r"), those(F.col("type") == "metadata").alias("m")
    )
    away = grouped.where(F.size("c") == 0).groupBy("transaction").agg(F.min(F.get("r", F.lit(0))).alias("far_r"), F.min(F.get("m", F.lit(0))).alias("far_m"))
    each = grouped.select("transaction", F.posexplode("c").alias("n", "capture"), "r", "m").join(away, "transaction", "left")
    return each.select("capture", F.coalesce(F.get("r", "n"), "far_r").alias("request"), F.coalesce(F.get("m", "n"), "far_m").alias("metadata"))


def resolved(assembled: DataFrame) -> DataFrame:
    """Add ``original`` (the capture that a revisit refers to, itself for a response) to each capture."""
    key = F.coalesce("capture.refers_to", "capture.record_id")
    responses = assembled.where("capture.type = 'response'").select(F.col("capture.record_id").alias("key"), F.struct("capture", "metadata").alias("original"))
    responses = responses.dropDuplicates(["key"])
    # responses take the join's key for even partitions only: captures may share an identifier
    own = F.when(F.col("capture.type") == "response", F.struct("capture", "metadata")).otherwise(F.col("original"))
    return assembled.withColumn("key", key).join(responses, "key", "left").withColumn("original", own).drop("key")


def page_of(metadata: Column) -> Column:
    """The page id that a metadata record states."""
    found = F.regexp_extract(metadata["content"], r"(?m)^pageId: (-?\d+)", 1)
    return F.when(found != "", found).cast("long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    return resolved(assemble(read(spark, path, payload=False)))
