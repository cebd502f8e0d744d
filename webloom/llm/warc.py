"""WARC archives: writing captures, reading records, and assembling transactions.

Each capture is written as a request, a response (or a revisit of an equal payload) and a metadata record, joined by
WARC-Concurrent-To.  Spark's text writer makes the archives: its line separator is the blank lines that end a record,
so any store that Spark can write holds them, and a lost task rewrites its own file.  Reading frames records by their
Content-Length, so no payload can be mistaken for a record's head.

Defined results: a null payload is empty, a null url is an empty target; line ends and other control characters in a url
are percent-encoded; rows that repeat an id, a url and a payload are captures of their own with equal record ids; of rows of
the largest id with one payload, revisits refer to that of the last url in order; an empty table writes no records and
reads back empty; other columns are ignored.  Archives hold `FILE_BYTES` of payloads at most, or one capture, so that a
task reads each whole; a payload may have the 2 GB less its heads that a Spark value may.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import shared_dir, sized, stage

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Payload bytes in one archive at most, where it holds more than one capture, and captures in it.
FILE_BYTES, PER_FILE = 256 << 20, 4_000


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _head(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the blank lines that end it.  Fields whose value is null are left out."""
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\n")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _safe(url: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]", "%20"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(digest, size, head, head_url): of payloads of `least` bytes or more that several rows hold, the row that keeps it."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("head"), _safe(F.col(url_col)).alias("head_url"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    best = F.max(F.when(F.col("head").isNotNull(), F.struct("head", "head_url"))).alias("best")
    return rows.where(F.col("size") >= least).groupBy("digest", "size").agg(best, F.count("*").alias("n")).where("n > 1").select("digest", "size", "best.head", "best.head_url")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 1000, per_file: int = PER_FILE) -> None:
    """Archives of all pages under `path`.  Of equal payloads of `least` bytes or more the largest id is stored.

    Captures are written in classes of payload size, each class with as many to an archive as its largest payloads allow.
    """
    heads = stage(revisits(pages, id_col, url_col, payload_col, least), "heads")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), _safe(F.col(url_col)).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    rows = rows.join(sized(heads, heads.count(), 200), ["digest", "size"], "left")
    again = F.coalesce(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("id")), F.lit(False))
    rest = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    own = _uuid(F.lit("capture"), F.col("id"), F.col("url"), F.col("digest"))
    kept = _uuid(F.lit("capture"), F.col("head"), F.col("head_url"), F.col("digest"))  # the response's own id
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    request = _head("request", [("WARC-Record-ID", _uuid(F.lit("request"), own)), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1), F.lit(END)))
    kind = F.lit("application/http; msgtype=response")
    response = _head("response", [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", kind)], F.concat(http, F.col("payload")))
    revisit = _head("revisit", [("WARC-Record-ID", own), ("WARC-Refers-To", kept), ("WARC-Refers-To-Target-URI", F.col("head_url")), *common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Payload-Digest", digest), ("Content-Type", kind)], http)
    metadata = _head("metadata", [("WARC-Record-ID", _uuid(F.lit("metadata"), own)), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")))
    sizes = pages.select(F.octet_length(payload).alias("size")).agg(F.max("size")).first()[0] or 0
    begin, end = -1, FILE_BYTES // per_file
    while begin < sizes or begin < 0:
        some = rows.where((F.col("size") > begin) & (F.col("size") <= end))
        records = some.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))
        records.write.option("lineSep", END).option("maxRecordsPerFile", 3 * max(1, FILE_BYTES // end)).text(f"{path}/upto={end}")
        begin, end = end, 32 * end


RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("record_id", T.StringType()), ("type", T.StringType()), ("concurrent_to", T.StringType()), ("refers_to", T.StringType()),
    ("target", T.StringType()), ("date", T.StringType()), ("content_type", T.StringType()), ("stated_digest", T.StringType()),
    ("fields", T.MapType(T.StringType(), T.StringType())), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("payload", T.BinaryType()),
)])
_ARROW = pa.schema([(n, t) for n, t in zip(RECORD.names, [*[pa.string()] * 8, pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()], strict=True)])


def parse(raw: bytes) -> Iterator[tuple]:
    """The records of an archive, as rows of RECORD.  Raises ValueError where it is cut short or malformed."""
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        if head < 0 or not raw.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in raw[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = raw[head + 4 : head + 4 + size]
        if len(block) < size:
            raise ValueError("the archive is cut short")
        at = head + 4 + size
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        at += 4
        own, payload = {}, None
        if fields.get("content-type", "") == "application/warc-fields":
            own = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
        elif fields.get("warc-type") == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
        named = [fields.get(k) for k in ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-payload-digest")]
        yield (*named, list(own.items()), None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).hexdigest(), payload)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under `path`; sizes and digests are those of the payloads read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                held, size = [], 0
                for record in parse(raw.as_py()):
                    held.append(record)
                    size += len(record[-1] or b"")
                    if size > 8 << 20 or len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, request, response, metadata), joined by the concurrent-to identifier."""
    key = F.coalesce("concurrent_to", "record_id")
    answers = F.col("type").isin("response", "revisit")
    pick = {
        "request": (F.col("type") == "request", ["record_id", "target", "date"]),
        "response": (answers, ["record_id", "type", "target", "date", "content_type", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "payload"]),
        "metadata": (F.col("type") == "metadata", ["record_id", "fields"]),
    }
    found = [F.first(F.when(is_own, F.col(c)), ignorenulls=True).alias(f"{part}_{c}") for part, (is_own, columns) in pick.items() for c in columns]
    joined = records.groupBy(key.alias("capture_id")).agg(F.greatest(F.count_if(answers), F.lit(1)).cast("int").alias("captures"), *found)
    nested = [F.struct(*[F.col(f"{part}_{c}").alias(c) for c in columns]).alias(part) for part, (_, columns) in pick.items()]
    return joined.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("captures")))).select("capture_id", *nested)


def resolve(captures: DataFrame) -> DataFrame:
    """(id, type, payload_bytes, payload_digest, refers_to) of captures: a revisit has its response's size and id."""
    rows = stage(captures.select(F.col("metadata.fields")["id"].alias("id"), *[F.col(f"response.{c}").alias(c) for c in ("record_id", "type", "refers_to", "payload_bytes", "payload_digest")]), "captures")
    sought = rows.where("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    kept = rows.where("type = 'response'").join(sized(sought, sought.count(), 64), "record_id", "left_semi")
    kept = kept.groupBy("record_id").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"), F.first("id").alias("refers_to"))
    names = ["id", "type", "payload_bytes", "payload_digest", "refers_to"]
    responses = rows.where("type = 'response'").select("id", "type", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("refers_to"))
    again = rows.where("type = 'revisit'").select("id", "type", F.col("refers_to").alias("record_id"))
    return responses.unionByName(again.join(kept, "record_id", "left").select(names))


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes archives, by default in the shared folder, and returns the captures read back from them."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **options)
    return assemble(read(spark, path))
