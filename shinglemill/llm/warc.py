"""WARC/1.1 archives: writing pages as segmented records, and reading them back by segment reassembly.

Written archives are the concatenation of records that the standard asks for. They go through Spark's own writer (a
record is a row, the record terminator is the line separator), so they are committed, and redone after a lost executor,
like any other table, on every store that Spark can write to. A block above ``segment_bytes`` is cut into a first segment and
``continuation`` records. Payloads travel in chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.llm.memory import small_batches, trimmed
from shinglemill.scratch import Scratch

#: Keys of repeated payloads are broadcast up to this many (about 60 bytes each), beyond it joined.
BROADCAST_DIGESTS = 200_000
CRLF = b"\r\n"
_DATE = "2026-01-01T00:00:00Z"


def chunked(payload: bytes, chunk: int = 8192) -> bytes:
    """Chunked transfer framing (RFC 9112, section 7.1)."""
    parts = [b"%x\r\n%s\r\n" % (len(piece), piece) for piece in (payload[i : i + chunk] for i in range(0, len(payload), chunk))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where its framing is broken or cut off."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it; the writer adds them."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(page_id, url, payload: bytes, revisit: bool, segment_bytes: int) -> list[bytes]:
    """The records of a page: a revisit, a response, or a first segment with its continuations."""
    ident, uri = f"<urn:uuid:{uuid.uuid4()}>", "".join((url or "urn:page:unknown").split())
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", ident), ("WARC-Target-URI", uri), ("WARC-Date", _DATE), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("X-Page-ID", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")]
        return [_record(head, http)]
    block = http + chunked(payload)
    head.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        return [_record(head, block)]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([*head, ("WARC-Segment-Number", 1)], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(pieces) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", k), ("WARC-Target-URI", uri), ("WARC-Date", _DATE), *last], piece))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0, segment_bytes: int = 32_768, records_per_file: int = 2_048) -> None:
    """Writes a record for every page, null html as an empty payload.

    Of pages with equal payloads of at least ``least`` bytes that with the largest id is a response and the others are
    revisits; rows that repeat that id are responses too, and a null id revisits any other. An empty table gives archives
    without records. Files stay below
    ``segment_bytes * records_per_file`` bytes and headers, whatever a page holds.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.unhex(F.sha1(body)).alias("digest"))
    keys = rows.filter(F.octet_length("payload") >= least).select("id", "digest")
    repeated = keys.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("_digest"), "top")
    scratch = Scratch(pages.sparkSession, "warc-digests")
    repeated = scratch.keep(repeated, "repeated")
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, rows["digest"] == repeated["_digest"], "left").select("id", "url", "payload", F.coalesce(~F.col("id").eqNullSafe(F.col("top")) & F.col("top").isNotNull(), F.lit(False)).alias("revisit"))

    def build(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += records_of(row["id"], row["url"], row["payload"], row["revisit"], segment_bytes)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = rows.mapInArrow(trimmed(build), "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).mode("errorifexists").text(path)
    scratch.drop("repeated")


def parse(data: bytes):
    """``(headers with lower-case names, block)`` of every record of an archive; ValueError where one is broken."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        if start + size > len(data) or data[start + size : start + size + 4] not in (b"\r\n\r\n", b""):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, data[start : start + size]
        at = start + size + 4


_RAW = "rid string, type string, id long, url string, digest string, origin string, number int, total long, block binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, record_type, payload, payload_digest, status)`` of every response and revisit under ``path``.

    Segments are grouped by the id of their first record, put in order of their number and joined; ``status`` is ``ok``,
    or ``incomplete`` (a segment is missing, repeated, or the total length differs), ``framing`` (broken transfer framing) or
    ``digest`` (the payload isn't that of its header), where the payload is null. A revisit has no payload of its own.
    A record that was never cut takes no part in the shuffle. Archives without records give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")

    def split(batches):
        names = [x.split()[0] for x in _RAW.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        num = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column(0):
                out = []
                for h, block in parse(content.as_py()):
                    kind, rid = h.get("warc-type"), h.get("warc-record-id")
                    origin = h.get("warc-segment-origin-id") or (rid if "warc-segment-number" in h else None)
                    out.append((rid, kind, num(h, "x-page-id"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, origin, num(h, "warc-segment-number"), num(h, "warc-segment-total-length"), block))
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    raw = files.mapInArrow(trimmed(split), _RAW)
    head = F.struct("type", "id", "url", "digest")
    cut = raw.filter("origin is not null").groupBy("origin").agg(
        F.first(F.when(F.col("number") == 1, head), ignorenulls=True).alias("head"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts")
    )
    whole = raw.filter("origin is null and type in ('response', 'revisit')").select(head.alias("head"), F.lit(None).cast("long").alias("total"), F.array(F.struct(F.lit(1).alias("number"), "block")).alias("parts"))
    rows = whole.unionByName(cut.select("head", "total", "parts")).filter("head is not null").select("head.*", "total", F.col("parts.number").alias("numbers"), F.col("parts.block").alias("blocks"))

    def decode(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("status", pa.string())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload, status, block = None, "ok", b"".join(r["blocks"])
                if r["numbers"] != list(range(1, len(r["numbers"]) + 1)) or (len(r["numbers"]) > 1 and r["total"] is None) or (r["total"] is not None and r["total"] != len(block)):
                    status = "incomplete"
                elif r["type"] == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    try:
                        payload = dechunk(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body
                        if r["digest"] and sha1_base32(payload) != r["digest"]:
                            payload, status = None, "digest"
                    except ValueError:
                        status = "framing"
                out.append({"page_id": r["id"], "url": r["url"], "record_type": r["type"], "payload": payload, "payload_digest": r["digest"] or (payload is not None and sha1_base32(payload)) or None, "status": status})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(decode, "page_id long, url string, record_type string, payload binary, payload_digest string, status string")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, status)``: a revisit has the length of the response
    with its digest and refers to that response's largest id; without such a response both are null and its status is
    ``unresolved``."""
    narrow = records.select("page_id", "record_type", "payload_digest", "status", F.octet_length("payload").cast("long").alias("bytes"))
    narrow = Scratch(records.sparkSession, "warc-read").keep(narrow, "records")
    full = narrow.filter("record_type = 'response' and status = 'ok'").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "status")
    bad = narrow.filter("record_type = 'response' and status <> 'ok'").select("page_id", F.lit(None).cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "status")
    revisits = narrow.filter("record_type = 'revisit'").select("page_id", F.col("payload_digest"), "record_type", "status")
    wanted = full.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    seen = revisits.join(wanted, "payload_digest", "left").withColumn("status", F.when(F.col("payload_bytes").isNull(), "unresolved").otherwise(F.col("status")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status"]
    return full.select(columns).unionByName(bad.select(columns)).unionByName(seen.select(columns))


def op9_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve_revisits(read_archives(spark, path))


#: The same by SQL; base32 takes the digest five bits at a time.
ORACLES = {
    "op9_warc_reassembly": """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, lower(sha1(body)) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', h[i]) - 1) + 1, 4)), '') AS bits FROM d),
x AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: (bits[5 * k + j + 1] = '1')::INT * (16 >> j)))::BIGINT, 1)), '') AS payload_digest FROM b),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to, 'ok' AS status FROM t""",
}
QUERIES = {"op9_warc_reassembly": op9_warc_reassembly}
