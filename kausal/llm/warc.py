"""WARC archives with segmented records (operator 5).

A payload goes into an HTTP response with chunked transfer framing; a block over the segment size is split into a
first record and continuation records (WARC-Segment-Number, -Origin-ID, -Total-Length). Reading groups the records
of an origin, orders them by number, verifies the total length and takes the chunks' framing off again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, groups_by_key, new_path, prepare, temporary, trimmed

#: Bytes of a record's block, of an HTTP chunk; records of an archive file. A record is its block, a few hundred bytes of
#: headers and the URL, so a file is of at most about SEGMENT * PER_FILE bytes before compression.
SEGMENT, CHUNK, PER_FILE = 16 << 10, 4 << 10, 4000
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int, digest: str, nth: int = 1, segment: int = 1) -> str:
    """Of a page's payload; nth tells apart rows that repeat both."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest}:{nth}:{segment}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None, page_id: int) -> str:
    return "".join(c for c in url or "" if c.isprintable() and c != " ") or f"urn:page:{page_id}"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [f"{len(p):x}\r\n".encode() + p + b"\r\n" for k in range(0, len(payload), size) if (p := payload[k : k + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        begin = end + 2
        if body[begin + size : begin + size + 2] != b"\r\n":
            raise ValueError("a chunk is not ended where its size says")
        out.append(body[begin : begin + size])
        at = begin + size + 2


def records_of(page_id: int, url: str | None, payload: bytes, first: int | None, segment: int = SEGMENT, nth: int = 1) -> list[bytes]:
    """The records of a page; first: the page whose response this one revisits."""
    digest = payload_digest(payload)
    own = record_id(page_id, digest, nth)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", page_id)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if first is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest))]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *more, kind], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1), kind], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, nth, k)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), *total], part))
    return out


def member(record: bytes) -> bytes:
    """A record as a gzip member. Its last byte, the highest of the record's length, is zero under 16 MB."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _payload_key(html: str):
    return F.unhex(F.sha2(F.col(html).cast("binary"), 256))


def _write(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row in zip(*(c.to_pylist() for c in x.columns), strict=True):
                page, url, html, first, nth = row
                out = []
                for r in records_of(page, url, html.encode(), None if first == page else first, segment, nth):
                    data = member(r)
                    if data[-1]:
                        raise ValueError(f"page {page}: a record of over 16 MB; its url has {len(url or '')} characters")
                    out.append(data[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Writes pages (page_id, url, html) as files of at most PER_FILE records, each record a gzip member of its own.

    Of equal payloads of at least least_bytes the smallest page_id is the response, the others revisit it. Null html
    is an empty payload, a null or blank url becomes urn:page:<id>; rows with a null page_id go; of rows that repeat a
    page_id each is written, with a record id of its own, and compared by its own payload: all rows of the smallest
    page_id are responses. Rows of one page_id and payload are numbered in one task. Empty tables write no records; other
    columns are not looked at. The text writer ends every value with the zero that is a member's last byte.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("page_id is not null")
    rows = rows.withColumn("key", _payload_key("html"))
    with temporary(spark):
        keys = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "key")
        revisits = groups_by_key(keys, "key", "page_id", "min").where("page_id <> picked").select("page_id", "key", F.col("picked").alias("first"), F.lit(False).alias("several"))
        repeats = rows.groupBy("page_id", "key").count().where("count > 1").select("page_id", "key", F.lit(None).cast("long").alias("first"), F.lit(True).alias("several"))
        marks = cut(revisits.unionByName(repeats).groupBy("page_id", "key").agg(F.max("first").alias("first"), F.max("several").alias("several")), "marks")
        marked = rows.join(marks, ["page_id", "key"], "left")
        several = F.coalesce("several", F.lit(False))
        nth = F.row_number().over(W.partitionBy("page_id", "key").orderBy("url"))
        numbered = marked.where(~several).withColumn("nth", F.lit(1))
        if not marks.where("several").isEmpty():
            numbered = numbered.unionByName(marked.where(several).withColumn("nth", nth))
        records = numbered.select("page_id", "url", "html", "first", "nth").mapInArrow(trimmed(_write(segment), 64), "value binary")
        records.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", PER_FILE).option("lineSep", "\u0000").text(path)


def members(data: bytes, size: int = 1 << 13) -> Iterator[bytes]:
    """What the members of a gzip file hold, or a file that isn't compressed, in pieces; `size` bytes are looked at a time."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + size] for k in range(0, len(data), size))
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at] == 0:  # padding between members
            at += 1
            continue
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + size]
            at += len(piece)
            if out := z.decompress(piece):
                yield out
        at -= len(z.unused_data)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; holds a record and a piece."""
    held, more = bytearray(), iter(pieces)

    def until(n: int) -> bool:
        while len(held) < n:
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while until(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not until(seen + 1):
                raise ValueError("a record's headers don't end")
        version, *lines = bytes(held[:end]).decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError("no WARC record where one should begin")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        if not until(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is not ended where its length says")
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def _payload(kind: str, block: bytes) -> tuple[int, bytes | None]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    if kind == "revisit":
        return int(fields["content-length"]), None
    payload = unchunked(body) if fields.get("transfer-encoding") == "chunked" else body
    return len(payload), payload


WHOLE = "origin string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string, payload binary"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
#: Whole records have no seg; of segmented ones each segment has its number and block, for the origin to be put together.
READ = WHOLE + ", seg int, total long, block binary"


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])


def _checked(origin: str, page: int | None, kind: str, refers: str | None, digest: str, block: bytes, with_payload: bool) -> tuple:
    """A row of WHOLE; a wrong digest is an error."""
    n, payload = _payload(kind, block)
    if payload is not None and payload_digest(payload) != digest:
        raise ValueError(f"record {origin}: payload digest {payload_digest(payload)}, {digest} announced")
    return origin, page, n, digest, kind, refers, payload if with_payload else None


def _parse(with_payload: bool):
    kinds = [*_KINDS, pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for content in x.column(0):
                held, size = [], 0
                for h, block in parse(members(content.as_py())):
                    kind, num = h["warc-type"], lambda k, h=h: int(h[k]) if k in h else None
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    about = (h.get("warc-segment-origin-id", h["warc-record-id"]), num("warc-page-id"), kind, h.get("warc-refers-to"), h.get("warc-payload-digest", "sha1:")[5:])
                    if (seg := num("warc-segment-number")) is None:
                        held.append((*_checked(*about, block, with_payload), None, None, None))
                        size += 200 + len(block) * with_payload
                    else:
                        origin, page, kind, refers, digest = about
                        held.append((origin, page, None, digest, kind, refers, None, seg, num("warc-segment-total-length"), block))
                        size += 200 + len(block)
                    if size > 8 << 20:
                        yield _batch(held, READ, kinds)
                        held, size = [], 0
                if held:
                    yield _batch(held, READ, kinds)

    return run


def _whole(with_payload: bool):
    """Origins (segments in order, total length) to payloads with lengths and digests; a wrong total or digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for origin, page, kind, refers, digest, total, segs in zip(*(c.to_pylist() for c in x.columns), strict=True):
                numbers = [s["seg"] for s in segs]
                block = b"".join(s["block"] for s in segs)
                if kind is None or numbers != list(range(1, len(segs) + 1)) or (len(segs) > 1 and total != len(block)):
                    raise ValueError(f"record {origin}: segments {numbers} of {len(block)} bytes, {total} announced")
                out.append(_checked(origin, page, kind, refers, digest, block, with_payload))
            yield _batch(out, WHOLE, _KINDS)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit of the archives under path: page_id, payload_bytes, payload_digest, record_type,
    refers_to (the page of the record that a revisit names), and if asked for the payload (null for revisits).

    Files may be gzipped, in one member or many, or not; records of other types are passed over. Records of one origin are
    grouped by their origin's identifier, in whatever files they are, so a payload is whole in one task, as it was in its
    row. A segment that lacks, a wrong total length or digest is an error. A revisit of a record that isn't here refers to null.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    records = cut(files.mapInArrow(trimmed(_parse(with_payload)), READ), "records")
    head = lambda c, name: F.max(F.when(F.col("record_type") != "continuation", F.col(c))).alias(name)
    joined = records.where("seg is not null").groupBy("origin").agg(
        head("page_id", "page_id"), head("record_type", "kind"), head("refers", "refers"), head("payload_digest", "digest"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("seg", "block"))).alias("segs")
    ).mapInArrow(trimmed(_whole(with_payload), 64), WHOLE)
    whole = records.where("seg is null").drop("seg", "total", "block").unionByName(cut(joined, "joined"))
    responses = whole.where("record_type = 'response'")
    asked = whole.where("record_type = 'revisit'").select(F.col("refers").alias("key"), "page_id", F.lit(None).cast("long").alias("target"))
    named = groups_by_key(asked.unionByName(responses.select(F.col("origin").alias("key"), "page_id", F.col("page_id").alias("target"))), "key", "page_id", "min", "target")
    found = named.select(F.col("key").alias("refers"), "page_id", F.col("picked").alias("refers_to")).distinct()
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    revisits = whole.where("record_type = 'revisit'").join(found, ["refers", "page_id"], "left")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(revisits.select(*out))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, upper(sha1(h)) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789ABCDEF', substr(x, i, 1)) - 3, 4)), '') AS bits FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, 5 * i + j + 1, 1)::INT * (16 // (2 ** j)::INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
FROM b
"""
