"""WARC archives: writing with revisits, chunked bodies and segments, and reading back by segment reassembly.

Writing: a page's HTTP response (chunked transfer framing) becomes a WARC/1.1 ``response`` record; of equal payloads
of at least ``min_bytes`` all but one become ``revisit`` records without a body. A block longer than ``segment_bytes``
is cut into a first segment and ``continuation`` records that name the record they continue. Spark's text writer puts
the records into gzip files, so its commit protocol covers retried tasks.

Reading: each archive is decoded as a stream of records. Segments alone are shuffled: grouped by the identifier of
their origin, ordered by segment number, joined as they arrive, checked for gaps and for the total length, and then
freed of the chunked framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.shared import join_checked, stored

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
#: Records a file: with full segments some 256 MB before compression.
FILE_RECORDS = 4096
#: A group of equal payloads is dealt to so many tasks where it meets its response.
SALTS = 32
#: What a task collects before it hands rows on.
BATCH_BYTES = 4 << 20

# Profile, media types and line ends of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http;msgtype=response"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD_END = "\r\n\r\n"
SEGMENTED = ("WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing: hexadecimal length, data, and an empty chunk at the end."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload within chunked framing; chunk extensions and trailers are skipped. ValueError if the frame is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a length")
        size = body[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk without a length")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk shorter than its length")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, without chunked framing where its head declares that."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP head without an end")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r]*\bchunked\b", head) else body


def _uri(url: str) -> str:
    """A header-safe form: control characters and blanks become percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def sha1_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def sha1_hex(label: str | None) -> str | None:
    """Lower-case hex of a ``sha1:`` label, in base 32 or in hex."""
    if not label or not label.startswith("sha1:"):
        return None
    value = label[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _record(headers: dict[str, object], block: bytes) -> bytes:
    """One record up to, not including, its closing empty lines. Headers without a value are left out."""
    lines = [f"{k}: {v}" for k, v in {**headers, "Content-Length": len(block)}.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def _segments(headers: dict[str, object], block: bytes, size: int) -> Iterator[bytes]:
    """The record, or its first segment and the continuations."""
    if len(block) <= size:
        yield _record(headers, block)
        return
    origin, last = headers["WARC-Record-ID"], -(-len(block) // size)
    for number in range(1, last + 1):
        part = block[(number - 1) * size : number * size]
        total = {"WARC-Segment-Total-Length": len(block)} if number == last else {}
        if number == 1:
            yield _record({**headers, "WARC-Segment-Number": 1, **total}, part)
        else:
            own = f"<urn:uuid:{hashlib.sha256(f'{origin}{number}'.encode()).hexdigest()[:32]}>"
            yield _record(
                {
                    "WARC-Type": "continuation", "WARC-Record-ID": own, "WARC-Date": headers["WARC-Date"],
                    "WARC-Target-URI": headers["WARC-Target-URI"], "WARC-Segment-Origin-ID": origin,
                    "WARC-Segment-Number": number, **total,
                },
                part,
            )


def with_originals(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Columns ``page_id, url, payload, digest, original``: the largest id among equal payloads where it is another row's."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    base = base.select("*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("_same"))
    large = F.octet_length("payload") >= min_bytes
    groups = base.where(large).groupBy("_same").agg(F.count("*").alias("_n"), F.max("page_id").alias("original"))
    repeated = stored(groups.where("_n > 1 and original is not null").select("_same", "original"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("_salt")
    joined = join_checked(
        base.select("*", salt), repeated.select("*", salts), ["_same", "_salt"], "left", max_rows=200_000
    )
    revisit = large & F.coalesce(F.col("page_id") != F.col("original"), F.col("original").isNotNull())
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("original")).alias("original"))


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES, date: str = "2024-01-01T00:00:00Z",
    file_records: int = FILE_RECORDS,
) -> None:
    """Write every row of ``pages(page_id, url, html)`` to gzip WARC files in ``folder``; other columns are not read.

    Of equal payloads of at least ``min_bytes``, the rows of the largest page id are responses (all of them, if rows
    repeat that id), the others revisits; a null id is smaller than any, and payloads that only null ids hold are all
    responses. A null text is an empty payload, a null url leaves the header out. Equal means equal SHA-256.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, out, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page, url, payload, digest, original in zip(*(b.column(i) for i in range(5))):
                page, url, digest, original = page.as_py(), url.as_py(), digest.as_py(), original.as_py()
                name = hashlib.sha256(f"{part}:{n}:{page}:{digest}".encode()).hexdigest()[:32]
                headers = {
                    "WARC-Type": "response" if original is None else "revisit",
                    "WARC-Record-ID": f"<urn:uuid:{name}>",
                    "WARC-Date": date,
                    "WARC-Target-URI": None if url is None else _uri(url),
                    "WARC-Payload-Digest": sha1_label(digest),
                    "X-Page-ID": page,
                    "Content-Type": RESPONSE_TYPE,
                }
                block = HTTP_HEAD
                if original is None:
                    block += chunked(payload.as_py())
                else:
                    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Truncated": "length"}
                n += 1
                for record in _segments(headers, block, segment_bytes):
                    out.append(record)
                    size += len(record)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = with_originals(pages, min_bytes).mapInArrow(run, "record binary")
    writer = records.select(F.col("record").cast("string")).write.option("lineSep", RECORD_END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", file_records).text(folder)


RECORD = "type string, id string, origin string, number int, total long, uri string, page_id long, label string, block binary, problem string"
_ARROW = pa.schema(
    [
        ("type", pa.string()), ("id", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()),
        ("uri", pa.string()), ("page_id", pa.int64()), ("label", pa.string()), ("block", pa.binary()), ("problem", pa.string()),
    ]
)


def parsed(stream: io.BufferedIOBase, segments: bool) -> Iterator[tuple]:
    """``RECORD`` rows of one decompressed archive: only segments, or only whole records. Broken ends become a row."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield (None,) * 9 + ("bytes that are no record",)
            return
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        block = stream.read(int(length)) if length.isdigit() else b""
        number, origin, total = (headers.get(h.lower()) for h in SEGMENTED)
        short = not length.isdigit() or len(block) < int(length)
        if (number is not None) == segments and headers.get("warc-type") != "warcinfo":
            page = headers.get("x-page-id")
            yield (
                headers.get("warc-type"), headers.get("warc-record-id"), origin or headers.get("warc-record-id"),
                int(number) if number else None, int(total) if total else None, headers.get("warc-target-uri"),
                int(page) if page else None, sha1_hex(headers.get("warc-payload-digest")), block,
                "block shorter than its length" if short else None,
            )
        if short:
            return


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[8] or b"") + 256
        if size > BATCH_BYTES:
            yield _rows(out)
            out, size = [], 0
    yield _rows(out)


def read_records(spark: SparkSession, folder: str, segments: bool) -> DataFrame:
    """``RECORD`` rows of all archives in ``folder``: the segments, or the records that are whole."""
    files = spark.read.format("binaryFile").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for x in b.column(0):
                    with gzip.GzipFile(fileobj=io.BytesIO(x.as_buffer())) as f:
                        yield from parsed(io.BufferedReader(f), segments)

        yield from _batched(rows())

    return files.mapInArrow(run, RECORD)


def joined(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Whole records from segments that come ordered by origin and number; a faulty one has a problem and no block."""

    def whole(group: list[tuple]) -> tuple:
        first, last = group[0], group[-1]
        size = sum(len(g[8] or b"") for g in group)
        problem = next((g[9] for g in group if g[9]), None)
        if [g[3] for g in group] != list(range(1, len(group) + 1)):
            problem = problem or "segments missing or repeated"
        elif last[4] != size:
            problem = problem or "total length differs"
        block = None if problem else b"".join(g[8] for g in group)
        return (*first[:3], None, last[4], *first[5:8], block, problem)

    group: list[tuple] = []
    for row in parts:
        if group and group[0][2] != row[2]:
            yield whole(group)
            group = []
        group.append(row)
    if group:
        yield whole(group)


def reassembled(segments: DataFrame) -> DataFrame:
    """Segments shuffled by origin, sorted by number and joined; a task holds one record's segments at a time."""
    dealt = segments.repartition("origin").sortWithinPartitions("origin", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(joined(tuple(r.values()) for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist()))

    return dealt.mapInArrow(run, RECORD)


def payloads(records: DataFrame) -> DataFrame:
    """``(type, id, uri, page_id, label, payload, problem)``: the HTTP body of each whole response, unchunked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, problems = [], []
            for kind, block, problem in zip(b.column(0), b.column(8), b.column(9)):
                body, problem = None, problem.as_py()
                if problem is None and kind.as_py() == "response":
                    try:
                        body = http_payload(block.as_py())
                    except ValueError as e:
                        problem = str(e)
                bodies.append(body)
                problems.append(problem)
            kept = [b.column(i) for i in (0, 1, 5, 6, 7)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(bodies, pa.binary()), pa.array(problems, pa.string())],
                ["type", "id", "uri", "page_id", "label", "payload", "problem"],
            )

    return records.mapInArrow(run, "type string, id string, uri string, page_id long, label string, payload binary, problem string")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(type, id, uri, page_id, label, payload, problem)``: every response and revisit of the archives, whole.

    ``label`` is the payload digest that the record states (hex SHA-1). A payload that differs from it, a broken frame,
    a cut record, missing segments or a wrong total length leave a ``problem``; no row is dropped for it.
    """
    every = payloads(read_records(spark, folder, False)).unionByName(payloads(reassembled(read_records(spark, folder, True))))
    differs = F.col("problem").isNull() & F.col("payload").isNotNull() & (F.sha1("payload") != F.col("label"))
    return every.withColumn("problem", F.when(differs, F.lit("payload differs from its digest")).otherwise(F.col("problem")))


def resolved(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``: revisits with the response they stand for.

    A revisit meets its response by payload digest; digests that are revisited are few rows, so each is repeated per
    salt and a large group of revisits is dealt to as many tasks. A revisit without a response has null lengths.
    """
    slim = stored(
        records.where("type is not null").select(
            "page_id", "type", F.octet_length("payload").cast("long").alias("size"),
            F.coalesce(F.sha1("payload"), F.col("label")).alias("digest"),
        )
    )
    asked = slim.where("type = 'revisit'").select("digest").distinct()
    answers = slim.where("type = 'response' and size is not null").join(asked, "digest", "left_semi")
    known = answers.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.max("size").alias("_size"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("_salt")
    revisits = slim.where("type = 'revisit'").select("*", salt).join(known.select("*", salts), ["digest", "_salt"], "left")
    done = revisits.select("page_id", F.col("_size").alias("size"), "digest", "type", "refers_to")
    whole = slim.where("type = 'response'").select("page_id", "size", "digest", "type", F.lit(None).cast("long").alias("refers_to"))
    names = {"size": "payload_bytes", "digest": "payload_digest", "type": "record_type"}
    return whole.unionByName(done).withColumnsRenamed(names)
