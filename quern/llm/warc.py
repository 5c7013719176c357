"""WARC archives compressed record by record with a Zstandard dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import back, filesystem, ids, new_folder, put_file, written

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 65_536
#: A dictionary is trained on pieces of records of about this many bytes in all, spread evenly over the archive.
SAMPLE_BYTES, PIECE_BYTES = 2_000_000, 65_536
ARCHIVE_BYTES = 32_000_000
LEVEL = 3


def train(records: list[bytes]) -> bytes:
    """A dictionary of the archive's records. Where they are too few or too unlike to train one, it is a dictionary of raw
    content: pieces of them, a tenth of their bytes or a record's head at least."""
    total = sum(map(len, records))
    pieces = [r[i : i + PIECE_BYTES] for r in records for i in range(0, len(r), PIECE_BYTES)]
    samples = pieces[:: max(1, -(-total // SAMPLE_BYTES))]
    size = min(DICTIONARY_BYTES, max(512, sum(map(len, samples)) // 10))
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:  # too little that repeats
            pass
    each = max(512, size // max(1, len(samples)))
    return b"".join(s[:each] for s in samples)[:size]


def to_archive(records: list[bytes]) -> bytes:
    """The archive's bytes: the dictionary in a leading skippable frame, then a frame for each record."""
    raw = train(records)
    lead = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)
    return b"".join([lead, *map(pack.compress, records)])


def frame_end(raw: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends: its blocks' headers say how long they are."""
    checksum = zstandard.get_frame_parameters(raw[at : at + 18]).has_checksum
    at += zstandard.frame_header_size(raw[at : at + 18])
    last = 0
    while not last:
        head = int.from_bytes(raw[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)  # a run-length block holds one byte
    return at + 4 * checksum


def from_archive(raw: bytes) -> Iterator[bytes]:
    """The archive's records; each of its bytes is looked at once."""
    magic, n = struct.unpack_from("<II", raw, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame leads the archive")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n])) if n else zstandard.ZstdDecompressor()
    whole, at = memoryview(raw), 8 + n
    while at < len(raw):
        end = frame_end(whole, at)
        yield unpack.decompress(whole[at:end])
        at = end


def urn(page: int) -> str:
    return f"<urn:quern:page:{page}>"


def record(page: int, url: str, payload: bytes, sha1_hex: str, first: int) -> bytes:
    """A WARC/1.1 record: a response with the payload, or a revisit of the page `first` that had it before."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    revisit = page != first
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(first)}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says: page, payload_bytes, payload_digest, record_type, refers_to and the payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    declared = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    number = lambda x: int(x.rpartition(":")[2].rstrip(">"))
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page": number(fields["WARC-Record-ID"]),
        "payload_bytes": declared,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def checked(found: dict) -> dict:
    """A parsed record whose declared length and digest are those of its payload, as read; a revisit has no payload."""
    if found["payload"] is not None:
        got = (len(found["payload"]), base64.b32encode(hashlib.sha1(found["payload"]).digest()).decode())
        if got != (found["payload_bytes"], found["payload_digest"]):
            raise ValueError(f"page {found['page']}: the payload isn't what its record declares")
    return found


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page and return a row for each archive: path, records.

    Of pages with equal payloads of at least `least_bytes` bytes the smallest id is the response and the others revisit
    it. The roles come from a minimum per digest that is combined before the shuffle; a payload crosses one shuffle, by
    its page's id, so that copies of one payload don't meet in a task.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(ids(id_col).alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    firsts = rows.groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    roles = rows.select("page", "sha", F.octet_length("html").alias("size")).join(firsts, "sha").filter((F.col("size") >= least_bytes) & (F.col("page") != F.col("first")))
    roles = roles.select("page", "sha", "first").distinct()
    ready = rows.join(roles, ["page", "sha"], "left").withColumn("first", F.coalesce("first", "page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, size, held = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            path = f"{folder}/part-{part:06d}-{made:05d}.warc.zst"
            path = put_file(path, to_archive(held))
            row = pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)]})
            made, size = made + 1, 0
            held.clear()
            return row

        for batch in batches:
            for page, url, text, sha, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "sha", "first")), strict=True):
                held.append(record(page, url, text.encode(), sha, first))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return ready.select("page", "url", "html", "sha", "first").mapInArrow(run, "path string, records long")


def read_archives(files: DataFrame) -> DataFrame:
    """A row for each record of the archives (path): page, payload_bytes, payload_digest, record_type, refers_to. Length and
    digest of responses are taken anew from the payload and must agree with the record's headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page", "payload_bytes", "payload_digest", "record_type", "refers_to")
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

        def rows(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in zip(names, types, strict=True)], names=list(names))

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    raw = f.read()
                found = []
                for rec in from_archive(raw):
                    got = checked(parse(rec))
                    got.pop("payload")
                    found.append(got)
                    if len(found) == 2000:
                        yield rows(found)
                        found = []
                yield rows(found)

    return files.mapInArrow(run, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page, read from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html counts as empty, a null url as empty. A null id counts as the smallest and comes back as null, also in
    refers_to. Rows that repeat id and payload have the same role. Every archive has a dictionary. Other columns aren't looked at. An empty table gives
    no rows.
    """
    spark = pages.sparkSession
    made = written(write_archives(pages, new_folder(spark, "warc"), least_bytes, id_col, url_col, html_col), "archives")
    files = made.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return read_archives(files).select(back("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))


#: Base32 of the SHA-1: each five bits of the 160 name a letter.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(x, ''), lambda c: CASE c WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), '') AS bits FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT)
         + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
