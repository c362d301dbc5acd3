"""WARC archives, Zstandard-compressed with a dictionary: writer and reader (operator 3).

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame or
plain; then comes one frame for each record. The reader loads the dictionary, decodes frame by frame and validates
the version line, the mandatory headers, the block length, the record's end and the payload digest.

Records with equal payloads are written once as a response, the others as revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from helixmill.llm.common import new_path, passing, prepare

DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: The dictionary is trained on the first records of each archive: so many records and bytes at most.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 20, 32 << 10
#: An archive is closed beyond so many compressed bytes; the reader gets it as one row.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """The archive breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{row}>"


def page_of(urn: str) -> int | None:
    found = urn.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def build(kind: str, urn: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record. A revisit holds the HTTP head alone, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode("utf-8").split("\r\n"):
        name, sep, value = line.partition(":")
        if not sep or not name or name != name.strip():
            raise WarcError(f"no header line: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse(record: bytes) -> dict:
    """The fields of one record, all of it validated."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not sep or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no WARC record: {record[:40]!r}")
    h = _headers(lines)
    if missing := [x for x in MANDATORY if x.lower() not in h]:
        raise WarcError(f"missing headers: {missing}")
    if not h["content-length"].isdigit() or len(rest) != (n := int(h["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest)} bytes, Content-Length {h['content-length']}")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP head")
    said = _headers(http.partition(b"\r\n")[2]).get("content-length", "")
    kind, digest = h["warc-type"], h.get("warc-payload-digest", "")
    if not said.isdigit() or not digest.startswith("sha1:"):
        raise WarcError("no payload length or digest")
    if kind == "response":
        if int(said) != len(payload) or payload_digest(payload) != digest[5:]:
            raise WarcError(f"the payload of {h['warc-record-id']} doesn't match its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in h:
        raise WarcError(f"no response and no valid revisit: {kind}")
    return {"id": h["warc-record-id"], "type": kind, "url": h.get("warc-target-uri"), "digest": digest[5:], "payload_bytes": int(said), "refers_to": h.get("warc-refers-to"), "payload": payload}


def train(sample: list[bytes]) -> bytes:
    """A dictionary from a bounded sample of records; where it is too small to train on, the sample's own bytes."""
    if len(sample) >= 8 and sum(map(len, sample)) >= 4 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(sample)[:DICTIONARY_BYTES]


def archive_start(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order, one decoded frame at a time. Raises WarcError on anything broken."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        raw, at = bytes(view[8 : 8 + n]), 8 + n
        if len(raw) != n:
            raise WarcError("the dictionary frame is cut off")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw)
    made = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if (magic := struct.unpack_from("<I", data, at)[0] if len(data) - at >= 8 else 0) & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]  # other skippable frames
            continue
        if bytes(view[at : at + 4]) != ZSTD_MAGIC:
            raise WarcError(f"no frame at byte {at} ({magic:#x})")
        size = zstandard.frame_content_size(view[at : at + 18])
        one = made.decompressobj()
        try:
            record = one.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise WarcError(f"broken frame at byte {at}: {e}") from e
        if not one.eof or size not in (-1, len(record)):
            raise WarcError(f"the frame at byte {at} is cut off")
        at = len(data) - len(one.unused_data)
        yield parse(record)


def roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, row, digest and `response` (page_id, row) of the record that a row's payload is a response
    in; it is the row itself for responses. Equal payloads are found by SHA-1 and length. Copies are counted
    before the shuffle, and the join is left to the adaptive plan, which splits a skewed digest. `row` is the place in
    the scan, so pages should be a table read from files: then a task that is run again numbers its rows alike."""
    made = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    made = made.withColumns({"digest": F.unhex(F.sha1("html")), "n": F.octet_length("html")})
    largest = made.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max(F.struct("page_id", "row")).alias("response"))
    return made.join(largest, ["digest", "n"], "left").select("page_id", "url", "html", "row", "response")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a record below the folder, an URI that the executors reach.
    Returns (path, records), which must be computed just once: it is the list of whole archives. An archive is
    written under a name of its own attempt, so a task that is run again leaves no mixture, only a file that the
    list doesn't name. Null html is an empty payload; a null page_id never is a response while another row has
    an id; equal rows are separate records."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, made, k = TaskContext.get().partitionId(), [], 0

        def records() -> Iterator[bytes]:
            for b in batches:
                for r in b.to_pylist():
                    payload, best = r["html"].encode(), r["response"]
                    revisit = best is not None and best["row"] != r["row"]
                    yield build("revisit" if revisit else "response", record_id(r["page_id"], r["row"]), r["url"], payload, payload_digest(payload), record_id(best["page_id"], best["row"]) if revisit else None)

        todo, waiting = records(), []
        while True:
            sample, size = waiting, sum(map(len, waiting))
            for x in todo:
                sample.append(x)
                size += len(x)
                if len(sample) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                    break
            if not sample:
                break
            dictionary = train(sample)
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
            path = f"{base}/{part:05d}-{k:04d}-{uuid.uuid4().hex}.warc.zst"
            done, n = 0, 0
            with store.open_output_stream(path, compression=None) as out:
                out.write(archive_start(dictionary))
                for source in (sample, todo):
                    for x in source:
                        frame = packer.compress(x)
                        out.write(frame)
                        n, done = n + 1, done + len(frame)
                        if source is todo and done >= ARCHIVE_BYTES:
                            break
            made.append((path, n))
            waiting, k = [], k + 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rsplit('/', 1)[1]}" for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["path", "records"])

    return roles(pages, min_bytes).mapInArrow(run, "path string, records long")


def read_archives(spark, paths: list[str] | str) -> DataFrame:
    """The records of archives (paths or folders): page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    payload (null in a revisit). An archive, at most ARCHIVE_BYTES and a record, is one task's row."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()))
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for r in read_archive(data.as_py()):
                    rows.append((page_of(r["id"]), r["payload_bytes"], r["digest"], r["type"], page_of(r["refers_to"]) if r["refers_to"] else None, r["url"], r["payload"] if r["type"] == "response" else None))
                    size += len(r["payload"])
                    if size > 8 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [x for x, _ in kinds])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [x for x, _ in kinds])

    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """write_archives() into the shared folder, then read_archives() of what it lists; every record is found again,
    or an error is raised."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    listed = write_archives(pages, folder, min_bytes).collect()  # a row for each archive
    if listed:
        passing(spark, folder)
    else:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
    return read_archives(spark, [r.path for r in listed])
