"""WARC archives: written as one gzip stream, normalised to a member per record, read by offset.

Archives are files in the session's shared folder, opened through ``pyarrow.fs`` by URI. File names
hold an id of the task attempt, and only the manifest of the attempt that Spark accepted names
them, so a lost or repeated task leaves at most unnamed files.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.session import scratch_path, stage

#: Bytes of records after which an archive is closed and the next begun.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
_READ = 1 << 18
_LEVEL = 6
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "path string, n_records long, n_bytes long"
NORMALISED = "path string, sidecar string, n_records long"
INDEX = "path string, offset long, length long, record_id string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to): of equal payloads of at least REVISIT_BYTES
    the largest page_id is kept, others refer to it; refers_to is NULL for what is stored."""
    digested = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("payload_digest", F.sha1("html"))
    long_ones = digested.filter(F.octet_length("html") >= REVISIT_BYTES)
    kept = long_ones.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "kept")
    kept = stage(kept, "warc-kept")
    return digested.join(kept, "payload_digest", "left").withColumn(
        "refers_to", F.when((F.octet_length("html") >= REVISIT_BYTES) & ~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))
    ).select("page_id", "url", "html", "payload_digest", "refers_to")


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def _new_file(folder: str, suffix: str) -> str:
    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}{suffix}"


def _open(path: str, how: str):
    system, local = fs.FileSystem.from_uri(path)
    if how == "w":
        system.create_dir(local.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(local, compression=None)
    return system.open_input_stream(local, compression=None) if how == "r" else system.open_input_file(local)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, payload_digest, refers_to) as archives of one gzip stream each;
    the manifest (path, n_records, n_bytes), which is a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, out, packer, n, size = [], None, None, 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    path = _new_file(folder, ".warc.gz")
                    out, packer, n, size = _open(path, "w"), zlib.compressobj(_LEVEL, wbits=31), 0, 0
                record = record_bytes(page_id, url, html.encode(), digest, refers_to)
                out.write(packer.compress(record))
                n, size = n + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    made.append((path, n, size))
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            made.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made) if made else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    return stage(pages.mapInArrow(write, MANIFEST), "warc-manifest")


def stream_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of a gzip stream, inflated once from front to back; only one record is held."""
    inflate, held = zlib.decompressobj(31), bytearray()
    need = None
    for chunk in chunks:
        while chunk:
            held += inflate.decompress(chunk)
            chunk = b""
            if inflate.eof:
                chunk, inflate = inflate.unused_data, zlib.decompressobj(31)
            while True:
                if need is None:
                    at = held.find(_END)
                    if at < 0:
                        break
                    need = at + 4 + int(parse_headers(bytes(held[:at]))["content-length"]) + 4
                if len(held) < need:
                    break
                yield bytes(held[:need])
                del held[:need]
                need = None
    if held:
        raise ValueError(f"the stream ends within a record: {len(held)} bytes left")


def _chunks(path: str) -> Iterator[bytes]:
    with _open(path, "r") as source:
        while chunk := source.read(_READ):
            yield chunk


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``manifest`` with one gzip member per record, beside a sidecar file of
    JSON lines (offset, length, record_id); (path, sidecar, n_records), which is a written table."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = _new_file(folder, ".warc.gz")
                sidecar, at, n = path + ".idx", 0, 0
                with _open(path, "w") as out, _open(sidecar, "w") as index:
                    for record in stream_records(_chunks(source)):
                        packer = zlib.compressobj(_LEVEL, wbits=31)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        name = parse_headers(record[: record.find(_END)])["warc-record-id"]
                        index.write(json.dumps({"offset": at, "length": len(member), "record_id": name}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sidecar]), pa.array([n], pa.int64())], ["path", "sidecar", "n_records"])

    n_files = max(1, manifest.count())
    # In ranges of their names every task gets one archive, where a round-robin deal starts anywhere.
    return stage(manifest.repartitionByRange(n_files, "path").mapInArrow(rewrite, NORMALISED), "warc-normalised")


def _sidecar(path: str) -> Iterator[dict]:
    with _open(path, "r") as source:
        yield from map(json.loads, source.read().splitlines())


def offset_index(archives: DataFrame) -> DataFrame:
    """All sidecars' entries: (path, offset, length, record_id)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sidecar in zip(batch.column("path").to_pylist(), batch.column("sidecar").to_pylist()):
                rows = list(_sidecar(sidecar))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows)), *[pa.array([r[k] for r in rows], t) for k, t in (("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()))]],
                    ["path", "offset", "length", "record_id"],
                )

    return archives.mapInArrow(entries, INDEX)


def read_record(record: bytes) -> tuple:
    """A record as a row of RECORDS; the digest of a stored payload is taken anew and compared."""
    at = record.find(_END)
    head = parse_headers(record[:at])
    block = record[at + 4 : -4]
    split = block.find(_END)
    http, payload = block[:split], block[split + 4 :]
    number = lambda name: int(v) if (v := head.get(name, "<urn:x-page:>")[12:-1]) else None
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return number("warc-record-id"), head.get("warc-target-uri"), size, digest, "revisit", number("warc-refers-to"), None
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
    return number("warc-record-id"), head.get("warc-target-uri"), len(payload), digest, "response", None, payload


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of normalised archives, each inflated alone at its sidecar's offset."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path, sidecar in zip(batch.column("path").to_pylist(), batch.column("sidecar").to_pylist()):
                rows, held = [], 0
                with _open(path, "a") as source:
                    for entry in _sidecar(sidecar):
                        source.seek(entry["offset"])
                        row = read_record(zlib.decompress(source.read(entry["length"]), 31))
                        held += row[2]
                        rows.append(row if payloads else (*row[:-1], None))
                        if held >= _READ * 16 or len(rows) >= 10_000:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    n_files = max(1, archives.count())
    return archives.repartitionByRange(n_files, "path").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) to archives, normalise them; (path, sidecar, n_records).

    NULL html is an empty payload; a NULL url leaves the URI out; a NULL page_id leaves the number
    in the record's id out; rows that repeat the largest page_id of a payload are all stored; empty
    tables give no archive; other columns are not read. A record is held in memory, never a file.
    """
    spark = pages.sparkSession
    manifest = write_monolithic(with_revisits(pages), scratch_path(spark, "warc-monolithic"))
    return normalise(manifest, scratch_path(spark, "warc"))
