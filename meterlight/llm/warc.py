"""WARC archives in Zstandard frames: writing them, and reading them back with checks.

An archive begins with a skippable frame that holds the dictionary; then each record is a frame of its own,
so that a reader can start at any record. Tasks write and read archives through ``pyarrow.fs``, as streams. A file
appears under its final name only when it is whole, and under the same name whenever its task runs again.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_counted, kept, shared_folder

# Frame magics, the version line, and the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
ID = "urn:page:"
CHUNK = 1 << 20


class WarcError(ValueError):
    """An archive or a record that isn't as it should be; says which and where."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def get(self, name: str) -> str | None:
        return self.headers.get(name.lower())


def write_dictionary(raw: bytes) -> bytes:
    """The leading skippable frame."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _exactly(f: io.RawIOBase, n: int, what: str) -> bytes:
    parts = []
    while n:
        part = f.read(n)
        if not part:
            raise WarcError(f"{what}: the archive ends {n} bytes early")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def read_frames(f: io.RawIOBase, name: str) -> Iterator[bytes]:
    """What each frame holds. The dictionary comes from the leading skippable frame, itself compressed or not; other skippable frames are passed over."""
    pending = f.read(8)
    context = zstandard.ZstdDecompressor()
    if len(pending) == 8:
        magic, n = struct.unpack("<II", pending)
        if magic == DICTIONARY_MAGIC:
            raw = _exactly(f, n, name)
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            if raw:
                context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            pending = b""
    at = 0
    while True:
        if len(pending) < 8:
            pending += f.read(CHUNK)
        if not pending:
            return
        magic = struct.unpack("<I", pending[:4])[0] if len(pending) >= 4 else 0
        if magic >> 4 == 0x184D2A5:
            if len(pending) < 8:
                pending += _exactly(f, 8 - len(pending), name)
            n = struct.unpack("<I", pending[4:8])[0]
            pending = pending[8:]
            while n > len(pending):
                n -= len(pending)
                pending = f.read(CHUNK)
                if not pending:
                    raise WarcError(f"{name}: the archive ends in a skippable frame")
            pending = pending[n:]
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"{name}: record {at} doesn't start with a frame")
        one, out = context.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(pending))
            except zstandard.ZstdError as e:
                raise WarcError(f"{name}: record {at}: {e}") from e
            if one.eof:
                pending = one.unused_data
                break
            pending = f.read(CHUNK)
            if not pending:
                raise WarcError(f"{name}: record {at} is cut short")
        yield b"".join(out)
        at += 1


def parse_record(raw: bytes, what: str = "record") -> Record:
    """One record, checked: version, needed headers, type, length, what follows the block, and digests."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise WarcError(f"{what}: no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in b" \t" and last:  # a folded header
            headers[last] += " " + line.strip().decode()
            continue
        name, colon, value = line.decode("utf-8", "strict").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{what}: bad header line {line[:80]!r}")
        last = name.lower()
        headers[last] = value.strip()
    record = Record(headers, b"")
    for name in NEEDED:
        if record.get(name) is None:
            raise WarcError(f"{what}: no {name}")
    if record.get("WARC-Type") not in TYPES:
        raise WarcError(f"{what}: unknown type {record.get('WARC-Type')}")
    length = record.get("Content-Length") or ""
    if not length.isdigit():
        raise WarcError(f"{what}: bad Content-Length {length!r}")
    n = int(length)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"{what}: the block has {len(rest) - 4} bytes and Content-Length says {n}")
    record.block = rest[:n]
    _digest(record, "WARC-Block-Digest", record.block, what)
    if record.get("WARC-Type") != "revisit":
        _digest(record, "WARC-Payload-Digest", record.block, what)
    elif record.get("WARC-Refers-To") is None or record.get("WARC-Payload-Digest") is None:
        raise WarcError(f"{what}: a revisit that doesn't say of what")
    return record


def _digest(record: Record, name: str, content: bytes, what: str) -> None:
    said = record.get(name)
    if said is not None and said != sha1_label(hashlib.sha1(content).digest()):
        raise WarcError(f"{what}: {name} doesn't match")


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


# As Spark jobs.


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else uri.replace("file:", "file://", 1))


def train_dictionary(pages: DataFrame, payload: str = "html", rows: int = 400, size: int = 32 << 10, longest: int = 16 << 10) -> bytes:
    """A dictionary fitted on at most ``rows`` payloads, each cut at ``longest`` bytes before they are sent; empty if these are too few or too short."""
    some = pages.select(F.substring(payload, 1, longest).alias("p")).where("p <> ''").limit(rows).collect()
    samples = [r.p.encode()[:longest] for r in some]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def decided(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", least: int = 1000) -> DataFrame:
    """``id, url, payload, sha1, of``: ``id`` names the row's record, ``of`` that of the response that the row revisits, or is null.

    Among equal payloads of ``least`` bytes and more, one row with the largest key is the response and all others revisit
    it; null keys are smaller than all. Repeated keys have records of their own, as an id holds the row's number too:
    ``pages`` must read its rows in the same partitions again, as files do. Null payloads are empty.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    name = F.concat(F.lit(ID), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.monotonically_increasing_id().cast("string"))
    rows = pages.select(name.alias("id"), F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).alias("bytes"), F.sha1(body).alias("sha1"))
    long = F.col("bytes") >= least
    groups = kept(rows.where(long).groupBy("sha1").agg(F.max(F.struct("key", "id")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = groups.agg(F.sum("n")).first()[0]
    out = ["id", "url", "payload", "sha1"]
    none = F.lit(None).cast("string").alias("of")
    if not total:
        return rows.select(*out, none)
    # other rows don't meet the groups: they are alone
    many = join_counted(rows.where(long), groups, "sha1", "n", total).select(*out, F.when(F.col("id") != F.col("first.id"), F.col("first.id")).alias("of"))
    few = rows.where(~long).unionByName(rows.where(long).join(groups.select("sha1"), "sha1", "left_anti").select(*rows.columns))
    return many.unionByName(few.select(*out, none))


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, level: int = 3, archive_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of the rows of ``decided`` in ``folder``; returns ``path, records`` of each. Each task writes its own files, none over ``archive_bytes`` by more than a record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _file_system(folder)
        part = TaskContext.get().partitionId()
        own = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        paths, counts = [], []
        out = temporary = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                fs.move(temporary, f"{root}/{paths[-1]}")
                out = None

        for batch in batches:
            for own_id, url, payload, digest, of in zip(*(batch.column(k) for k in range(5)), strict=True):
                if out is None:
                    paths.append(f"part-{part:05d}-{len(paths):04d}.warc.zst")
                    counts.append(0)
                    temporary = f"{root}/.{paths[-1]}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary, compression=None)
                    out.write(write_dictionary(dictionary))
                body = payload.as_py().encode()
                label = sha1_label(bytes.fromhex(digest.as_py()))
                headers = [
                    ("WARC-Type", "revisit" if of.is_valid else "response"), ("WARC-Record-ID", f"<{own_id.as_py()}>"), ("WARC-Date", date),
                    ("WARC-Target-URI", (url.as_py() or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", label), ("Content-Type", "text/html; charset=utf-8"),
                ]
                if of.is_valid:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{of.as_py()}>"), ("WARC-Payload-Length", str(len(body)))]
                    body = b""
                out.write(own.compress(write_record(headers, body)))
                counts[-1] += 1
                if out.tell() >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p in paths], pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    return kept(rows.select("id", "url", "payload", "sha1", "of").mapInArrow(write, "path string, records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in the column ``path``: ``path, at, id, type, date, url, digest, payload_bytes, refers_to, payload``.

    The digest is bare lower-case hex. A revisit has a null payload, and its payload's length and digest as its headers
    say. Records are decoded one at a time; a bad header, length or digest is an error that names archive and record.
    """
    names = {"path": pa.string(), "at": pa.int64(), "id": pa.string(), "type": pa.string(), "date": pa.string(), "url": pa.string(), "digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.string(), "payload": pa.binary()}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at_path = _file_system(path)
                with fs.open_input_stream(at_path, compression=None) as f:
                    for at, raw in enumerate(read_frames(f, path)):
                        r = parse_record(raw, f"{path}: record {at}")
                        label = r.get("WARC-Payload-Digest")
                        digest = base64.b32decode(label.removeprefix("sha1:")).hex() if label and label.startswith("sha1:") else None
                        revisit = r.get("WARC-Type") == "revisit"
                        length = r.get("WARC-Payload-Length")
                        rows.append((path, at, (r.get("WARC-Record-ID") or "").strip("<>"), r.get("WARC-Type"), r.get("WARC-Date"), r.get("WARC-Target-URI"), digest, (int(length) if length else None) if revisit else len(r.block), (r.get("WARC-Refers-To") or "").strip("<>") or None, None if revisit else r.block))
                        size += len(r.block) + 500
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], list(names))
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], list(names))

    return archives.select("path").mapInArrow(records, "path string, at long, id string, type string, date string, url string, digest string, payload_bytes long, refers_to string, payload binary")


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``pages`` written to archives in ``folder`` and read back."""
    folder = folder or f"{shared_folder(spark)}-warc"
    written = write_archives(decided(pages), folder, train_dictionary(pages))
    n = written.count()
    return read_archives(written.repartition(max(1, n)) if n else written)


def page_key(name: str) -> Column:
    """The page's key in a record's id; null if the page had none."""
    return F.expr(f"try_cast(split_part(substring({name}, {len(ID) + 1}), ':', 1) as bigint)")
