"""WARC archives of Zstandard frames: one dictionary per archive, one frame per record.

Writing: every task writes its records into archives of about ``ARCHIVE`` payload bytes.  The dictionary is trained
on the first records of the archive and lies in a leading skippable frame; each record is a frame of its own with
its content size and a checksum.  A task returns one manifest row per closed archive; archives that a lost or
repeated task leaves are in no manifest and are never read.  Archive names are unique, so attempts cannot meet.

Of records with one payload of at least ``REVISIT`` bytes, that with the smallest id is the response; the others are
``revisit`` records that carry the HTTP head, the payload digest and the response's record id, not the payload.

Reading: the tasks stream the manifest's archives: dictionary from the skippable frame, then frame by frame.  Checked
are the frame's content size and checksum, the version line, the needed headers, the block's Content-Length, the
closing blank lines, the HTTP Content-Length, the block and payload digests, and the record count of the manifest.
Valid records that hold no page (``warcinfo``, ``request``, ...) are passed over; anything else is a ``WarcError``.

Defined results: a null payload is the empty one, a null url an absent WARC-Target-URI, a line
break in a url its percent code; null ids come after all
others; rows that share the smallest id and the payload are all responses; extra columns are ignored; an empty table
gives an empty result (and no archives).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import steps
from tunewright.session import reliable_checkpoint, scratch_path

ARCHIVE, SAMPLES, DICT_BYTES, REVISIT = 32 << 20, 400, 32 << 10, 100
# Fixed values of the formats: magic numbers, the revisit profile.
SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: record types that hold no page
OTHER_TYPES = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, payload_bytes long"
RECORD = ("page_id long, uri string, record_id string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long, payload binary")


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def record_bytes(page_id: int | None, uri: str | None, payload: bytes, size: int, digest: str, refers_to: int | None,
                 revisit: bool) -> bytes:
    """One WARC record; a revisit's block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
             f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if uri is not None:  # a line break has no place in a header
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                  f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstd.ZstdCompressionDict | None:
    """A dictionary, or None where the samples are too few for one."""
    try:
        return zstd.train_dictionary(DICT_BYTES, [s[:64 << 10] for s in samples])
    except zstd.ZstdError:
        return None


class ArchiveWriter:
    """One archive: holds back the first records until the dictionary is trained."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, name = pafs.FileSystem.from_uri(self.path)
        self.out = fs.open_output_stream(name, compression=None)  # the frames are made here
        self.waiting: list[bytes] = []
        self.held = self.records = self.payload = 0
        self.press: zstd.ZstdCompressor | None = None

    def start(self) -> None:
        own = train(self.waiting)
        self.press = zstd.ZstdCompressor(level=3, dict_data=own, write_checksum=True, write_content_size=True)
        if own is not None:
            data = own.as_bytes()
            self.out.write(SKIP_MAGIC.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data)
        for r in self.waiting:
            self.out.write(self.press.compress(r))
        self.waiting = []

    def add(self, record: bytes, payload: int) -> None:
        self.records += 1
        self.payload += payload
        if self.press is not None:
            self.out.write(self.press.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if len(self.waiting) >= SAMPLES or self.held >= 4 << 20:
            self.start()

    def close(self) -> tuple[str, int, int]:
        if self.press is None:
            self.start()
        self.out.close()
        return self.path, self.records, self.payload


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), size, digest, refers_to, revisit."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha2(body, 256).alias("digest"),
                        F.octet_length(body).cast("long").alias("size"))
    many = rows.where(F.col("size") >= REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(many, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest",
                         F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a record; the manifest of the archives, materialised."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now = [], None
        for b in steps(batches, "payload", 8 << 20):
            for r in b.to_pylist():
                if now is None:
                    now = ArchiveWriter(folder)
                now.add(record_bytes(r["page_id"], r["url"], r["payload"] or b"", r["size"], r["digest"],
                                     r["refers_to"], r["revisit"]), len(r["payload"] or b""))
                if now.payload >= ARCHIVE:
                    made.append(now.close())
                    now = None
        if now is not None:
            made.append(now.close())
        cols = list(zip(*made, strict=True)) if made else [[], [], []]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                               pa.array(cols[2], pa.int64())], names=["path", "records", "payload_bytes"])

    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name, recursive=True)
    rows = with_revisits(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", "size",
                                       "digest", F.col("refers_to").cast("long").alias("refers_to"), "revisit")
    return reliable_checkpoint(rows.mapInArrow(run, MANIFEST))


class _Input:
    """Exact reads from a stream through a buffer; the next frame's end is found from its block headers."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk, self.data, self.at = stream, chunk, b"", 0

    def have(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            more = self.stream.read(max(self.chunk, n))
            if not more:
                return False
            self.data = self.data[self.at:] + more
            self.at = 0
        return True

    def peek(self, place: int, n: int) -> bytes:
        if not self.have(place + n):
            raise WarcError("the archive ends within a frame")
        return self.data[self.at + place:self.at + place + n]

    def take(self, n: int) -> bytes:
        out = self.peek(0, n)
        self.at += n
        return out

    def frame(self) -> bytes | None:
        """The next whole frame, None at the end."""
        if not self.have(1):
            return None
        magic = int.from_bytes(self.peek(0, 4), "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            return self.take(8 + int.from_bytes(self.peek(4, 4), "little"))
        if magic != FRAME_MAGIC:
            raise WarcError(f"no Zstandard frame: {magic:#x}")
        flags = self.peek(4, 1)[0]
        single = flags >> 5 & 1
        n = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        while True:
            block = int.from_bytes(self.peek(n, 3), "little")
            n += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                return self.take(n + 4 * (flags >> 2 & 1))


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"no header: {line[:80]!r}")
        out[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    return out


def _number(headers: dict, name: str) -> int:
    value = headers.get(name)
    if value is None or not value.isdecimal():
        raise WarcError(f"{name} is missing or no number")
    return int(value)


def parse_record(record: bytes) -> dict | None:
    """Split and validate one decoded record; None for a valid record that holds no page (``OTHER_TYPES``)."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no WARC record: {record[:40]!r}")
    h = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"{name} is missing")
    size = _number(h, "content-length")
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {size}; the block and its end have {len(rest)}")
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block's digest differs")
    if h["warc-type"] in OTHER_TYPES:
        return None
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP response")
    length = _number(_headers(http.split(b"\r\n")[1:]), "content-length")
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = h["warc-type"] == "revisit"
    if revisit:
        if payload or h.get("warc-profile") != PROFILE or "warc-refers-to" not in h:
            raise WarcError("a revisit with a payload, or without profile or reference")
        target = _number(h, "refers-to-page-id")
        if h["warc-refers-to"] != record_id(target, digest):
            raise WarcError("a revisit refers to another payload")
    elif h["warc-type"] != "response":
        raise WarcError(f"type {h['warc-type']}")
    elif len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError("the payload's length or digest differs")
    return {"page_id": _page_id(h),
            "uri": h.get("warc-target-uri"),
            "record_id": h["warc-record-id"], "record_type": h["warc-type"], "payload_bytes": length,
            "payload_digest": digest, "refers_to": target if revisit else None,
            "payload": None if revisit else payload}


def _page_id(headers: dict) -> int | None:
    if "page-id" not in headers:
        return None
    try:
        return int(headers["page-id"])
    except ValueError as e:
        raise WarcError("page-id is no number") from e


def read_archive(path: str) -> Iterator[dict]:
    """The records of one archive, streamed."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as stream:
        source, unpress, first = _Input(stream), zstd.ZstdDecompressor(), True
        while (frame := source.frame()) is not None:
            if frame[:4] == SKIP_MAGIC.to_bytes(4, "little") and first:
                data = frame[8:]
                if data[:4] == FRAME_MAGIC.to_bytes(4, "little"):  # the dictionary may itself be a frame
                    data = zstd.ZstdDecompressor().decompress(data)
                unpress = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data))
            elif frame[:4] != FRAME_MAGIC.to_bytes(4, "little"):
                pass  # other skippable frames hold no records
            else:
                try:
                    size = zstd.frame_content_size(frame)
                    if size < 0:
                        record = unpress.decompressobj().decompress(frame)
                    else:
                        record = unpress.decompress(frame)
                except zstd.ZstdError as e:
                    raise WarcError(f"{path}: {e}") from e
                if 0 <= size != len(record):
                    raise WarcError(f"{path}: a frame of {size} bytes gave {len(record)}")
                parsed = parse_record(record)
                if parsed is not None:
                    yield parsed
            first = False


def read_archives(manifest: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """All records of the manifest's archives."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                for r in read_archive(path):
                    rows.append(r)
                    n += 1
                    held += 400 + len(r["payload"] or b"")
                    if held >= batch_bytes:
                        yield pack(rows)
                        rows, held = [], 0
                yield pack(rows)
                if n != records:
                    raise WarcError(f"{path}: {n} records, not {records}")

    return manifest.select("path", "records").mapInArrow(run, RECORD)


def archive_folder(spark) -> str:
    """A new folder for archives in the cluster's shared folder."""
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    return path if "://" in path else "file://" + path.removeprefix("file:")
