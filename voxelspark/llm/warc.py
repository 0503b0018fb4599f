"""WARC archives as seekable Zstandard bundles.

Each task packs its records into independent frames of about ``frame_bytes`` and ends every archive with a
seek table in a skippable frame, so one record costs one frame. The index (record to archive, frame and
offset in the frame) is the task's only output: an archive counts once its index rows are committed, and a
repeated task writes a new archive under another name.

Of records with equal payloads of at least ``least`` bytes, that with the largest id holds the payload and
the others are revisit records that name it. Defined cases: a null payload is empty; a null id sorts below
all others and gets no id back; rows that repeat the largest id are responses each; an empty table gives
an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, shared_folder, stored

SKIPPABLE = 0x184D2A5E  # fixed values of the seekable format
SEEKABLE = 0x8F92EAB1
FRAME_BYTES = 1 << 18
ARCHIVE_BYTES = 1 << 28
RUN_FRAMES = 64  # frames in a row that one task reads
PASS_BYTES = 1 << 22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, archive string, frame int, offset long, length long"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and leaves out the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}"] if url else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Header fields, length of the full payload, and the payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields, size, None if fields["WARC-Type"] == "revisit" else body


class Bundle:
    """An archive that is being written: buffered records become one frame each ``frame_bytes``."""

    def __init__(self, folder: str, frame_bytes: int):
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        self.name, self.frame_bytes = f"{uuid.uuid4().hex}.warc.zst", frame_bytes
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)  # frames are compressed here
        self.buffer, self.sizes, self.written = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        if self.buffer and len(self.buffer) + len(data) > self.frame_bytes:
            self.flush()
        place = (self.name, len(self.sizes), len(self.buffer), len(data))
        self.buffer += data
        return place

    def flush(self) -> None:
        frame = zstandard.ZstdCompressor().compress(bytes(self.buffer))
        self.out.write(frame)
        self.sizes.append((len(frame), len(self.buffer)))
        self.written += len(frame)
        self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the frames of an archive by its seek table; the last frame read is kept."""

    def __init__(self, folder: str, archive: str):
        store, path = file_system(folder)
        self.file = store.open_input_file(f"{path}/{archive}")
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{archive} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, end - 9 - 8 * n)))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        self.held, self.data = -1, b""

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.held:
            at, packed, plain = self.frames[frame]
            self.held, self.data = frame, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
        return self.data[offset : offset + length]

    def close(self) -> None:
        self.file.close()


def name_of(key: str | None) -> str:
    return f"urn:page:{key if isinstance(key, str) else uuid.uuid4()}"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, frame_bytes: int = FRAME_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record below ``folder`` and return the stored index."""
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url).alias("url"), text.alias("payload"), F.sha1(text).alias("_d"), F.octet_length(text).alias("_n"))
    large = rows.where(F.col("_n") >= least).select(F.col("_d").alias("_e"), "key").groupBy("_e")
    repeated = stored(large.agg(F.max("key").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"), "repeated")
    tagged = rows.join(broadcast_if_small(repeated), (F.col("_d") == F.col("_e")) & (F.col("_n") >= least), "left")
    target = F.when(F.col("_first").isNotNull() & ~F.col("key").eqNullSafe(F.col("_first")), F.col("_first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for batch in batches:
            out = []
            for key, address, body, refers in zip(batch["key"], batch["url"], batch["payload"], batch["target"]):
                if bundle is None or bundle.written > ARCHIVE_BYTES:
                    if bundle is not None:
                        bundle.close()
                    bundle = Bundle(folder, frame_bytes)
                name = name_of(key)
                data = record(name, address if isinstance(address, str) else None, body.encode(), name_of(refers) if isinstance(refers, str) else None, date)
                out.append((name, *bundle.add(data)))
            yield pd.DataFrame(out, columns=["record_id", "archive", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return stored(tagged.select(F.col("key").cast("string"), "url", "payload", target.cast("string").alias("target")).mapInPandas(run, INDEX), "index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names: header fields, length and digest of the full payload, and the stored payload.

    Every stored payload is checked against its digest. Tasks take runs of frames, go through them in order and pass on
    a few records at a time; without ``payloads`` the column is left out. Filter ``index`` first to fetch single records.
    """
    schema = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    names = [c.split()[0] for c in schema.split(", ")] + ["payload"] * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, archive = None, None
        for batch in batches:
            out, held = [], 0
            for r in batch.itertuples():
                if r.archive != archive:
                    if reader is not None:
                        reader.close()
                    reader, archive = Reader(folder, r.archive), r.archive
                f, size, body = parse(reader.record(r.frame, r.offset, r.length))
                digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if body is not None and (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
                    raise ValueError(f"record {r.record_id} is damaged")
                refers = f["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in f else None
                row = (f["WARC-Record-ID"][1:-1], f.get("WARC-Target-URI"), f["WARC-Type"], refers, size, digest)
                out.append((*row, body) if payloads else row)
                held += len(body or b"") * payloads
                if held > PASS_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)
        if reader is not None:
            reader.close()

    runs = index.repartition("archive", F.floor(F.col("frame") / RUN_FRAMES)).sortWithinPartitions("archive", "frame", "offset")
    return runs.mapInPandas(run, schema + ", payload binary" * payloads)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages``, read the archives back, and return what the records say, without payloads."""
    folder = shared_folder(pages.sparkSession, "warc")
    records = read(write(pages, folder, **options), folder, payloads=False)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
