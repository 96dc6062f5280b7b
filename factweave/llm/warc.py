"""WARC archives as seekable Zstandard bundles (operator 7).

Records are grouped into independent Zstandard frames; a bundle is a run of frames closed by a skippable frame
with the seek table (compressed and plain size of every frame), so a reader decompresses one frame to reach one
record. An index maps record ids to (bundle, frame, offset in the frame, length); `read_archives` finds every record by
its entry there. Bundles are rows of a Parquet table in the shared folder: Spark commits the write, and a lost task
only writes its bundles again; `save_bundle` stores one as an ordinary .warc.zst file.

Records of equal payloads of at least `min_revisit` bytes: the one with the smallest id is a response, the
others are revisit records without payload that name it. Who is first is found on digests alone (combined
before the shuffle, so a payload shared by very many records costs one row a task); payloads move once, and those of
one digest are dealt to SALTS tasks, to which its one row is copied.

Defined cases: a null html is the empty payload; null ids sort behind all others and are written without one;
rows with equal ids and equal payloads are alike, all responses or all revisits; an empty table gives no bundles;
payloads of any length are whole in one frame; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, give_back, written

#: The seekable format's skippable-frame magic and its footer's magic.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, BUNDLE_RECORDS = 1 << 20, 16 << 20, 20_000
MIN_REVISIT = 100
SALTS = 32


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record. digest and size are those of the full payload, also for a revisit, whose block is empty."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{page_id}:{digest}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    block = b"" if kind == "revisit" else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, position behind the record) of the record at a position."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + n], end + 8 + n


class BundleWriter:
    """Collects records into frames; finish() gives the bundle and (id, frame, offset, length) of its records."""

    def __init__(self, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self._zstd, self._most = zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self._open: list[bytes] = []
        self._plain, self.size = 0, 0
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self.index: list[tuple] = []

    def add(self, page_id, raw: bytes) -> None:
        self.index.append((page_id, len(self._frames), self._plain, len(raw)))
        self._open.append(raw)
        self._plain += len(raw)
        if self._plain >= self._most:
            self._close()

    def _close(self) -> None:
        if self._open:
            frame = self._zstd.compress(b"".join(self._open))
            self._sizes.append((len(frame), self._plain))
            self._frames.append(frame)
            self.size += len(frame)
            self._open, self._plain = [], 0

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, FOOTER)
        return b"".join([*self._frames, struct.pack("<II", SKIPPABLE, len(table)), table])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame, from the bundle's footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    row = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - n * row, []
    start = 0
    for i in range(n):
        c, d = struct.unpack_from("<II", bundle, at + i * row)
        out.append((start, c, d))
        start += c
    return out


def frame_of(bundle: bytes, table: list[tuple[int, int, int]], k: int) -> bytes:
    start, c, d = table[k]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + c], max_output_size=d)


def fetch_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle by its index entry; decompresses one frame."""
    head, block, _ = parse(frame_of(bundle, seek_table(bundle), frame), offset)
    return head, block


def save_bundle(bundle: bytes, path: str) -> None:
    with open(path, "wb") as f:
        f.write(bundle)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages as WARC bundles; returns the table (bundle, payload, index) in the shared folder."""
    body = pages.select(pages[id_col].cast("bigint").alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("p")).withColumn("digest", F.sha2("p", 256))
    first = body.where(F.length("p") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where((F.col("c") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("d"), "first")
    last = F.lit((1 << 63) - 1)
    first = first.select("d", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS))
    rows = body.join(first, (body["digest"] == first["d"]) & (salt == first["salt"]), "left").select("id", "url", "p", "digest", F.when(F.col("first") < F.coalesce("id", last), F.col("first")).alias("refers"))

    def write(batches):
        out, n = BundleWriter(), 0

        def flush():
            raw = out.finish()
            index = [dict(zip(("id", "frame", "offset", "length"), x)) for x in out.index]
            kind = pa.list_(pa.struct([("id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([raw], pa.binary()), pa.array([index], kind)], ["bundle", "payload", "index"])

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(each(c) for c in b.columns)):
                kind = "response" if refers is None else "revisit"
                raw = record(kind, page_id, url, payload, digest, len(payload), refers)
                out.add(page_id, raw)
                n += 1
                if out.size >= BUNDLE_BYTES or n >= BUNDLE_RECORDS:
                    yield flush()
                    out, n = BundleWriter(), 0
        if n:
            yield flush()
        give_back()

    schema = "bundle string, payload binary, index array<struct<id: bigint, frame: int, offset: bigint, length: bigint>>"
    return written(rows.mapInArrow(write, schema), "warc")


def read_archives(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the bundles alone. Each
    record is found by its index entry: the frame by the seek table, decompressed once for all its entries, and the
    record by its offset there. The digest and size of a response are taken of its block, and must equal its headers."""

    def read(batches):
        for b in batches:
            for raw, index in zip(each(b.column(0)), each(b.column(1))):
                table = seek_table(raw)
                for k, entries in itertools.groupby(sorted(index, key=lambda x: (x["frame"], x["offset"])), key=lambda x: x["frame"]):
                    data, rows = frame_of(raw, table, k), []
                    for entry in entries:
                        head, block, end = parse(data, entry["offset"])
                        if end != entry["offset"] + entry["length"] or head.get("X-Page-Id") != (None if entry["id"] is None else str(entry["id"])):
                            raise ValueError(f"the index doesn't fit the record of page {entry['id']}")
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response" and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, size):
                            raise ValueError(f"damaged record of page {head.get('X-Page-Id')}")
                        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                        rows.append((None if page is None else int(page), size, digest, head["WARC-Type"], None if refers is None else int(refers)))
                    cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("payload", "index").mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def record_index(bundles: DataFrame) -> DataFrame:
    """(id, bundle, frame, offset, length) of every record: where fetch_record finds it."""
    return bundles.select("bundle", F.explode("index").alias("i")).select("i.id", "bundle", "i.frame", "i.offset", "i.length")

