"""WARC records in seekable Zstandard bundles.

Every row of (page_id, url, html) becomes one WARC/1.1 record: a `response` with an HTTP head and the
payload, or, if an equal payload of at least 100 bytes already has its response, a `revisit` without a
body that names that record. Records are grouped into frames of about `frame_bytes`; each frame is
compressed alone, and a bundle ends with a skippable frame that holds the seek table of the public
seekable format (compressed size, size and checksum of every frame, number of frames, magic number).
A bundle carries an index from record identifiers to (frame, offset within the frame, length), so one
record costs one frame. A bundle is one Parquet row of the shared folder, at most about `bundle_bytes`
large, so Spark's commit protocol covers lost executors; `export` writes bundles as files.

Payloads are equal if their SHA-256 is. Of equal payloads the smallest page_id is the response, null
last; among repeated rows of that page_id one is, the one first in the staged table. Rows are numbered
in a written table, so the choice survives retries. Null or empty html is an empty payload; a null url
leaves the target out; bytes of a url that a header cannot hold are percent-encoded; a null page_id
stays null; a very long page makes a frame of its own; an empty table gives no bundles and no rows;
other columns are not read. Payloads of revisits never leave the JVM, and a payload that a third of
all rows share is joined by a table of one row a payload, whose skew Spark can split.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, load, ship, tidy, written

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY = "record_id string, page_id long, frame int, offset long, length long"
BUNDLE = f"bundle string, data binary, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ', ')}>>"
LEAST = 100  # bytes of a payload that may be revisited
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def pack_frames(frames: list[tuple[bytes, int, int]]) -> bytes:
    """A bundle from (compressed frame, size, checksum) triples."""
    table = b"".join(struct.pack("<III", len(z), size, check) for z, size, check in frames)
    foot = struct.pack("<IBI", len(frames), CHECKED, SEEKABLE)
    return b"".join([*(z for z, _, _ in frames), struct.pack("<II", SKIPPABLE, len(table) + len(foot)), table, foot])


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of every frame, from the bundle's end alone."""
    n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    width = 12 if flags & CHECKED else 8
    head = len(data) - 9 - n * width - 8
    if magic != SEEKABLE or struct.unpack_from("<II", data, head) != (SKIPPABLE, n * width + 9):
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        z, size = struct.unpack_from("<II", data, head + 8 + i * width)
        out.append((at, z, size, struct.unpack_from("<I", data, head + 16 + i * width)[0] if width == 12 else -1))
        at += z
    return out


def frame(data: bytes, entry: tuple[int, int, int, int], unpacker=None) -> bytes:
    at, z, size, check = entry
    out = (unpacker or zstandard.ZstdDecompressor()).decompress(data[at : at + z], max_output_size=size)
    if len(out) != size or (check >= 0 and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check):
        raise ValueError("damaged frame")
    return out


def record_id(row: int) -> str:
    """A name-based identifier of the staged row."""
    h = hashlib.sha256(b"ebbtide page record %d" % row).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}"


def record(row, page_id, url, payload: bytes | None, size: int, digest: str, first_row, first_page, date: str) -> bytes:
    """One WARC record; a payload of None makes a revisit of first_row."""
    revisit = payload is None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(row)}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(first_row)}>",
        ]
        if first_page is not None:
            head.append(f"X-Refers-To-Page-ID: {first_page}")
        body = b""
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a place of an uncompressed frame."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no record here")
    head = dict(x.split(": ", 1) for x in lines)
    body = end + 4
    stop = body + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the record is cut")
    return head, data[body:stop], stop + 4


def payload(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4 :] if block else b""


def staged(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, html, size, digest) with fixed row numbers."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"),
    )
    return written(rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256)), "warc-rows", compression="zstd")


def roles(rows: DataFrame) -> DataFrame:
    """Staged rows with first_row and first_page; html is null where the row revisits another."""
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    firsts = (
        rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("digest", F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_page"))
    )
    html = F.when(F.col("first_row").isNull() | (F.col("first_row") == F.col("row")), F.col("html"))
    return rows.join(firsts, "digest", "left").select("row", "page_id", "url", html.alias("html"), "size", "digest", "first_row", "first_page")


def write(pages: DataFrame, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 24, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages as bundles in the shared folder: (bundle, data, entries)."""
    ship(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, packer = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=level)
        frames, entries, held, size, filled, made = [], [], [], 0, 0, 0

        def close_frame():
            nonlocal held, size, filled
            data = b"".join(held)
            z = packer.compress(data)
            frames.append((z, len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            held, size, filled = [], 0, filled + len(z)

        def close_bundle():
            nonlocal frames, entries, filled, made
            row = pa.RecordBatch.from_arrays(
                [pa.array([f"{part:06d}-{made:06d}"]), pa.array([pack_frames(frames)], pa.binary()), pa.array([entries], ENTRIES)],
                ["bundle", "data", "entries"],
            )
            frames, entries, filled, made = [], [], 0, made + 1
            return row

        for b in batches:
            for i in range(b.num_rows):
                row, page_id, url, html, n, digest, first_row, first_page = (c[i].as_py() for c in b.columns)
                rec = record(row, page_id, url, html, n, digest, first_row, first_page, date)
                if held and size + len(rec) > frame_bytes:
                    close_frame()
                    if filled >= bundle_bytes:
                        yield close_bundle()
                entries.append(dict(record_id=record_id(row), page_id=page_id, frame=len(frames), offset=size, length=len(rec)))
                held.append(rec)
                size += len(rec)
        if held:
            close_frame()
            yield close_bundle()

    rows = staged(pages)
    bundles = written(roles(rows).mapInArrow(tidy(run), BUNDLE), "warc-bundles")
    drop(rows)
    return bundles


ENTRIES = pa.list_(
    pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
)


def described(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, size, digest, type, page referred to) of a parsed record; a response is measured, not believed."""
    page, to = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
    if head["WARC-Type"] == "response":
        body = payload(block)
        size, digest = len(body), hashlib.sha256(body).hexdigest()
        if head["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError("a payload does not have its digest")
    else:
        size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
    return page and int(page), size, digest, head["WARC-Type"], to and int(to)


def read(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records, a frame at a time."""
    ship(bundles.sparkSession)

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            for data in b.column(0):
                data = data.as_py()
                for entry in seek_table(data):
                    plain, at, rows = frame(data, entry, unpacker), 0, []
                    while at < len(plain):
                        head, block, at = parse(plain, at)
                        rows.append(described(head, block))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], PAGE_NAMES)

    return bundles.select("data").mapInArrow(tidy(run), PAGE)


PAGE_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def index(bundles: DataFrame) -> DataFrame:
    """(record_id, page_id, bundle, frame, offset, length): where every record is."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.record_id", "e.page_id", "bundle", "e.frame", "e.offset", "e.length")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, payload) of the wanted record_ids; decompresses only the frames that hold them, each once.

    The payload of a revisit is null: its bytes are those of the record it refers to.
    """
    ship(bundles.sparkSession)
    places = (
        index(bundles).join(wanted.select("record_id").distinct(), "record_id", "left_semi").groupBy("bundle")
        .agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "record_id"))).alias("places"))
    )

    def run(batches):
        for b in batches:
            for data, places in zip(*b.columns):
                data, ids, found, now, plain = data.as_py(), [], [], -1, b""
                table = seek_table(data)
                for p in places.as_py():
                    if p["frame"] != now:
                        now, plain = p["frame"], frame(data, table[p["frame"]])
                    head, block, end = parse(plain, p["offset"])
                    if end - p["offset"] != p["length"]:
                        raise ValueError("the index does not fit")
                    ids.append(p["record_id"])
                    found.append(payload(block) if head["WARC-Type"] == "response" else None)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["record_id", "payload"])

    return bundles.select("bundle", "data").join(places, "bundle").select("data", "places").mapInArrow(tidy(run), "record_id string, payload binary")


def export(bundles: DataFrame, uri: str) -> None:
    """Write every bundle as <bundle>.warc.zst below a URI that pyarrow's file systems know and all executors reach.

    A file appears under its name only when whole, so a repeated task replaces it by the same bytes.
    """

    def run(rows):
        from pyspark import TaskContext
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root)
        for r in rows:
            name = f"{root}/{r.bundle}.warc.zst"
            part = f"{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(part) as out:
                out.write(bytes(r.data))
            store.move(part, name)

    bundles.select("bundle", "data").foreachPartition(run)


def query(spark, sf_dir):
    return read(write(load(spark, sf_dir, "pages")))


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
r as (select *, row_number() over w as k, first_value(page_id) over w as first from d
  window w as (partition by payload_digest order by page_id nulls last))
select page_id, payload_bytes, payload_digest,
  case when payload_bytes < 100 or k = 1 then 'response' else 'revisit' end as record_type,
  case when payload_bytes >= 100 and k > 1 then first end as refers_to
from r
"""
