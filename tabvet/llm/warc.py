"""WARC records in ZIP packages: write, and read by ranges without extraction.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``
(one gzip member per record), ``indexes/index.cdxj`` (one line per record, sorted: the URL
with its host turned round, 14 digits of time, JSON with url, digest, and offset and
length in the archive member) and ``datapackage.json``. The
reader parses the end record, the ZIP64 locator and end record where present and
the central directory, finds the stored archive members and indexes, and fetches
each record with one range read; nothing is unpacked.

In Spark a package is one row (``part``, ``package`` binary) of a Parquet table
in the shared folder: the write commits like any other, also when tasks rerun,
and it works on every store Spark writes to. ``read_package`` takes any
``fetch(offset, length)``: ``write_files`` puts packages into files and ``read_files`` reads
files, or those records of them whose index line a filter accepts, by ranges only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import in_shared_folder, shuffle_partitions

PACKAGE_BYTES = 16 << 20
#: Time of records whose pages carry none: fixed, so that reruns write the same bytes.
CAPTURED = "1970-01-01T00:00:00Z"
# Fixed values of the ZIP format: signatures and the mark that a 32-bit field's value stands in the ZIP64 field.
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_IN_ZIP64, _IN_ZIP64_SHORT = 0xFFFFFFFF, 0xFFFF

Fetch = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header_at: int


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def url_key(url: str) -> str:
    """The URL as an index key: host labels from the last on, comma-joined, ``)`` and the rest, lower-cased, without scheme,
    user, fragment and white space. Text without a host is its own key; empty: ``-``."""
    text = re.sub(r"\s", "%20", url.partition("#")[0]).lower()
    scheme, mark, rest = text.partition("://")
    if not mark:
        return text or "-"
    host, path = re.match(r"([^/?]*)(.*)", rest).groups()
    name, colon, port = host.rpartition("@")[2].partition(":")
    port = "" if (scheme, port) in (("http", "80"), ("https", "443")) else colon + port
    return ",".join(reversed(name.split("."))) + port + ")" + (path if path.startswith("/") else "/" + path)


def page_record(key: str, url: str, digest: str, size: int, payload: bytes | None, refers_to: str | None, captured: str = CAPTURED) -> bytes:
    """Response (``payload`` given) or revisit of ``refers_to`` (payload None)."""
    safe = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
    headers = {"WARC-Type": "response" if payload is not None else "revisit", "WARC-Record-ID": f"<urn:page:{key}>",
               "WARC-Date": captured, "WARC-Target-URI": safe, "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(size),
               "Content-Type": "application/http; msgtype=response"}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if payload is None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return warc_record(headers, block + (payload or b""))


def write_package(records: list[bytes], zip64: bool = False) -> bytes:
    """A package of page records; ``zip64`` writes the 64-bit fields even where 32 bits suffice."""
    data, index = io.BytesIO(), []
    for raw in records:
        packed, head = gzip.compress(raw, compresslevel=4, mtime=0), parse_record(raw)[0]
        entry = {"url": head["WARC-Target-URI"], "digest": head["WARC-Payload-Digest"], "mime": "warc/revisit" if "WARC-Profile" in head else "text/html",
                 "offset": data.tell(), "length": len(packed), "filename": "data.warc.gz"}
        index.append((url_key(entry["url"]), re.sub(r"\D", "", head["WARC-Date"])[:14], entry))
        data.write(packed)
    index = [f"{key} {time} {json.dumps(entry)}" for key, time, entry in sorted(index, key=lambda x: x[:2])]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in (("archive/data.warc.gz", data.getvalue()), ("indexes/index.cdxj", "".join(f"{x}\n" for x in index).encode()),
                              ("datapackage.json", json.dumps({"profile": "data-package", "records": len(index)}).encode())):
            info = zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))
            with z.open(info, "w", force_zip64=zip64) as f:
                f.write(content)
    return _with_zip64_directory(out.getvalue()) if zip64 else out.getvalue()


def _with_zip64_directory(package: bytes) -> bytes:
    """The same package with sizes, offsets and directory place in ZIP64 fields only."""
    end = package.rindex(_EOCD)
    count, size, at = struct.unpack_from("<HII", package, end + 10)
    out, pos = bytearray(package[:at]), at
    for _ in range(count):
        fixed = bytearray(package[pos:pos + 46])
        packed, full, n, x, c = struct.unpack_from("<IIHHH", fixed, 20)
        header_at = struct.unpack_from("<I", fixed, 42)[0]
        extra = struct.pack("<HHQQQ", 1, 24, full, packed, header_at)
        struct.pack_into("<IIHH", fixed, 20, _IN_ZIP64, _IN_ZIP64, n, len(extra))
        struct.pack_into("<I", fixed, 42, _IN_ZIP64)
        out += fixed + package[pos + 46:pos + 46 + n] + extra + package[pos + 46 + n + x:pos + 46 + n + x + c]
        pos += 46 + n + x + c
    end64, length = len(out), len(out) - at
    out += _EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, at)
    out += _LOCATOR + struct.pack("<IQI", 0, end64, 1)
    return bytes(out + _EOCD + struct.pack("<HHHHIIH", 0, 0, _IN_ZIP64_SHORT, _IN_ZIP64_SHORT, _IN_ZIP64, _IN_ZIP64, 0))


def members(fetch: Fetch, size: int) -> dict[str, Member]:
    """The central directory, by member name. ``size``: of the whole package."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = fetch(tail_at, size - tail_at)
    end = tail.rfind(_EOCD)
    if end < 0:
        raise ValueError("no end-of-directory record: not a ZIP package")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20:end - 16] == _LOCATOR:
        end64 = fetch(struct.unpack_from("<Q", tail, end - 12)[0], 56)
        if end64[:4] != _EOCD64:
            raise ValueError("the ZIP64 locator points at no ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", end64, 32)
    directory, pos, out = fetch(at, length), 0, {}
    for _ in range(count):
        if directory[pos:pos + 4] != _CENTRAL:
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", directory, pos + 10)
        packed, full, n, x, c = struct.unpack_from("<IIHHH", directory, pos + 20)
        header_at, = struct.unpack_from("<I", directory, pos + 42)
        name = directory[pos + 46:pos + 46 + n].decode()
        extra, i = directory[pos + 46 + n:pos + 46 + n + x], 0
        while i + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, i)
            if tag == 1:  # the 64-bit values stand in this order, each only if its 32-bit field is full
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, i + 4))
                full = next(wide) if full == _IN_ZIP64 else full
                packed = next(wide) if packed == _IN_ZIP64 else packed
                header_at = next(wide) if header_at == _IN_ZIP64 else header_at
            i += 4 + width
        out[name] = Member(name, method, packed, header_at)
        pos += 46 + n + x + c
    return out


def content_at(fetch: Fetch, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method:
        raise ValueError(f"{m.name} is compressed; only stored members can be read by ranges")
    local = fetch(m.header_at, 30)
    if local[:4] != _LOCAL:
        raise ValueError(f"no local header of {m.name}")
    n, x = struct.unpack_from("<HH", local, 26)
    return m.header_at + 30 + n + x


def read_package(fetch: Fetch, size: int, wanted: Callable[[str, dict], bool] | None = None) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Key, headers and block of each indexed record, one range read each; ``wanted`` (of the line's URL key and its
    JSON) leaves the others unread."""
    found = members(fetch, size)
    starts = {n.rpartition("/")[2]: content_at(fetch, m) for n, m in found.items() if n.startswith("archive/")}
    for name, m in found.items():
        if not name.startswith("indexes/"):
            continue
        for line in fetch(content_at(fetch, m), m.size).decode().split("\n"):
            if not line:
                continue
            key, _, entry = line.split(" ", 2)
            at = json.loads(entry)
            if wanted is None or wanted(key, at):
                head, block = parse_record(gzip.decompress(fetch(starts[at["filename"]] + at["offset"], at["length"])))
                yield head["WARC-Record-ID"][len("<urn:page:"):-1], head, block


def mark_duplicates(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``digest_hex`` and ``keeper``: the largest page_id with the same payload (null for smaller payloads).

    Only digests and ids are grouped (partial maxima first); the pages join
    back once, and adaptive execution splits a digest with very many rows.
    """
    sized = pages.withColumn("digest_hex", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    groups = (sized.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes)
              .groupBy("digest_hex").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
              .where("n > 1").select("digest_hex", "keeper"))
    return sized.join(groups, "digest_hex", "left")


def write_packages(pages: DataFrame, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, captured: str = CAPTURED) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html); returns the written table (part, package).

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the
    largest page_id is a response, the others are revisits of it. Null html: empty
    payload; null url: empty target; null page_id: key ``-`` and, where no page of the
    group has an id, a response. Rows repeated with the keeper's id are responses too.
    ``captured`` is the time of all records (UTC, as in 2024-01-31T00:00:00Z), as pages carry none.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, records, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([write_package(records)], pa.binary())],
                                              names=["part", "package"])

        for b in batches:
            for page, url, html, keeper in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                payload = (html or "").encode()
                own, to = keeper is None or keeper == page, None if keeper is None else str(keeper)
                key = "-" if page is None else str(page)
                records.append(page_record(key, url or "", sha1_base32(payload), len(payload), payload if own else None, to, captured))
                size += len(records[-1])
                if size >= package_bytes:
                    yield flush()
                    part, records, size = part + 1, [], 0
        if records:
            yield flush()

    marked = mark_duplicates(pages.select("page_id", "url", "html"), least_bytes)
    return in_shared_folder(marked.select("page_id", "url", "html", "keeper").mapInArrow(pack, "part bigint, package binary"),
                            "warc")


_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_PAGE_DDL = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _pages(records: Iterator[tuple[str, dict[str, str], bytes]], most_bytes: int = PACKAGE_BYTES) -> Iterator[pa.RecordBatch]:
    """Records as rows, in batches of some ``most_bytes`` of payload."""
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGE, strict=True)], schema=_PAGE)

    for key, head, block in records:
        digest, to = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("WARC-Refers-To")
        payload = None if to else block.partition(b"\r\n\r\n")[2]
        if payload is not None and sha1_base32(payload) != digest:
            raise ValueError(f"record {key}: the payload does not have its digest")
        rows.append((None if key == "-" else int(key), head["WARC-Target-URI"], payload, int(head["X-Payload-Length"]),
                     digest, head["WARC-Type"], int(to[len("<urn:page:"):-1]) if to else None))
        held += len(payload or b"")
        if held >= most_bytes:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record of the packages: page_id, url, payload (null for revisits), payload_bytes, payload_digest,
    record_type, refers_to. A response whose payload doesn't have its stated digest raises."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for package in b.column(0):
                view = memoryview(package.as_buffer())
                yield from _pages(read_package(lambda at, n, v=view: bytes(v[at:at + n]), len(view)))

    return packages.select("package").mapInArrow(unpack, _PAGE_DDL)


def write_files(packages: DataFrame, folder: str) -> DataFrame:
    """Put each package into a file of its own below ``folder`` (a URI or path that all executors see, whose store renames
    files as one step); returns the written table (path, bytes). A file gets its name once it is whole, so a task that
    runs again replaces it by the same bytes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for part, package in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name, content = f"pages-{part:016x}.wacz", package.as_buffer()
                growing = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(growing) as f:
                    f.write(content)
                store.move(growing, f"{root}/{name}")
                paths.append(f"{folder.rstrip('/')}/{name}")
                sizes.append(content.size)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return in_shared_folder(packages.select("part", "package").mapInArrow(put, "path string, bytes bigint"), "warc-files")


def read_files(files: DataFrame, wanted: Callable[[str, dict], bool] | None = None) -> DataFrame:
    """As ``read_packages``, of the packages at ``files.path``: directory, index and the records that ``wanted`` accepts
    (all by default) are fetched by ranges; nothing else of a file is read. One row of ``files`` is one task's work at
    a time, so they are spread first."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    yield from _pages(read_package(lambda start, n, f=f: f.read_at(n, start), f.size(), wanted))

    return files.select("path").repartition(shuffle_partitions(files.sparkSession)).mapInArrow(unpack, _PAGE_DDL)
