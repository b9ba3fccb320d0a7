"""WARC records in ZIP packages: writer, and a reader that never extracts.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip
member per record), ``indexes/index.cdxj`` (offset and length of every record)
and ``datapackage.json``. Tasks write packages of bounded size under names of
their own attempt, and the manifest that Spark commits names the ones that
count, so a lost or repeated task leaves nothing that is read.

The reader fetches byte ranges only: the end of the file, the central
directory (ZIP64 records included), the index members, then each record. It takes
packages of others, too: every ``archive/`` member and ``indexes/`` member is found by
the directory, index lines are CDXJ (key, time, JSON) or JSON alone, an archive that no
index names is read record by record, and records of other types are passed over.

Of records with equal payloads (of at least ``min_bytes``) the one with the
smallest page id is a response; the others are revisits that carry the HTTP
head, the payload digest and a reference, but not the payload.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import shuffle_partitions, stage, table
from assaybook.session import work_dir

#: A writer closes a package once its records pass this size.
PACKAGE_BYTES = 64 << 20

# Fixed values of the formats
_ARCHIVE, _INDEXES, _ABOUT = "archive/", "indexes/", "datapackage.json"
_DATA, _INDEX = "data.warc.gz", "index.cdxj"
#: Bytes read at once of an archive without an index.
_CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = (b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4")
_ID = "urn:page:"
_ROW = ("_id", "_url", "_html", "_size", "_sha", "_refers_to")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records
def encode_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or (``payload`` None) a revisit."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block += payload or b""
    name = "" if page_id is None else page_id
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<{_ID}{name}>"),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
            ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if payload is None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(fields["content-length"])]
    given = fields.get("warc-block-digest", "")  # optional, and not always SHA-1
    if len(block) != int(fields["content-length"]) or (
            given.startswith("sha1:") and given != f"sha1:{payload_digest(block)}"):
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _page(urn: str | None) -> str | None:
    return (urn or "").strip("<>").removeprefix(_ID) or None


# ---------------------------------------------------------------- writer
class _Package:
    """One ZIP package being written to a stream that only moves forward."""

    def __init__(self, path: str):
        system, p = open_fs(path)
        self.path, self.raw = path, system.open_output_stream(p)
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(_ARCHIVE + _DATA, "w", force_zip64=True)
        self.index, self.at = [], 0

    def add(self, record: bytes, date: str, entry: dict) -> None:
        member = gzip.compress(record, 6, mtime=0)
        self.data.write(member)
        key, time = "".join((entry["url"] or "-").split()), "".join(c for c in date if c.isdigit())
        about = entry | {"filename": _DATA, "offset": self.at, "length": len(member)}
        self.index.append(f"{key} {time} {json.dumps(about)}")
        self.at += len(member)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(_INDEXES + _INDEX, "".join(x + "\n" for x in sorted(self.index)))
        self.zip.writestr(_ABOUT, json.dumps({"profile": "data-package", "records": len(self.index)}))
        self.zip.close()
        self.raw.close()
        return self.path, self.at, len(self.index)


def _writer(folder: str, package_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None

        def done(p):
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in p.close()], ["path", "bytes", "records"])

        for b in batches:
            for i, url, html, size, sha, refers_to in zip(*(b.column(c).to_pylist() for c in _ROW), strict=True):
                package = package or _Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                payload = None if html is None else html.encode()
                package.add(encode_record(i, url, payload, size, digest, refers_to, date), date,
                            {"id": i, "url": url, "digest": digest})
                if package.at >= package_bytes:
                    yield done(package)
                    package = None
        if package:
            yield done(package)
    return run


def write_packages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` under ``folder``; returns the
    manifest (path, bytes, records). Null html is the empty payload, a null url
    is left out, a null id is never the smallest. Rows that repeat the smallest
    id of their payload are all responses. An empty table writes no package."""
    html = F.coalesce(html_col, F.lit(""))
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"),
                     F.octet_length(html).cast("long").alias("_size"), F.sha1(html.cast("binary")).alias("_sha"))
    firsts = p.groupBy("_sha", "_size").agg(F.min("_id").alias("_first"))
    # which (id, payload) pairs are revisits: narrow rows, so a hot payload costs little and AQE can split it
    revisits = (p.select("_id", "_sha", "_size").join(firsts, ["_sha", "_size"])
                .where((F.col("_size") >= min_bytes) & ~F.col("_id").eqNullSafe(F.col("_first")))
                .select(F.col("_id").alias("_rid"), F.col("_sha").alias("_rsha"), "_first").distinct())
    rows = (p.join(revisits, p["_id"].eqNullSafe(revisits["_rid"]) & (p["_sha"] == revisits["_rsha"]), "left")
            .select("_id", "_url", F.when(F.col("_first").isNull(), F.col("_html")).alias("_html"),
                    "_size", "_sha", F.col("_first").alias("_refers_to")))
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    date = dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    written = rows.mapInArrow(_writer(folder, package_bytes, date), "path string, bytes long, records long")
    return stage(written, "warc-manifest")


# ---------------------------------------------------------------- reader
class ZipRanges:
    """Members of a ZIP file, found by range reads of its directories."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m["name"]: m for m in self._directory()}

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError("the file ends early")
        return out

    def _directory(self) -> Iterator[dict]:
        start = max(0, self.size - 65557)  # the end record and its longest comment
        tail = self.read(start, self.size - start)
        at = tail.rfind(_EOCD)
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(_EOCD, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
            locator = self.read(start + at - 20, 20)
            if locator[:4] != _LOCATOR:
                raise ValueError("no ZIP64 locator")
            end = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != _EOCD64:
                raise ValueError("no ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", end, 32)
        raw, at = self.read(offset, length), 0
        for _ in range(count):
            if raw[at:at + 4] != _CENTRAL:
                raise ValueError("damaged central directory")
            method, = struct.unpack_from("<H", raw, at + 10)
            packed, full, n, x, c = struct.unpack_from("<IIHHH", raw, at + 20)
            header, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46:at + 46 + n].decode()
            extra, e = raw[at + 46 + n:at + 46 + n + x], 0
            while e + 4 <= len(extra):
                tag, k = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: the values that did not fit, in this order
                    wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, e + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                e += 4 + k
            yield {"name": name, "method": method, "size": packed, "header": header}
            at += 46 + n + x + c

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m["method"] != 0:
            raise ValueError(f"{name} is not stored")
        local = self.read(m["header"], 30)
        if local[:4] != _LOCAL:
            raise ValueError("damaged local header")
        n, x = struct.unpack_from("<HH", local, 26)
        return m["header"] + 30 + n + x


def _index_entries(z: ZipRanges, archives: list[str]) -> dict[str, set[tuple[int, int]]]:
    """(offset, length) of the records that the index members name, by archive. A
    line without a file name means the only archive."""
    found: dict[str, set[tuple[int, int]]] = {}
    for name in z.members:
        if not name.startswith(_INDEXES) or not name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            continue
        raw = z.read(z.start(name), z.members[name]["size"])
        for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines():
            if (at := line.find("{")) < 0:
                continue  # a header line
            entry = json.loads(line[at:])
            archive = _ARCHIVE + entry["filename"] if "filename" in entry else archives[0] if len(archives) == 1 else None
            if archive not in archives:
                raise ValueError(f"{name} names no archive of the package: {line[:80]!r}")
            found.setdefault(archive, set()).add((int(entry["offset"]), int(entry["length"])))
    return found


def _scan(z: ZipRanges, name: str) -> Iterator[bytes]:
    """The records of an archive without an index: its gzip members in turn."""
    at, end = z.start(name), z.start(name) + z.members[name]["size"]
    member, out, rest = zlib.decompressobj(31), [], b""
    while rest or at < end:
        if not rest:
            rest = z.read(at, min(_CHUNK, end - at))
            at += len(rest)
        out.append(member.decompress(rest))
        rest = member.unused_data
        if member.eof:
            yield b"".join(out)
            member, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError(f"{name} ends inside a record")


def read_package(path: str) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, HTTP head, payload) of every record of the package's archives, those
    of an archive in the order of their places."""
    system, p = open_fs(path)
    with system.open_input_file(p) as f:
        z = ZipRanges(f, f.size())
        archives = [m for m in z.members if m.startswith(_ARCHIVE) and m.endswith((".warc.gz", ".warc"))]
        named = _index_entries(z, archives)
        for archive in archives:
            if archive in named:
                data = z.start(archive)
                records = (z.read(data + offset, length) for offset, length in sorted(named[archive]))
                records = (gzip.decompress(r) if r[:2] == b"\x1f\x8b" else r for r in records)
            elif archive.endswith(".gz"):
                records = _scan(z, archive)
            else:
                raise ValueError(f"{archive} is neither compressed by record nor in an index")
            yield from map(decode_record, records)


_READ = T.StructType([T.StructField(n, t) for n, t in (
    ("page_id", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()),
    ("record_type", T.StringType()), ("refers_to", T.StringType()), ("url", T.StringType()),
    ("payload", T.StringType()))])


def _reader(with_payload: bool):
    def rows(path: str):
        for fields, http, payload in read_package(path):
            kind = fields["warc-type"]
            if kind not in ("response", "revisit"):
                continue  # about the crawl, not about a page
            given = fields.get("warc-payload-digest", "")
            digest = given.removeprefix("sha1:") if given.startswith("sha1:") else payload_digest(payload)
            sizes = [int(v) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n"))
                     if k.lower() == "content-length"]
            size = sizes[0] if sizes else len(payload)
            if kind == "response" and (len(payload), payload_digest(payload)) != (size, digest):
                raise ValueError(f"damaged payload of {fields.get('warc-record-id')}")
            yield (_page(fields.get("warc-record-id")), size, digest, kind, _page(fields.get("warc-refers-to")),
                   fields.get("warc-target-uri"),
                   payload.decode(errors="replace") if with_payload and kind == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                part = []
                for row in rows(path):
                    part.append(row)
                    if len(part) == 1000:
                        yield _batch(part)
                        part = []
                if part:
                    yield _batch(part)
    return run


def _batch(part: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
    cols = zip(*part, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _READ.names)


def read_packages(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """One row per record of the manifest's packages: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url and (if asked for, responses
    only) payload. Every block and payload is checked against its digest."""
    n = shuffle_partitions(manifest.sparkSession)
    return manifest.select("path").repartition(n, "path").mapInArrow(_reader(with_payload), _READ)


# ---------------------------------------------------------------- query
def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/llm/warc-{uuid.uuid4().hex[:12]}"
    records = read_packages(write_packages(table(spark, sf_dir, "pages"), folder))
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {"op9_warc_zip": op9_warc_zip}

ORACLE = {"op9_warc_zip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, payload_bytes, min(page_id) AS first_id FROM d GROUP BY h, payload_bytes),
b AS (SELECT h, string_agg(c, '' ORDER BY g, s) AS payload_digest FROM (
  SELECT h, g, s, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * s AS INT)) & 31 AS INT) + 1, 1) AS c
  FROM (SELECT DISTINCT h FROM d), range(8) AS a(g), range(4) AS e(s)) GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (h, payload_bytes) JOIN b USING (h)
"""}
