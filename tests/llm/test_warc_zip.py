import io
import struct
import zipfile

import pytest

from assaybook.llm import warc_zip as W

SCHEMA = "page_id long, url string, html string, _sha string, _first string"


def pages(spark):
    rows = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (1, "http://a/1", ""), (2, "u\r\nX: y", None),
            (7, "http://a/7", "é€ " * 40_000), (8, "http://a/8", "x\r\n\r\ny"), (None, "http://a/n", "same"), (3, "http://a/3", "same"),
            (10, "http://a/10", "WARC/1.1\r\nContent-Length: 3\r\n\r\n")]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_round_trip_and_query(spark, write_tables, against_oracle, tmp_path):
    rows, df = pages(spark)
    got = W.read_packages(W.write_packages(df, str(tmp_path / "w"), package_bytes=300), with_payload=True).collect()
    assert len(got) == len(rows)
    payloads = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert payloads == {"3": "same", "1": "", "7": "é€ " * 40_000, "8": "x\r\n\r\ny", "10": rows[-1][2]}
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {
        ("5", "3"), ("9", "3"), (None, "3"), ("2", "1")}
    assert {r.payload_bytes for r in got if r.payload_digest == W.payload_digest(b"same")} == {4}
    d = write_tables(pages=df.where("page_id is not null").dropDuplicates(["page_id"]))
    got, want = against_oracle(W, "op9_warc_zip", d, ["pages"])
    assert got == want


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    _, df = pages(spark)
    got = W.read_packages(W.write_packages(df, str(tmp_path / "w"), min_bytes=5)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.read_packages(W.write_packages(empty, str(tmp_path / "w"))).collect() == []


def _zip(comment=b""):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("a", b"first"), ("d/b.bin", b"second" * 50)):
            z.writestr(name, data)
        z.comment = comment
    return raw.getvalue()


def _as_zip64(raw):
    """The same archive with its end record's values in a ZIP64 record, and a
    ZIP64 extra field in the first directory entry."""
    end = raw.rfind(b"PK\5\6")
    count, length, offset = struct.unpack_from("<HII", raw, end + 10)
    directory = bytearray(raw[offset:offset + length])
    n, x = struct.unpack_from("<HH", directory, 28)
    size, header = struct.unpack_from("<I", directory, 24)[0], struct.unpack_from("<I", directory, 42)[0]
    extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
    struct.pack_into("<II", directory, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<I", directory, 42, 0xFFFFFFFF)
    struct.pack_into("<H", directory, 30, x + len(extra))
    directory[46 + n + x:46 + n + x] = extra
    at = offset + len(directory)
    record = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(directory), offset)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, at, 1)
    tail = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return raw[:offset] + bytes(directory) + record + locator + tail


@pytest.mark.parametrize("make", [_zip, lambda: _zip(b"a comment PK\5\6 with a signature in it"), lambda: _as_zip64(_zip())])
def test_directories(make):
    raw = make()
    z = W.ZipRanges(io.BytesIO(raw), len(raw))
    assert list(z.members) == ["a", "d/b.bin"]
    for name, want in (("a", b"first"), ("d/b.bin", b"second" * 50)):
        assert z.read(z.start(name), z.members[name]["size"]) == want


def _record(kind, name, body, **more):
    """A record as other writers make it: no block digest, few fields."""
    block = body if kind == "warcinfo" else b"HTTP/1.1 200 OK\r\ncontent-length:%d\r\n\r\n%s" % (len(body), body)
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "Content-Length": str(len(block)), **more}
    return b"WARC/1.0\r\n" + "".join(f"{k}:{v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_packages_of_other_writers(spark, tmp_path):
    """Two indexed archives, one without an index, a record about the crawl, text
    offsets, a header line, records without digests."""
    import gzip
    import json
    archives, lines = {}, ["!meta 0 "]
    for name in ("one.warc.gz", "two.warc.gz", "three.warc.gz"):
        raw = b""
        for k, rec in enumerate([_record("warcinfo", f"{name}-i", b"software: x"),
                                 *[_record("response", f"{name}-{k}", b"body %d " % k * 40_000) for k in range(3)]]):
            member = gzip.compress(rec)
            about = {"url": "http://x/", "filename": name, "offset": str(len(raw)), "length": str(len(member))}
            if name != "three.warc.gz" and k:
                lines.append(f"com,x)/{k} 20240101000000 {json.dumps(about)}")
            raw += member
        archives[name] = raw
    path = str(tmp_path / "p.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        for name, raw in archives.items():
            z.writestr(f"archive/{name}", raw)
        z.writestr("indexes/a.cdxj", "\n".join(lines[:3]) + "\n")
        z.writestr("indexes/b.cdx.gz", gzip.compress("\n".join(lines[3:]).encode()))
        z.writestr("pages/pages.jsonl", "{}")
    got = W.read_packages(spark.createDataFrame([(path,)], "path string"), with_payload=True).collect()
    assert sorted((r.page_id, r.payload) for r in got) == [
        (f"urn:uuid:{n}-{k}", f"body {k} " * 40_000) for n in sorted(archives) for k in range(3)]
    assert {r.payload_digest for r in got} == {W.payload_digest(b"body %d " % k * 40_000) for k in range(3)}
    kinds = [f["warc-type"] for f, _, _ in W.read_package(path)]
    assert kinds.count("warcinfo") == 1 and len(kinds) == 10  # of the archive that is read whole


def test_damage_is_noticed():
    with pytest.raises(ValueError, match="central directory"):
        W.ZipRanges(io.BytesIO(b"x" * 100), 100)
    rec = W.encode_record(1, "u", b"body", 4, W.payload_digest(b"body"), None, "2020-01-01T00:00:00Z")
    assert W.decode_record(rec)[2] == b"body"
    with pytest.raises(ValueError, match="damaged"):
        W.decode_record(rec.replace(b"body", b"Body"))
