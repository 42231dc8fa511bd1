import hashlib
import struct

import pytest

from taproot.llm import warc

ROWS = [(5, "u5", "<p>x"), (2, "u2", "<p>x"), (9, "u9", None), (7, "u7", ""), (8, None, "é" * 4000), (11, "u\r\n11", "<p>x"), (12, "u", "only")]


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    out = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first[h or ""]
        again = f != i and len(raw) >= least
        out.add((i, len(raw), warc.digest(raw), "revisit" if again else "response", f if again else None))
    return out


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, sha int")
    got = warc.archived_pages(pages, least).collect()
    assert {tuple(r) for r in got} == brute(ROWS, least) and len(got) == len(ROWS)


def test_dictionary_and_small_archives(spark):
    rows = [(i, f"u{i}", f"<html><body>page number {i % 90} of the same site, with words in it {'ab' * (i % 7)}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = warc.train_dictionary(pages)
    assert known
    files = warc.archives(warc.with_revisits(pages), known, most_bytes=5000)
    assert files.count() > 5
    got = warc.read_archives(files, payloads=True).collect()
    assert {tuple(r)[:5] for r in got} == brute(rows)
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {h for _, _, h in rows}


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_reader_rejects_faults():
    import zstandard

    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    good = warc.page_record(1, "u", b"payload", None)
    head = warc.dictionary_frame(b"")
    assert [warc.parse(x).payload() for x in warc.frames(head + pack(good) + pack(good))] == [b"payload"] * 2
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9.9"),
        good.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"),
        good[:-1],
        good.replace(b"WARC-Date", b"WARC-Dote"),
        good + b"x",
    ):
        with pytest.raises(warc.BadWarc):
            [warc.parse(x) for x in warc.frames(head + pack(bad))]
    for bad in (head + pack(good)[:-6], head + b"junkjunkjunk", warc.dictionary_frame(b"abc")[:-1]):
        with pytest.raises(warc.BadWarc):
            list(warc.frames(bad))


def test_repeated_rows_and_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 3)
    rows = [(4, "u", "same")] * 11 + [(4, "v", "same"), (6, "u", "same"), (6, "u", "same"), (None, "n", "same"), (None, "n", "alone"), (None, "n", "alone"), (7, "w", "other"), (7, "w", "third")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, row string, copy int")
    got = warc.read_archives(warc.archives(warc.with_revisits(pages)), payloads=True).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    same = [r for r in got if r.payload_digest == warc.digest(b"same")]
    assert len(same) == 15 and [(r.page_id, r.refers_to) for r in same if r.record_type == "response"] == [(4, None)]
    assert {r.refers_to for r in same if r.record_type == "revisit"} == {4} and {r.payload_bytes for r in same} == {4}
    assert all(r.record_type == "response" for r in got if r.payload_digest != warc.digest(b"same"))
    assert {(r.page_id, r.payload) for r in got if r.record_type == "response"} == {(4, b"same"), (None, b"alone"), (7, b"other"), (7, b"third")}
    assert {tuple(r) for r in warc.archived_pages(pages).collect()} == {tuple(r)[:5] for r in got}


def golden():
    """An archive made by hand: mixed case, folded lines, foreign digests, all kinds of records, no dictionary."""
    def record(kind, head, block):
        lines = ["WARC/1.0", f"warc-type: {kind}", f"WARC-RECORD-ID: <urn:uuid:{kind}>", "Warc-Date: 2020-01-01T00:00:00Z", *head, f"content-length: {len(block)}"]
        return "\r\n".join(lines).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\ncontent-length: 5\r\n\r\nhello"
    return [
        record("warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n"),
        record("request", ["Content-Type: application/http;msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        record("response", ["Content-Type: application/http;", " msgtype=response", "WARC-Target-URI: http://h/\xe9", "WARC-Block-Digest: sha256:" + hashlib.sha256(http).hexdigest(), "WARC-Payload-Digest: SHA1:" + warc.digest(b"hello").lower()], http),
        record("response", ["Content-Type: text/dns", "WARC-Payload-Digest: blake9:zz"], b"example. IN A 192.0.2.1"),
        record("metadata", [], b"via: y"),
        record("resource", ["Content-Type: image/png"], b"png"),
        record("revisit", ["WARC-Refers-To-Target-URI: http://h/", "WARC-Payload-Digest: sha1:" + warc.digest(b"hello")], b""),
    ]


def test_archive_from_elsewhere(spark, tmp_path):
    import zstandard

    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    data = b"".join(map(pack, golden())) + struct.pack("<II", 0x184D2A53, 3) + b"abc" + pack(golden()[4])
    (tmp_path / "a.warc.zst").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("content as archive")
    got = warc.read_archives(files, payloads=True, kinds=()).collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "metadata", "resource", "revisit", "metadata"]
    assert [r.payload for r in got[2:6]] == [b"hello", b"example. IN A 192.0.2.1", b"via: y", b"png"]
    assert got[2].uri == "http://h/\xe9" and got[2].payload_digest == got[6].payload_digest == warc.digest(b"hello")
    assert all(r.page_id is None for r in got) and got[6].payload_bytes is None
    assert [r.record_type for r in warc.read_archives(files).collect()] == ["response", "response", "revisit"]
    for bad in (data[:-len(pack(golden()[4])) - 1], golden()[2].replace(b"hello", b"hallo")):
        with pytest.raises(warc.BadWarc):
            [warc.parse(x) for x in warc.frames(bad if bad[:4] != b"WARC" else pack(bad))]


def test_info_record(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    files = warc.archives(warc.with_revisits(pages), software="taproot")
    assert [r.record_type for r in warc.read_archives(files, kinds=()).collect()] == ["warcinfo", "response"] and files.first().records == 2
    assert files.where("records > 2").count() == 0 and warc.archives(warc.with_revisits(pages.limit(0)), software="taproot").count() == 0
