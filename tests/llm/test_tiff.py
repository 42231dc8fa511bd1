import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from taproot.llm import tiff


def noise(n, seed, letters=256):
    r = random.Random(seed)
    return bytes(r.randrange(letters) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 127, 128, 129, 130, 5000, 70000])
@pytest.mark.parametrize("letters", [1, 2, 5, 256])
def test_codecs_round_trip(n, letters):
    raw = noise(n, n, letters)
    assert tiff.packbits_decode(tiff.packbits_encode(raw), n) == raw
    assert tiff.lzw_decode(tiff.lzw_encode(raw), n) == raw


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("cut", [7, 100, (16, 32), (64, 64)])
def test_pages_round_trip(order, how, predictor, cut):
    a, b = (np.frombuffer(noise(h * 50, h, 9), np.uint8).reshape(h, 50) for h in (33, 1))
    data = tiff.write_tiff([(a, how, predictor, cut), (b, how, predictor, cut)], order)
    got = list(tiff.read_pages(data))
    assert [p.index for p in got] == [0, 1]
    assert all((p.pixels[:, :, 0] == x).all() for p, x in zip(got, (a, b), strict=True))


def test_float_predictor():
    a = np.random.default_rng(3).normal(size=(4, 5)).astype(">f4")
    planes = a.view(np.uint8).reshape(4, 5, 4).transpose(0, 2, 1).reshape(4, 20)
    raw = np.diff(planes, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8).tobytes()
    got = tiff.undo_predictor(raw, 3, 4, 5, 1, 32, "<")
    assert (got[:, :, 0] == a).all()


def test_broken_files():
    data = tiff.store(b"x" * 192 * 300)
    for bad in (b"", data[:6], b"II*\0" + b"\xff" * 4, data[: len(data) // 2]):
        with pytest.raises(tiff.BadTiff):
            list(tiff.read_pages(bad))
    loop = bytearray(tiff.store(b"x" * 192))
    (at,) = struct.unpack_from("<I", loop, 4)
    (n,) = struct.unpack_from("<H", loop, at)
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    with pytest.raises(tiff.BadTiff):
        list(tiff.read_pages(bytes(loop)))


def test_operator(spark):
    texts = ["", None, "a", "é" * 96, "b" * 192, "long " * 40000, "b" * 192]
    docs = spark.createDataFrame([(i, x, 1.0) for i, x in enumerate(texts)], "doc_id long, text string, tiff double")
    media = tiff.stored_texts(docs)
    rows = {r.doc_id: r for r in tiff.digests(media).collect()}
    assert len(rows) == len(texts)
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        full = raw + b" " * ((-len(raw) % 192) or (0 if raw else 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest()
        assert r.tail_crc32 == zlib.crc32(full[-16:])
    assert rows[4][2:] == rows[6][2:]
    by_page = tiff.pages(media, "doc_id").collect()
    used = {(r.compression, r.tiled) for r in by_page if r.doc_id == 5}
    assert used == {(tiff.DEFLATE, False), (tiff.LZW, True), (tiff.PACKBITS, False)}
    bad = spark.createDataFrame([(1, None), (2, b"no")], "doc_id long, tiff binary")
    assert [r.page for r in tiff.pages(bad, "doc_id").collect()] == [-1, -1]
    assert tiff.digests(tiff.stored_texts(docs.limit(0))).count() == 0


def test_every_payload_uses_every_codec(spark):
    texts = ["", "a", "b" * 193, "long " * 40000]
    media = tiff.stored_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = tiff.pages(media, "doc_id").collect()
    for i in range(len(texts)):
        assert {(r.compression, r.predictor, r.tiled) for r in rows if r.doc_id == i} == {(tiff.DEFLATE, 1, False), (tiff.LZW, 2, True), (tiff.PACKBITS, 1, False)}


def test_codecs_against_vectors_made_by_hand():
    # the PackBits sample of the format's note
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.packbits_decode(packed, len(plain)) == plain
    # the LZW sample of the format: 7 7 7 8 8 7 7 6 6 gives clear 7 258 8 8 258 6 6 end, nine bits each
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_decode(data, 9) == raw and tiff.lzw_encode(raw) == data
    # a big-endian page of two rows of two samples, uncompressed, the directory laid out by hand
    fields = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, 4)]
    ifd = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields)
    data = b"MM\0*" + struct.pack(">I", 12) + bytes([1, 2, 3, 4]) + ifd + struct.pack(">I", 0)
    (page,) = tiff.read_pages(data)
    assert page.pixels[:, :, 0].tolist() == [[1, 2], [3, 4]] and not page.tiled
    # horizontal differences of one row, 16 bits
    got = tiff.undo_predictor(struct.pack("<4H", 10, 5, 65535, 0), 2, 1, 4, 1, 16, "<")
    assert got[0, :, 0].tolist() == [10, 15, 14, 14]


def test_fuzzed_files_give_error_rows(spark):
    r = random.Random(4)
    good, files = tiff.store(noise(192 * 3, 5, 20)), []
    for i in range(1500):
        bad = bytearray(good)
        for _ in range(r.randint(1, 6)):
            bad[r.randrange(len(bad)) if r.random() < 0.5 else -r.randint(1, 500)] = r.choice([0, 255, r.randrange(256)])
        files.append((i, bytes(bad[: r.choice([len(bad), len(bad), r.randrange(len(bad))])])))
    rows = tiff.pages(spark.createDataFrame(files, "doc_id long, tiff binary"), "doc_id", most_bytes=1 << 24).collect()
    assert {r.doc_id for r in rows} == set(range(1500))
    failed = {r.doc_id for r in rows if r.page == -1}
    assert 500 < len(failed) < 1500 and all(r.error for r in rows if r.page == -1)
    media = spark.createDataFrame([(1, 5, b"no")], "doc_id long, n_bytes long, tiff binary")
    with pytest.raises(Exception, match="BadTiff"):
        tiff.digests(media).collect()


def test_feature_against_brute_force(spark):
    texts = ["", "abc", "é" * 500, "x" * 192, " ".join(str(k) for k in range(3000))]
    for g in tiff.digests(tiff.stored_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect():
        raw = texts[g.doc_id].encode()
        raw += b" " * (-len(raw) % 192 or (0 if raw else 192))
        n = len(raw)
        mean = sum(raw) / n
        dev = (sum(b * b for b in raw) / n - mean * mean) ** 0.5
        entropy = -sum(raw.count(b) / n * np.log2(raw.count(b) / n) for b in set(raw))
        cuts = [n * k // 64 for k in range(65)]
        mark = sum(1 << k for k in range(64) if sum(raw[cuts[k] : cuts[k + 1]]) > mean * (cuts[k + 1] - cuts[k]))
        parts = dict(x.split("=") for x in g.feature.split(";"))
        assert parts["hash"] == f"{mark:016x}" and int(parts["pages"]) == 3 * -(-n // 192 // 512)
        assert abs(float(parts["mean"]) - mean) < 1e-5 and abs(float(parts["dev"]) - dev) < 1e-4 and abs(float(parts["entropy"]) - entropy) < 1e-5
        data = tiff.store(raw)
        assert (g.media_bytes, g.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())


def by_hand(raw, width, height, bits, order="<", **tags):
    """One uncompressed or ready compressed strip with the given further tags."""
    fields = {256: width, 257: height, 258: bits, 259: 1, 262: 1, 273: 8, 277: 1, 278: height, 279: len(raw)} | {int(k[1:]): v for k, v in tags.items()}
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(raw) + len(raw) % 2)
    entries = b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in sorted(fields.items()))
    return head + raw + b"\0" * (len(raw) % 2) + struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0)


@pytest.mark.parametrize("order", ["<", ">"])
def test_kinds_of_samples(order):
    for kind, bits, form in (("f4", 32, 3), ("f8", 64, 3), ("f2", 16, 3), ("i1", 8, 2), ("i2", 16, 2), ("i4", 32, 2), ("u4", 32, 1), ("u8", 64, 1)):
        a = np.array([[1.5, -2, 100], [0, 7, -128]]) if kind[0] != "u" else np.array([[1, 2, 100], [0, 7, 250]])
        a = a.astype(kind)
        (page,) = tiff.read_pages(by_hand(a.astype(order + kind).tobytes(), 3, 2, bits, order, t339=form))
        assert page.sample_format == form and page.pixels.dtype == np.dtype(kind) and (page.pixels[:, :, 0] == a).all()
    signed = np.array([[-100, 100, -3]], np.int16)
    steps = np.diff(signed.view(np.uint16), axis=1, prepend=np.zeros((1, 1), np.uint16)).astype(order + "u2").tobytes()
    (page,) = tiff.read_pages(by_hand(steps, 3, 1, 16, order, t317=2, t339=2))
    assert (page.pixels[:, :, 0] == signed).all()


def test_small_samples():
    rows = np.array([[1, 0, 1, 1, 0, 0, 0, 1, 1, 1], [0, 0, 0, 0, 0, 0, 0, 1, 0, 1]])
    packed = bytes([0b10110001, 0b11000000, 0b00000001, 0b01000000])
    for raw, tags in ((packed, {}), (tiff.packbits_encode(packed), {"t259": tiff.PACKBITS}), (bytes(int(f"{b:08b}"[::-1], 2) for b in packed), {"t266": 2})):
        (page,) = tiff.read_pages(by_hand(raw, 10, 2, 1, **tags))
        assert page.bits == 1 and page.pixels.dtype == np.uint8 and (page.pixels[:, :, 0] == rows).all()
    (page,) = tiff.read_pages(by_hand(bytes([0x1F, 0xA0, 0x07, 0x30]), 3, 2, 4))
    assert page.pixels[:, :, 0].tolist() == [[1, 15, 10], [0, 7, 3]]
    (page,) = tiff.read_pages(by_hand(bytes([0b00011011, 0b10000000]), 5, 1, 2))
    assert page.pixels[:, :, 0].tolist() == [[0, 1, 2, 3, 2]]


def test_refused_kinds():
    for bits, tags in ((1, {"t339": 2}), (8, {"t339": 3}), (32, {"t339": 5}), (8, {"t266": 2}), (4, {"t266": 2}), (12, {}), (4, {"t317": 2}), (32, {"t339": 2, "t317": 3}), (32, {"t339": 3, "t317": 2})):
        with pytest.raises(tiff.BadTiff):
            list(tiff.read_pages(by_hand(bytes(64), 4, 2, bits, **tags)))


def test_sample_format_is_a_column(spark):
    data = by_hand(struct.pack("<2f", 1.5, -2.25), 2, 1, 32, t339=3)
    (row,) = tiff.pages(spark.createDataFrame([(1, data)], "doc_id long, tiff binary"), "doc_id").collect()
    assert row.sample_format == 3 and struct.unpack("=2f", row.pixels) == (1.5, -2.25)
