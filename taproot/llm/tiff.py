"""TIFF media columns: store bytes as grey images, walk directories, decode pages.

The reader takes classic TIFF of either byte order: strips or tiles; no compression, PackBits, LZW
or deflate; samples of 1, 2 or 4 bits without predictor and without sign, whole ones of 8 to 64 bits with or
without sign, floats of 16 to 64; predictor none, horizontal (whole samples) or floating point; interleaved or
planar samples.  Samples come as stored: where 0 is white they are not turned over.  Bits may fill bytes from the
low end where a sample is one bit and not compressed.  Anything else raises ``BadTiff``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Bytes and struct letter of each field type of the format.
FIELD = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i")}


class BadTiff(ValueError):
    pass


# ------------------------------------------------------------------ codecs


def packbits_encode(raw: bytes) -> bytes:
    """Runs of three equal bytes and more become repeat packets, the rest literal packets."""
    out, n = bytearray(), len(raw)
    a = np.frombuffer(raw, np.uint8)
    cuts = np.flatnonzero(np.diff(a)) + 1 if n else np.array([], int)
    starts = np.concatenate(([0], cuts)) if n else cuts
    ends = np.concatenate((cuts, [n])) if n else cuts
    long = (ends - starts) >= 3
    at = 0

    def literal(upto: int) -> None:
        nonlocal at
        while at < upto:
            part = raw[at : min(at + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)
            at += len(part)

    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        literal(s)
        while e - at >= 2:
            k = min(128, e - at)
            out += bytes((257 - k, raw[at]))
            at += k
    literal(n)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while len(out) < size:
        if i >= n:
            raise BadTiff("PackBits data ends early")
        k = data[i]
        if k < 128:
            if i + 1 + k >= n:
                raise BadTiff("PackBits literal ends early")
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k == 128:
            i += 1
        else:
            if i + 1 >= n:
                raise BadTiff("PackBits run ends early")
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
    return bytes(out[:size])


#: Codes between two clear codes, which bring the table to 4094 entries, and the width of each, grown one code early.
LZW_RUN = 3836
LZW_WIDTHS = np.maximum(9, np.frexp(np.arange(258, 258 + LZW_RUN + 2))[1])


def lzw_encode(raw: bytes) -> bytes:
    """Codes from the high bit down; the width grows one code early, as the format has it."""
    codes, widths = [256], [np.array([9])]
    known: dict[int, int] = {}
    find, put = known.get, codes.append
    begun, free, word = 1, 258, -1
    for byte in raw:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        code = find(key)
        if code is not None:
            word = code
            continue
        put(word)
        known[key] = free
        free += 1
        word = byte
        if free == 4094:
            put(256)
            widths.append(np.append(LZW_WIDTHS[:LZW_RUN], 12))
            known.clear()
            begun, free = len(codes), 258
    if word >= 0:
        put(word)
    n = len(codes) - begun
    put(257)
    widths.append(np.minimum(LZW_WIDTHS[: n + 1], 12))
    wide = np.concatenate(widths)
    spots = np.arange(11, -1, -1)
    bits = (np.array(codes)[:, None] >> spots) & 1
    return np.packbits(bits[spots < wide[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, width, last = list(first), bytearray(), 9, b""
    bits = filled = 0
    for byte in data:
        bits = (bits << 8) | byte
        filled += 8
        if filled < width:
            continue
        filled -= width
        code = bits >> filled
        bits &= (1 << filled) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = list(first), 9, b""
            continue
        if not last:
            word = words[code] if code < 256 else None
        elif code < len(words):
            word = words[code]
            words.append(last + word[:1])
        elif code == len(words):
            word = last + last[:1]
            words.append(word)
        else:
            word = None
        if word is None:
            raise BadTiff("LZW code out of range")
        out += word
        last = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) >= size:
            break
    if len(out) < size:
        raise BadTiff("LZW data ends early")
    return bytes(out[:size])


def unpack(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        raw = data[:size]
    elif how == PACKBITS:
        raw = packbits_decode(data, size)
    elif how == LZW:
        raw = lzw_decode(data, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        try:
            raw = zlib.decompressobj().decompress(data, size)
        except zlib.error as bad:
            raise BadTiff(str(bad)) from bad
    else:
        raise BadTiff(f"compression {how}")
    if len(raw) < size:
        raise BadTiff("a strip or tile is short")
    return raw


def pack(raw: bytes, how: int) -> bytes:
    if how == DEFLATE:
        return zlib.compress(raw, 6)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}[how](raw)


# ------------------------------------------------------------------ reader


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    sample_format: int  # 1 whole, 2 whole with sign, 3 float
    pixels: np.ndarray  # (height, width, samples); samples of under 8 bits take a byte each


def undo_predictor(raw: bytes, kind: int, rows: int, cols: int, samples: int, bits: int, order: str) -> np.ndarray:
    unit = bits // 8
    if kind == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(rows, cols * samples * unit)
        steps = planes.reshape(rows, -1, samples)
        planes = np.add.accumulate(steps, axis=1, dtype=np.uint8).reshape(rows, unit, cols * samples)
        block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{unit}")
        return block.reshape(rows, cols, samples).astype(f"=f{unit}")
    block = np.frombuffer(raw, f"{order}u{unit}").reshape(rows, cols, samples).astype(f"=u{unit}")
    if kind == 2:
        block = np.add.accumulate(block, axis=1, dtype=block.dtype)
    elif kind != 1:
        raise BadTiff(f"predictor {kind}")
    return block


def small_samples(raw: bytes, rows: int, cols: int, samples: int, bits: int, low_first: bool) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, a byte each; rows begin on whole bytes."""
    each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, bitorder="little" if low_first else "big")
    each = each[:, : cols * samples * bits].reshape(rows, cols, samples, bits)
    weights = 1 << np.arange(bits, dtype=np.uint8)
    return each @ weights[::-1]


def sample_format(fields: dict[int, tuple], bits: int, predictor: int) -> int:
    """Kind of all samples of a page: 1 whole, 2 whole with sign, 3 float; samples of several kinds are refused."""
    for tag in (258, 339):
        if len(set(fields.get(tag, ()))) > 1:
            raise BadTiff("samples of several kinds")
    form = (fields.get(339) or (3 if predictor == 3 else 1,))[0]
    form = 1 if form == 4 else form  # undefined: as stored
    if form not in (1, 2, 3) or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise BadTiff(f"{bits} bits a sample of format {form}")
    if bits < 8 and (form != 1 or predictor != 1) or form == 3 and bits < 16:
        raise BadTiff(f"{bits} bits a sample of format {form}, predictor {predictor}")
    if predictor not in (1, 2, 3) or (predictor == 3) != (form == 3) and predictor != 1:
        raise BadTiff(f"predictor {predictor} of {bits} bits, format {form}")
    return form


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory, in chain order; a loop is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at:
        if at in seen or at + 2 > len(data):
            raise BadTiff("directory chain is broken")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise BadTiff("directory is cut off")
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELD:
                continue
            unit, letter = FIELD[kind]
            where = at + 10 + 12 * k
            if unit * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + unit * count > len(data):
                raise BadTiff(f"field {tag} is out of the file")
            fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_pages(data: bytes, most_bytes: int = 1 << 30) -> Iterator[Page]:
    """The pages in chain order.  A page of over ``most_bytes`` of samples is refused, so that a few
    hostile bytes can't claim all memory."""
    for index, (order, f) in enumerate(directories(data)):
        one = lambda tag, default=None, f=f: (f.get(tag) or (default,))[0]
        width, height, samples = one(256), one(257), one(277, 1)
        bits, how, predictor, planar = one(258, 1), one(259, 1), one(317, 1), one(284, 1)
        if not width or not height or not samples:
            raise BadTiff("a page has no size")
        form, fill = sample_format(f, bits, predictor), one(266, 1)
        if fill != 1 and (fill != 2 or bits != 1 or how != NONE):
            raise BadTiff(f"fill order {fill}")
        if min(width, height, samples) < 0 or width * height * samples * max(bits, 8) // 8 > most_bytes:
            raise BadTiff("a page is too large")
        tiled = 322 in f
        bw, bh = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
        where, sizes = (f.get(324), f.get(325)) if tiled else (f.get(273), f.get(279))
        if not where or not sizes or not bw or not bh or len(where) != len(sizes):
            raise BadTiff("a page has no strips or tiles")
        if min(bw, bh) < 0 or bw * bh * samples * max(bits, 8) // 8 > most_bytes:
            raise BadTiff("a strip or tile is too large")
        across, down = -(-width // bw), -(-height // bh)
        planes, each = (samples, 1) if planar == 2 else (1, samples)
        if len(where) < across * down * planes:
            raise BadTiff("strips or tiles are missing")
        out = np.empty((height, width, samples), f"={' uif'[form]}{max(bits, 8) // 8}")
        for k in range(across * down * planes):
            plane, rest = divmod(k, across * down)
            y, x = rest // across * bh, rest % across * bw
            rows = bh if tiled else min(bh, height - y)
            raw = unpack(data[where[k] : where[k] + sizes[k]], how, rows * ((bw * each * bits + 7) // 8))
            if bits < 8:
                block = small_samples(raw, rows, bw, each, bits, fill == 2)
            else:
                block = undo_predictor(raw, predictor, rows, bw, each, bits, order).view(out.dtype)
            part = block[: height - y, : width - x]
            out[y : y + rows, x : x + bw, plane : plane + each] = part
        yield Page(index, width, height, samples, bits, how, predictor, tiled, form, out)


# ------------------------------------------------------------------ writer


def write_tiff(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | int]], order: str = "<") -> bytes:
    """Grey 8-bit pages ``(pixels, compression, predictor, tile size or rows per strip)``."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for pixels, how, predictor, cut in pages:
        height, width = pixels.shape
        blocks = []
        if isinstance(cut, tuple):
            tw, th = cut
            padded = np.pad(pixels, ((0, -height % th), (0, -width % tw)))
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
        else:
            blocks = [pixels[y : y + cut] for y in range(0, height, cut)]
        where, sizes = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8)).astype(np.uint8)
            data = pack(b.tobytes(), how)
            where.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [how]), (262, 3, [1]), (277, 3, [1])]
        if isinstance(cut, tuple):
            fields += [(317, 3, [predictor]), (322, 4, [cut[0]]), (323, 4, [cut[1]]), (324, 4, where), (325, 4, sizes)]
        else:
            fields += [(273, 4, where), (278, 4, [cut]), (279, 4, sizes), (317, 3, [predictor])]
        entries = b""
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}{FIELD[kind][1]}", *values)
            if len(body) > 4:
                spot = len(out)
                out += body
                body = struct.pack(order + "I", spot)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


#: How the thirds of a stored payload are laid out: compression, predictor, tile size or rows per strip.
LAYOUTS = ((DEFLATE, 1, 64), (LZW, 2, (64, 16)), (PACKBITS, 1, 32))


def store(payload: bytes, width: int = 64, page_rows: int = 512) -> bytes:
    """A payload whose length is a multiple of three times ``width``, as three runs of pages of at most ``page_rows`` rows.

    Each third of the bytes has a layout of its own, so every payload, however short, is a file of strips
    and tiles, of deflate, LZW and PackBits, with and without a predictor.
    """
    pixels = np.frombuffer(payload, np.uint8).reshape(len(LAYOUTS), -1, width)
    cuts = range(0, pixels.shape[1], page_rows)
    return write_tiff([(part[y : y + page_rows], *how) for part, how in zip(pixels, LAYOUTS, strict=True) for y in cuts])


def feature(pages: list[np.ndarray]) -> str:
    """Pages, mean, deviation and entropy of the samples, and a 64-bit average hash."""
    counts = sum((np.bincount(p.ravel(), minlength=256) for p in pages), np.zeros(256, np.int64))
    n, v = int(counts.sum()), np.arange(256)
    mean = int((counts * v).sum()) / n
    dev = max(0.0, int((counts * v * v).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    flat = np.concatenate([p.ravel() for p in pages])
    sums = np.add.reduceat(flat, np.arange(64) * len(flat) // 64, dtype=np.int64)
    sizes = np.diff(np.append(np.arange(64) * len(flat) // 64, len(flat)))
    mark = sum(1 << i for i, on in enumerate((sums > mean * sizes).tolist()) if on)
    return f"pages={len(pages)};mean={mean:.6f};dev={dev:.6f};entropy={entropy:.6f};hash={mark:016x}"


# ------------------------------------------------------------------ DataFrame operators


def stored_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 192) -> DataFrame:
    """``key``, ``n_bytes`` and the text's UTF-8 bytes as a ``tiff``; null counts as empty.

    The payload is padded with blanks to a positive multiple of ``width``.  No shuffle; repeated
    rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raws = [(x.as_py() or "").encode("utf-8") for x in part.column(1)]
                forms = [store(r + b" " * ((-len(r) % width) or width * (not r)), width // len(LAYOUTS)) for r in raws]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raws), pa.int64()), pa.array(forms, pa.binary())],
                    names=[key, "n_bytes", "tiff"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, tiff binary")


def pages(media: DataFrame, key: str, column: str = "tiff", keep: tuple[str, ...] = (), most_bytes: int = 1 << 30) -> DataFrame:
    """One row per page: key, ``keep``, place, shape, encoding and samples (C order, native byte order).

    Rows of a file come one after another, in chain order.  A file that is null, can't be decoded or
    has a page of over ``most_bytes`` gives, after the pages before the fault, one row with ``page`` -1
    and its ``error``; a file without a page gives such a row too.
    """
    names = [key, *keep, "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "sample_format", "pixels", "error"]
    kinds = [media.schema[c].dataType.simpleString() for c in (key, *keep)]
    shape = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, sample_format int"
    types = [pa.int32()] * 7 + [pa.bool_(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner, size = [], [], 0

            def made() -> pa.RecordBatch:
                at = pa.array(owner, pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(1 + len(keep))), *cols], names=names)

            for i, x in enumerate(batch.column(1 + len(keep))):
                fault, n = None, 0
                try:
                    data = x.as_py()
                    if data is None:
                        raise BadTiff("null")
                    for p in read_pages(data, most_bytes):
                        raw = p.pixels.tobytes()
                        rows.append((p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.sample_format, raw, None))
                        owner.append(i)
                        n, size = n + 1, size + len(raw)
                        if size > 16 << 20:
                            yield made()
                            rows, owner, size = [], [], 0
                    if not n:
                        raise BadTiff("no page")
                except (BadTiff, struct.error, ValueError, IndexError, OverflowError, MemoryError) as bad:
                    fault = f"{type(bad).__name__}: {bad}"
                if fault:
                    rows.append((-1, *[None] * 9, fault))
                    owner.append(i)
            if rows:
                yield made()

    schema = ", ".join(f"`{c}` {t}" for c, t in zip((key, *keep), kinds, strict=True))
    return media.select(key, *keep, column).mapInArrow(run, f"{schema}, {shape}, pixels binary, error string")


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads each stored payload back page by page (``pages``) and describes it; one row per file.

    The pages of a file follow one another in the task that decoded them, so nothing is shuffled.  A file
    that can't be decoded raises ``BadTiff``: a payload must not vanish.
    """
    from taproot.llm.common import F

    kind = media.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # key, n_bytes, media_bytes, media_sha256 of the file at hand, as slices of one row
        read: list[bytes] = []

        def done() -> pa.RecordBatch:
            raw = b"".join(read)
            described = [pa.array([len(raw)]), pa.array([hashlib.sha256(raw).hexdigest()]), pa.array([zlib.crc32(raw[-16:])], pa.int64())]
            own, n_bytes, media_bytes, media_sha = held
            feats = pa.array([feature([np.frombuffer(p, np.uint8) for p in read])])
            return pa.RecordBatch.from_arrays([own, n_bytes, *described, media_bytes, media_sha, feats], names=names)

        def together(ready: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

        for batch in batches:
            ready = []
            for i, (page, raw, error) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5), batch.column(6).to_pylist(), strict=True)):
                if error is not None:
                    raise BadTiff(error)
                if page == 0:
                    if held:
                        ready.append(done())
                    held, read = [batch.column(k).slice(i, 1) for k in range(4)], []
                read.append(raw.as_py())
            yield from together(ready)
        if held:
            yield done()

    files = media.select(key, "n_bytes", F.octet_length("tiff").cast("bigint").alias("media_bytes"), F.sha2("tiff", 256).alias("media_sha256"), "tiff")
    rows = pages(files, key, "tiff", ("n_bytes", "media_bytes", "media_sha256")).select(key, "n_bytes", "media_bytes", "media_sha256", "page", "pixels", "error")
    shape = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"
    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, {shape}, feature string")
