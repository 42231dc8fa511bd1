"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame a record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from taproot.llm.common import F, hash_sample, loosened, written

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
STAMP = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Names every record must carry, by the standard.
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class BadWarc(ValueError):
    pass


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


# ------------------------------------------------------------------ frames


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame that begins at ``at``, found from its block headers."""
    start, n = at, len(data)
    if at + 5 > n or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise BadWarc("no frame where a record should begin")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (1 if single and not flags >> 6 else (0, 2, 4, 8)[flags >> 6])
    last = 0
    while not last:
        if at + 3 > n:
            raise BadWarc("a frame is cut off")
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise BadWarc("a block of reserved type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > n:
        raise BadWarc("a frame is cut off")
    return at - start


def dictionary_frame(body: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(body)) + body


def frames(archive: bytes, most: int = 1 << 31) -> Iterator[bytes]:
    """The content of each frame, one after another; the dictionary is loaded from the first.

    The dictionary may itself be compressed.  Later skippable frames are passed over.  A frame must
    state its content's size, and that size must be what comes out.
    """
    import zstandard

    data, at, n = memoryview(archive), 0, len(archive)
    known = None
    if n >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        (size,) = struct.unpack_from("<I", data, 4)
        if 8 + size > n:
            raise BadWarc("the dictionary is cut off")
        body, at = bytes(data[8 : 8 + size]), 8 + size
        try:
            if size >= 4 and struct.unpack_from("<I", body)[0] == FRAME_MAGIC:
                body = zstandard.ZstdDecompressor().decompress(body, max_output_size=most)
            known = zstandard.ZstdCompressionDict(body) if body else None
        except zstandard.ZstdError as bad:
            raise BadWarc(str(bad)) from bad
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while at < n:
        if at + 8 <= n and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > n:
                raise BadWarc("a skippable frame is cut off")
            continue
        size = frame_size(data, at)
        frame = data[at : at + size]
        stated = zstandard.frame_content_size(frame)
        if stated < 0 or stated > most:
            raise BadWarc("a frame states no size or too large a one")
        try:
            raw = reader.decompress(frame, max_output_size=max(stated, 1)) if stated else b""
        except zstandard.ZstdError as bad:
            raise BadWarc(str(bad)) from bad
        if len(raw) != stated:
            raise BadWarc("a frame's size is wrong")
        yield raw
        at += size


# ------------------------------------------------------------------ records


class Headers(dict):
    """Header values by name, whatever the case of its letters."""

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(name.lower(), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


@dataclass
class Record:
    headers: Headers
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"].lower()

    def payload(self) -> bytes:
        """What follows the HTTP head of a response or request; a revisit has none, other records are payload throughout."""
        if self.kind == "revisit":
            return b""
        if self.kind not in ("response", "request") or not self.headers.get("Content-Type", "application/http").lower().startswith("application/http"):
            return self.block
        head, cut, body = self.block.partition(CRLF * 2)
        if self.kind == "request":
            return body
        if not cut or not head.startswith(b"HTTP/"):
            raise BadWarc("a response has no HTTP head")
        for line in head.split(CRLF)[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit() and int(value) != len(body) and "WARC-Truncated" not in self.headers:
                raise BadWarc("HTTP length and payload differ")
        return body


def as_text(raw: bytes) -> str:
    """UTF-8, as the standard has it, or else the bytes one by one."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def matches(stated: str, raw: bytes) -> bool:
    """Whether a ``name:value`` digest is that of ``raw``, in hex or base32; of an algorithm not known here, nothing is said."""
    name, _, value = stated.strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    own = hashlib.new(name, raw).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def render(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> Record:
    """One record of any type, checked: version, mandatory headers, block length, ending and digests.

    Names are read in any case, and a line that begins with a blank goes on with the one before.
    """
    head, cut, rest = raw.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not cut or lines[0] not in (b"WARC/1.0", VERSION):
        raise BadWarc("no WARC version line")
    headers, last = Headers(), None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last is not None:
            headers[last] = f"{headers[last]} {as_text(line).strip()}"
            continue
        last, colon, value = as_text(line).partition(":")
        if not colon or not last.strip():
            raise BadWarc("a header line has no colon")
        headers[last := last.strip()] = value.strip()
    if gone := [x for x in MANDATORY if x not in headers]:
        raise BadWarc(f"no {', '.join(gone)}")
    if not headers["Content-Length"].isdigit():
        raise BadWarc("Content-Length is no number")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != CRLF * 2:
        raise BadWarc("Content-Length and block differ")
    record = Record(headers, rest[:size])
    if "WARC-Block-Digest" in headers and not matches(headers["WARC-Block-Digest"], record.block):
        raise BadWarc("block digest differs")
    if record.kind != "revisit" and "WARC-Payload-Digest" in headers and not matches(headers["WARC-Payload-Digest"], record.payload()):
        raise BadWarc("payload digest differs")
    if record.kind == "revisit" and not any(x in headers for x in ("WARC-Refers-To", "WARC-Refers-To-Target-URI")):
        raise BadWarc("a revisit refers to nothing")
    return record


def info_record(software: str) -> bytes:
    """A warcinfo record for the beginning of an archive."""
    block = f"software: {software}\r\nformat: WARC File Format 1.1\r\n".encode()
    return render([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"info/{software}")), ("WARC-Date", STAMP), ("Content-Type", "application/warc-fields")], block)


def page_record(page_id, url: str | None, payload: bytes, refers_to, name: str | None = None, refers_name: str | None = None, size: int | None = None, sha1: str | None = None) -> bytes:
    """The record of a page: a response, or a revisit of the page ``refers_to`` without payload.

    ``name`` makes the record's id, ``refers_name`` that of the record referred to; both follow from the
    page ids where they are not given.  A revisit can do with the payload's ``size`` and ``sha1`` alone.
    """
    uri = url or f"urn:page:{page_id}"
    size = len(payload) if size is None else size
    common = [
        ("WARC-Record-ID", record_id(name or f"page/{page_id}")),
        ("WARC-Date", STAMP),
        ("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + (sha1 or digest(payload))),
        ("X-Page-Id", str(page_id)),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = HTTP % size
    if refers_to is None:
        block = head + payload
        return render([("WARC-Type", "response"), *common, ("WARC-Block-Digest", "sha1:" + digest(block))], block)
    more = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_name or f"page/{refers_to}")), ("X-Refers-To-Page", str(refers_to))]
    return render([("WARC-Type", "revisit"), *common, *more, ("WARC-Block-Digest", "sha1:" + digest(head))], head)


# ------------------------------------------------------------------ DataFrame operators


def train_dictionary(pages: DataFrame, *, samples: int = 400, size: int = 16_384) -> bytes:
    """A compression dictionary from about ``samples`` pages, those of the least hashed ids.

    It bears on the archives' size alone.  Fewer than eight samples give no dictionary.
    """
    import zstandard

    some = hash_sample(pages.where(F.length("html") > 0).select("page_id", "html"), ["page_id", "html"], samples).select("html")
    rows = sorted(some.collect())
    if len(rows) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, [page_record(i, None, r.html.encode(), None) for i, r in enumerate(rows)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r.html.encode() for r in rows)[:size]


#: Copies of one row that one task turns into records.
COPIES = 4096


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row per row: ``page_id, url, html, refers_to`` and what the record needs besides.

    Of equal payloads the least ``page_id`` is referred to; of rows that repeat that id, the one of the
    least ``row`` digest, and of rows that repeat wholly, the first copy.  ``html`` is null in revisits,
    which have only ``n_bytes`` and ``sha``.  ``row`` and ``copy`` tell records apart, ``to_row`` names the
    row referred to.

    Digests alone are grouped by payload.  Whole rows are dealt once, by a digest of the row, with
    repeated ones combined in the tasks that read them; copies beyond ``COPIES`` are dealt out again
    without their payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    named = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.sha1(F.col("url").cast("binary")), F.lit("-")), "sha")
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha")).withColumn("row", F.sha1(named.cast("binary")))
    rows = keyed.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("sha").alias("sha"), F.first(F.octet_length("html")).cast("bigint").alias("n_bytes"), F.count(F.lit(1)).alias("copies"))
    firsts = (
        rows.where(F.col("n_bytes") >= least_bytes)
        .groupBy("sha")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.sum("copies").alias("n"))
        .where("n > 1 and first is not null")
        .select("sha", F.col("first.page_id").alias("to_page"), F.col("first.row").alias("to_row"))
    )
    marked = rows.join(loosened(firsts, "sha"), "sha", "left").select("row", "n_bytes", "copies", "to_page", "to_row")
    whole = keyed.select("row", F.struct("page_id", "url", "html", "sha").alias("page")).dropDuplicates(["row"])
    dealt = whole.join(marked, "row")

    def records(some: DataFrame, copy) -> DataFrame:
        again = F.col("to_row").isNotNull() & ((F.col("row") != F.col("to_row")) | (F.col("copy") > 0))
        return some.withColumn("copy", F.explode(copy)).select(
            "page.page_id", "page.url", F.when(~again, F.col("page.html")).alias("html"), F.when(again, F.col("to_page")).alias("refers_to"),
            "n_bytes", "page.sha", "row", "copy", F.when(again, F.col("to_row")).alias("to_row"),
        )

    most = F.lit(COPIES).cast("bigint")
    few = records(dealt, F.sequence(F.lit(0).cast("bigint"), F.least("copies", most) - 1))
    many = dealt.where(F.col("copies") > COPIES).withColumn("at", F.explode(F.sequence(most, F.col("copies") - 1, most)))
    spare = F.when(F.col("to_row").isNull(), F.col("page.html"))  # without a page to refer to, all copies are responses
    slim = many.select("row", F.struct("page.page_id", "page.url", spare.alias("html"), "page.sha").alias("page"), "n_bytes", "copies", "to_page", "to_row", "at")
    slim = slim.repartition(F.xxhash64("row", "at"))
    return few.union(records(slim, F.sequence(F.col("at"), F.least(F.col("at") + most, "copies") - 1)))


def archives(records: DataFrame, dictionary: bytes = b"", most_bytes: int = 4 << 20, level: int = 3, software: str | None = None) -> DataFrame:
    """Rows ``archive binary, records long``: whole .warc.zst files of about ``most_bytes`` before packing.

    With ``software`` each begins with a warcinfo record, which ``records`` counts too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        start = [dictionary_frame(dictionary)] + ([packer.compress(info_record(software))] if software else [])
        parts, raw_size, n = list(start), 0, len(start) - 1

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([b"".join(parts)], pa.binary()), pa.array([n], pa.int64())], names=["archive", "records"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to, n_bytes, sha, row, copy, to_row = (c[i].as_py() for c in batch.columns)
                name = f"page/{page_id}/{row}/{copy}"
                to = None if to_row is None else f"page/{refers_to}/{to_row}/0"
                raw = page_record(page_id, url, (html or "").encode("utf-8"), refers_to, name, to, n_bytes, base64.b32encode(bytes.fromhex(sha)).decode())
                parts.append(packer.compress(raw))
                raw_size, n = raw_size + len(raw), n + 1
                if raw_size >= most_bytes:
                    yield done()
                    parts, raw_size, n = list(start), 0, len(start) - 1
        if raw_size:
            yield done()

    columns = ["page_id", "url", "html", "refers_to", "n_bytes", "sha", "row", "copy", "to_row"]
    return records.select(*columns).mapInArrow(run, "archive binary, records bigint")


def read_archives(files: DataFrame, payloads: bool = False, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """One row per record of the ``archive`` column that is one of ``kinds`` (of all, if empty); every record is validated.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, ``uri``,
    ``record_id`` and ``payload``.  Length and digest of a revisit are those of the payload it stands for.
    Archives from elsewhere (``spark.read.format("binaryFile")``, whose ``content`` is the archive) have
    no page ids, and where they state no digest or length of a payload, it is worked out, or null in a
    revisit.  A faulty archive raises ``BadWarc``: a record must not vanish.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["uri", "payload", "record_id"] * payloads
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.binary(), pa.string()] * payloads

        def number(text: str | None) -> int | None:
            return int(text) if text and text.lstrip("-").isdigit() else None

        for batch in batches:
            for x in batch.column(0):
                rows = []
                for raw in frames(x.as_py()):
                    r = parse(raw)
                    if kinds and r.kind not in kinds:
                        continue
                    h, body = r.headers, r.payload()
                    again = r.kind == "revisit"
                    stated = number(h.get("X-Payload-Length"))
                    if not again and stated is not None and stated != len(body):
                        raise BadWarc("payload length differs")
                    name, _, value = h.get("WARC-Payload-Digest", "").partition(":")
                    sha = (value if name.lower() == "sha1" and len(value) == 32 else None) if again else digest(body)
                    row = [number(h.get("X-Page-Id")), stated if again else len(body), sha, r.kind, number(h.get("X-Refers-To-Page")) if again else None]
                    rows.append([*row, h.get("WARC-Target-URI"), body, h["WARC-Record-ID"]] if payloads else row)
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    shape = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.select("archive").mapInArrow(run, shape + ", uri string, payload binary, record_id string" * payloads)


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page, keeps the archives in the shared folder, and reads them back.

    A null html is an empty payload.  A null ``page_id`` is kept as null; it is never referred to, so
    that payloads which only such rows have are responses throughout.  Of rows that repeat a page whole
    or its id, one is the response and the others revisit it.  An empty table gives no archive and no
    row.  Further columns are not read.
    """
    dictionary = train_dictionary(pages)
    return read_archives(written(archives(with_revisits(pages, least_bytes), dictionary)))
