"""Byte-level BPE over whole texts, with a segment tree that finds the next merge."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

NONE = 1 << 62
#: White space of the pattern as Unicode has it; the four separators U+001C..1F are not in it.
SPACE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


#: Below this one all releases agree.
FIRST_RARE = "\u0558"


def spelled(pattern: str, space: str, letter: str, digit: str) -> str:
    """``pattern`` with its three classes spelled out; they may stand in a negated set."""
    inside = f"[^{space}{letter}{digit}]"
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", "\0").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
    return pattern.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]").replace("\0", inside)


@lru_cache(maxsize=4)
def library_class(name: str) -> str:
    """The code points of a class as ranges, asked of the public library in one call."""
    import tiktoken

    ask = tiktoken.Encoding("ask", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = sorted(map(ord, bytes(ask.encode_ordinary("".join(points))).decode("utf-8")))
    ranges, start = [], None
    for a, b in zip(found, [*found[1:], -1], strict=True):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(f"{chr(start)}-{chr(a)}")
            start = None
    return "".join(ranges)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, the leftmost pair of least rank merged first.

    A segment tree over byte positions holds at its leaf ``i`` the rank of the pair that begins at
    the live part ``i``, with ``i`` in the low bits; inner nodes hold the minimum, so the root is
    the leftmost least pair.  A merge kills one position and changes three leaves at most (the part
    itself, the dead one, the live neighbour before), each a walk of logarithmic length upwards.
    """
    n, get = len(piece), ranks.get
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    end = list(range(1, n + 1))  # of the part that begins at i
    prev = list(range(-1, n - 1))
    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        j = end[i]
        end[i] = m = end[j]
        changed = [(j, NONE)]
        if m < n:
            prev[m] = i
            r = get(piece[i : end[m]])
            changed.append((i, NONE if r is None else r << 32 | i))
        else:
            changed.append((i, NONE))
        if (h := prev[i]) >= 0:
            r = get(piece[h:m])
            changed.append((h, NONE if r is None else r << 32 | h))
        for leaf, value in changed:
            k = size + leaf
            tree[k] = value
            k >>= 1
            while k:
                x, y = tree[2 * k], tree[2 * k + 1]
                if y < x:
                    x = y
                if tree[k] == x:
                    break
                tree[k] = x
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBPE:
    """Encoder and decoder for one rank file and one splitting pattern.

    ``encode`` splits a text by the pattern and merges each match separately; special tokens are
    plain text.  Text that no match covers is skipped, as the public library does.  Short pieces
    are kept in a bounded cache of two generations, as text repeats its words.
    """

    KEEP, LONGEST = 250_000, 48

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pattern = spelled(pattern, SPACE, r"\p{L}", r"\p{N}")
        self.plain = regex.compile(self.pattern, regex.V0).findall
        self.rare = re.compile(f"[{FIRST_RARE}-\U0010ffff]").search
        self.source, self.exact = pattern, None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.decimal = {v: str(v) for v in ranks.values()}

    def split(self, text: str) -> list[str]:
        """The matches of the pattern.  Releases of Unicode differ on letters and digits from
        U+0558 on, so a text that reaches there is split by the public library's own classes."""
        if text.isascii() or not self.rare(text):
            return self.plain(text)
        if self.exact is None:
            import regex

            self.exact = regex.compile(spelled(self.source, SPACE, *map(library_class, (r"\p{L}", r"\p{N}"))), regex.V0).findall
        return self.exact(text)

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text)
        if ids is None:
            raw = text.encode("utf-8")
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(merged(raw, self.ranks))
        if len(text) <= self.LONGEST:
            if len(self.cache) >= self.KEEP:
                self.older, self.cache = self.cache, {}
            self.cache[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, piece, out = self.cache.get, self.piece, []
        for x in self.split(text):
            out += get(x) or piece(x)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(name: str, pattern: str, shipped: bool) -> ByteBPE:
    return ByteBPE(load_ranks(SparkFiles.get(name) if shipped else name), pattern)


def encode(
    docs: DataFrame, rank_path: str, pattern: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: bool = False, ship: bool = False
) -> DataFrame:
    """Encodes and decodes every whole text of ``docs``; one row per input row, no shuffle.

    Columns: ``keep``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``.
    A null text counts as an empty one, which has no tokens.  Repeated rows stay repeated.  Other
    columns of ``docs`` are not read.  ``ship`` sends the rank file to executors that lack it.
    """
    spark = docs.sparkSession
    if ship:
        spark.sparkContext.addFile(rank_path)
    where = rank_path.rpartition("/")[2] if ship else rank_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(where, pattern, ship)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b, all_ids = [], [], [], []
            for x in batch.column(len(keep)):
                t = bpe.encode(x.as_py() or "")
                n.append(len(t))
                a.append(sha(",".join(map(bpe.decimal.__getitem__, t)).encode()).hexdigest())
                b.append(sha(bpe.decode(t)).hexdigest())
                if ids:
                    all_ids.append(t)
            made = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if ids:
                made.append(pa.array(all_ids, pa.list_(pa.int32())))
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)

    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(*keep, text).mapInArrow(run, schema)
