"""Alignment of two tokenizers over a corpus: which tokens overlap, and in how many documents each pair does."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.llm.bpe import FIRST_RARE
from taproot.llm.common import LONG_ROWS, discard, shared_dir, written

#: A's id in the high half of a pair's key, B's in the low one.
HIGH = 32
#: Texts are aligned together up to so many characters; what is kept of words grows with a batch, not with a table.
BATCH = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the alignment of whole texts word by word.

    A text is cut before each space that follows a non-space.  No token of either tokenizer reaches
    over such a place (asserted for B's pieces; A's pattern begins a new match there), so a word is
    aligned once and its links are counted as often as it occurs.
    """

    KEEP = 50_000

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_path = byte_path
        special = {t["content"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        # ids in the order of the merges are ranks; the faster public encoder then gives the same ids
        merged = [ranks[bytes(map(alphabet.__getitem__, "".join(m.split(" ") if isinstance(m, str) else m)))] for m in spec["model"]["merges"]]
        self.quick = None
        if all(x < y for x, y in zip(merged, merged[1:])) and sorted(ranks.values()) == list(range(len(ranks))):
            import public_tokenizers

            self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.rare = re.compile(f"[{FIRST_RARE}-\U0010ffff]").search

        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.words_part = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space_id = self.b.piece_to_id("▁")
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.cut = re.compile(r"(?<=\S) ").split
        self.before_space = re.compile(r"[^\S ] ").search
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    @cached_property
    def library(self):
        """A's own library, which most texts don't need."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.byte_path)
        out.encode_special_tokens = True
        return out

    def words(self, text: str) -> list[str]:
        """``text`` cut at the spaces that begin a word; each word stands without that space."""
        if not self.words_part:
            return [text]
        if "  " in text or text[0] == " " or self.before_space(text):
            return self.cut(text)
        return text.split(" ")

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text by A; its library alone knows its classes of rare letters."""
        if self.quick is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        ids = [None if self.rare(t) else self.quick.encode_ordinary(t) for t in texts]
        odd = [i for i, x in enumerate(ids) if x is None]
        if not odd:
            return ids
        for i, e in zip(odd, self.library.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        return ids

    def align(self, words: list[str]) -> list[tuple]:
        """For each word with the space before it: ``(n_a, n_b, n_groups, groups, links)``, links as packed pairs.

        Links are None where either side's bytes are not those of the word.
        """
        out, names, a_bytes, b_bytes = [], self.names, self.a_bytes, self.b_bytes
        both = zip(words, self.encode_a([" " + w for w in words]), self.b.encode(words, num_threads=1), strict=True)
        for w, a, b in both:
            if not w:
                b = [self.space_id]  # the library adds no space to an empty text
            parts_a, parts_b = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
            raw = b" " + w.encode()
            if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
                out.append((0, 0, 0, "", None))
                continue
            links, groups, here_a, here_b = [], [], [], []
            i = j = 0
            end_a, end_b = len(parts_a[0]), len(parts_b[0])
            here_a.append(names[a[0]])
            here_b.append(names[b[0]])
            while True:
                links.append(a[i] << HIGH | b[j])
                step = end_a - end_b
                if step == 0:
                    groups.append(",".join(here_a) + "|" + ",".join(here_b))
                    here_a, here_b = [], []
                if step <= 0:
                    i += 1
                    if i == len(a):
                        break
                    end_a += len(parts_a[i])
                    here_a.append(names[a[i]])
                if step >= 0:
                    j += 1
                    end_b += len(parts_b[j])
                    here_b.append(names[b[j]])
            out.append((len(a), len(b), len(groups), ";".join(groups), tuple(links)))
        return out

    def records(self, words: list[str]) -> list[tuple]:
        """``align`` with a bounded memory of two generations, as a corpus repeats its words."""
        new, old = self.new, self.old
        found = [new.get(w) or old.get(w) for w in words]
        missing = [i for i, r in enumerate(found) if r is None]
        for i, r in zip(missing, self.align([words[i] for i in missing]), strict=True):
            found[i] = r
            if len(words[i]) <= 32:
                if len(new) >= self.KEEP:
                    self.old, self.new = new, {}
                    new = self.new
                new[words[i]] = r
        return found


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def gathered(cuts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of the runs ``cuts[w] .. cuts[w + 1]`` of all ``which``, one after the other."""
    size = cuts[which + 1] - cuts[which]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(cuts[which] - ends + size, size)


def run_sums(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each run."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def batches_of_texts(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.Table]:
    """Arrow batches put together up to about ``most`` bytes of text."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(text).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: One row of ``aligned``: what its documents have in common, and lists with a place for each document.
WORDS_SCHEMA = "ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, sizes binary, words binary, link_sizes binary, links binary, keys binary, df binary"


def aligned(docs: DataFrame, byte_path: str, piece_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Batches of documents, encoded and aligned: ``WORDS_SCHEMA``.

    ``words`` numbers the words of a document within its batch, ``links`` the pair keys of a word within
    ``keys``, which are sorted; ``df`` says in how many documents of the batch a key occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_path, piece_path)
        for rows in batches_of_texts(batches, 1, BATCH):
            seen, coded = Numbered(), []
            number = seen.__getitem__
            for x in rows.column(1):
                t = x.as_py()
                coded.append(list(map(number, tool.words(t))) if t else [])
            records = tool.records(list(seen))
            bad = {i for i, r in enumerate(records) if r[4] is None}
            if bad:
                # bytes differ in a word: the document's own bytes decide, aligned as a whole
                for d, codes in enumerate(coded):
                    if not bad.isdisjoint(codes):
                        whole = tool.align([rows.column(1)[d].as_py()])[0]
                        if whole[4] is None:
                            coded[d] = []
                        else:
                            coded[d] = [len(records)]
                            records.append(whole)
            strings = [r[3] for r in records]
            sizes = np.array([len(c) for c in coded], np.int64)
            words = np.fromiter(chain.from_iterable(coded), np.int64, int(sizes.sum()))
            per_word = np.array([r[:3] for r in records], np.int64).reshape(-1, 3)
            link_sizes = np.array([len(r[4] or ()) for r in records], np.int64)
            flat = np.fromiter(chain.from_iterable(r[4] or () for r in records), np.int64, int(link_sizes.sum()))
            keys, links = np.unique(flat, return_inverse=True)
            cuts, link_cuts = bounds(sizes), bounds(link_sizes)
            # a document's distinct words, then its distinct pairs
            mine = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(records), 1) + words)
            owner, word = mine // max(len(records), 1), mine % max(len(records), 1)
            pairs = np.unique(np.repeat(owner, link_sizes[word]) * max(len(keys), 1) + links[gathered(link_cuts, word)])
            df = np.bincount(pairs % max(len(keys), 1), minlength=len(keys))
            digests = [hashlib.sha256(";".join(map(strings.__getitem__, c)).encode()).hexdigest() if c else "" for c in coded]
            lists = [run_sums(cuts, per_word[words, c]) for c in range(3)] + [run_sums(cuts, link_sizes[words])]
            blobs = [sizes.astype(np.uint32), words.astype(np.uint32), link_sizes.astype(np.uint32), links.astype(np.uint32), keys, df.astype(np.int64)]
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0).combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [ids, *[one(v, pa.int64()) for v in lists], one(digests, pa.string()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]],
                names=["ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes", "words", "link_sizes", "links", "keys", "df"],
            )

    return docs.select(key, text).mapInArrow(run, WORDS_SCHEMA.format(id=docs.schema[key].dataType.simpleString()))


def partial_counts(batches: DataFrame, most: int = 1 << 21) -> DataFrame:
    """``key, n``: sorted document counts of a partition's batches, summed up to ``most`` keys at a time."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, np.concatenate([n for _, n in parts]))
            return keys, total

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(keys), 1 << 16):
                cut = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut]), pa.array(n[cut])], names=["key", "n"])

        held, size = [], 0
        for b in rows:
            for keys, n in zip(b.column(0), b.column(1), strict=True):
                held.append((np.frombuffer(keys.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)))
                size += len(held[-1][0])
                if size > most:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*summed(held))

    return batches.select("keys", "df").mapInArrow(run, "key bigint, n bigint")


def _store(base: str):
    """A file system and a folder: that of ``spark.checkpoint.dir``."""
    from pyarrow import fs

    kind, root = fs.FileSystem.from_uri(base if "://" in base else "file://" + base)
    return kind, f"{root.rstrip('/')}/taproot-pairs"


def count_shards(partial: DataFrame, partitions: int | None = None) -> DataFrame:
    """Global counts in sorted shards of the shared folder: ``first, last, rows, path, best``.

    Keys are dealt by ranges and sorted; a shard sums runs of equal keys as they stream by and is two
    arrays, keys and counts.  ``best`` has the highest count of each A id as ``(id, count)``.  A task that runs twice writes
    files of its own, and only those of its committed row are read.
    """
    base = shared_dir(partial.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, root = _store(base)
        kind.create_dir(root, recursive=True)
        path = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files = [kind.open_output_stream(f"{path}.{x}") for x in ("keys", "counts")]
        rows, first, last, held, best = 0, None, None, 0, {}

        def put(keys: np.ndarray, n: np.ndarray) -> None:
            nonlocal rows, first
            if len(keys):
                first = int(keys[0]) if first is None else first
                rows += len(keys)
                files[0].write(keys.astype("<i8").tobytes())
                files[1].write(n.astype("<i8").tobytes())
                a = keys >> HIGH
                starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                for i, top in zip(a[starts].tolist(), np.maximum.reduceat(n, starts).tolist(), strict=True):
                    best[i] = max(best.get(i, 0), top)

        for b in batches:
            if not b.num_rows:
                continue
            keys, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[starts], np.add.reduceat(n, starts)
            if last is not None:  # the last run may go on
                if keys[0] == last:
                    n[0] += held
                else:
                    put(np.array([last]), np.array([held]))
            put(keys[:-1], n[:-1])
            last, held = int(keys[-1]), int(n[-1])
        if last is not None:
            put(np.array([last]), np.array([held]))
        for f in files:
            f.close()
        tops = [{"id": i, "n": n} for i, n in best.items()]
        cols = [pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([rows], pa.int64()), pa.array([path], pa.string())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([tops], pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])))], names=["first", "last", "rows", "path", "best"])

    n = partitions or int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = partial.repartitionByRange(n, "key").sortWithinPartitions("key")
    return ranged.mapInArrow(run, "first bigint, last bigint, rows bigint, path string, best array<struct<id: bigint, n: bigint>>")


class Shards:
    """Sorted count shards, opened when a key falls into them and looked up by binary search.

    In a folder that is mounted they are memory-mapped; in another store a shard is read as it is asked for.
    """

    def __init__(self, base: str, index: list[tuple[int, int, int, str]]):
        self.base, self.index = base, sorted(index)
        self.local = urlparse(base).scheme in ("", "file")

    def opened(self, path: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
        if self.local:
            return tuple(np.memmap(f"{path}.{x}", "<i8", "r", shape=(rows,)) for x in ("keys", "counts"))
        kind, _ = _store(self.base)
        return tuple(np.frombuffer(kind.open_input_file(f"{path}.{x}").read(), "<i8") for x in ("keys", "counts"))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted ``keys``, all of which are there."""
        out = np.zeros(len(keys), np.int64)
        for first, last, rows, path in self.index:
            s, e = np.searchsorted(keys, first), np.searchsorted(keys, last, "right")
            if s < e:
                known, n = self.opened(path, rows)
                at = np.searchsorted(known, keys[s:e])
                out[s:e] = n[np.minimum(at, rows - 1)] * (known[np.minimum(at, rows - 1)] == keys[s:e])
        return out


def alignments(docs: DataFrame, byte_path: str, piece_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's alignment and how common its links are in the whole table.

    Columns ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is found in as
    many documents as any of its A id), ``count_sum`` (documents of its pair, over links) and
    ``groups_sha256``.  A text that is null or empty, or whose tokens don't give its bytes back, has
    zeros and ''.  Repeated rows and ids stay and count as documents of their own; other columns are not
    read.  Texts are encoded once; keys of pairs pass one shuffle, documents none.  What is broadcast is
    one row a shard and one count for each id of A.
    """
    spark = docs.sparkSession
    batches = written(aligned(docs, byte_path, piece_path, key=key, text=text), LONG_ROWS)
    partial = written(partial_counts(batches))
    shards = written(count_shards(partial))
    discard(partial)
    index = [tuple(r) for r in shards.where("rows > 0").select("first", "last", "rows", "path").collect()]
    tops = shards.select(F.explode("best").alias("b")).groupBy("b.id").agg(F.max("b.n").alias("n")).collect()
    best = np.zeros(max((r["id"] for r in tops), default=0) + 1, np.int64)
    for r in tops:
        best[r["id"]] = r["n"]
    discard(shards)
    base = shared_dir(spark)
    lists = ["n_a", "n_b", "n_groups", "n_links"]
    blobs = [("sizes", np.uint32), ("words", np.uint32), ("link_sizes", np.uint32), ("links", np.uint32), ("keys", np.int64)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Shards(base, index)
        for b in rows:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                sizes, words, link_sizes, links, keys = (np.frombuffer(at[n][r].as_py(), kind) for n, kind in blobs)
                n = table.counts(keys)
                top = n == best[keys >> HIGH]
                link_cuts, cuts = bounds(link_sizes), bounds(sizes)
                per_word = [run_sums(link_cuts, v[links]) for v in (top, n)]
                sums = [run_sums(cuts, v[words]) for v in per_word]
                cols = [at["ids"][r].values, *[at[c][r].values for c in lists], pa.array(sums[0]), pa.array(sums[1]), at["groups_sha256"][r].values]
                yield pa.RecordBatch.from_arrays(cols, names=[key, *lists, "n_best", "count_sum", "groups_sha256"])

    kept = batches.select("ids", *lists, "groups_sha256", *[n for n, _ in blobs])
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in [*lists, "n_best", "count_sum"]) + ", groups_sha256 string"
    # a write, so that Arrow gets rows of some MB a few at a time and not all of a partition's at once
    out = written(kept.mapInArrow(run, schema))
    discard(batches)
    return out
