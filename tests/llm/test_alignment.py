import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

from taproot.llm import alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox", "", None, " ", "  two  spaces\n\n and\t tabs \r\n", "x▁y ▁",
    "naïve façade Ünïcödé Ωmega 漢字かな 😀‍👩 ﬁ", "don't you'll we've <|endoftext|> </s> <unk>", " nbsp  　wide  em ",
    "a\x1cb \x1c c\x85 d", "word " * 50, "longword" * 40, "12345 6,789.00 -- $$ ((a)) //", "The quick brown fox jumps over the lazy dog.", "\n", "a\n  b", "trailing space ",
    "ͰͲԱԲ ՘ՠ Ᲊᲊ \U00010d4a", "é combining",
]


def brute(texts):
    """Tokens of whole texts by the two libraries, intervals compared one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_lib.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    docs = []
    for t in texts:
        docs.append(None)
        if not t:
            continue
        a = a_lib.encode(" " + t, add_special_tokens=False).ids
        b = b_lib.encode(t)
        raw_a = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
        if b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        starts_a, starts_b = ends_a - [len(x) for x in raw_a], ends_b - [len(x) for x in raw_b]
        links = []
        for i in range(len(a)):
            over = np.flatnonzero(np.maximum(starts_a[i], starts_b) < np.minimum(ends_a[i], ends_b))
            links += [(a[i], b[j]) for j in over]
        common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, low = [], 0
        for c in common:
            inside = lambda ids, ends: ",".join(str(ids[k]) for k in np.flatnonzero((low < ends) & (ends <= c)))  # noqa: B023
            groups.append(inside(a, ends_a) + "|" + inside(b, ends_b))
            low = c
        docs[-1] = (len(a), len(b), groups, links)
    df = Counter(p for d in docs if d for p in set(d[3]))
    best = defaultdict(int)
    for (a, _), n in df.items():
        best[a] = max(best[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), len(links), sum(df[p] == best[p[0]] for p in links), sum(df[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return {r["doc_id"]: tuple(r[c] for c in COLS) for r in alignment.alignments(df, *PATHS).collect()}


def test_equals_whole_texts_aligned_by_brute_force(spark):
    # n_a, key and n are names the operator uses itself
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_a int, key string, n int").repartition(3)
    got = result(df)
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 8000 and doc_id < 100")
    rows = docs.orderBy("doc_id").collect()
    got = result(docs.repartition(5))
    assert [got[r["doc_id"]] for r in rows] == brute([r["text"] for r in rows])


def test_batches_and_shards_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").coalesce(1)
    whole = result(df)
    monkeypatch.setattr(alignment, "BATCH", 64)
    assert result(df) == whole


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id bigint, text string")
    rows = alignment.alignments(df, *PATHS).collect()
    assert len(rows) == 3 and {r["count_sum"] for r in rows} == {3 * rows[0]["n_links"]}
    assert result(df.limit(0)) == {}
    assert result(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")) == {1: (0,) * 6 + ("",), 2: (0,) * 6 + ("",)}


def test_partial_counts_and_run_lengths(spark):
    rng = np.random.default_rng(5)
    parts = [np.unique(rng.integers(0, 3000, 700)) for _ in range(12)]
    rows = spark.createDataFrame([(bytearray(k.tobytes()), bytearray(np.ones(len(k), np.int64).tobytes())) for k in parts], "keys binary, df binary").repartition(3)
    partial = alignment.partial_counts(rows, most=900)
    index = [tuple(r) for r in alignment.count_shards(partial, 4).where("rows > 0").select("first", "last", "rows", "path").collect()]
    keys, n = np.unique(np.concatenate(parts), return_counts=True)
    assert len(index) > 1 and sum(r[2] for r in index) == len(keys)
    shards = alignment.Shards(alignment.shared_dir(spark), index)
    assert (shards.counts(keys) == n).all()
    assert (shards.counts(np.array([-5, 10_000])) == 0).all()


def test_words_equal_whole_texts():
    tool = alignment.aligner(*PATHS)
    assert tool.words_part and tool.quick is not None
    for t in TEXTS:
        if t:
            assert " " + t == "".join(" " + w for w in tool.words(t))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", None])], names=["i", "t"])
    assert [x.num_rows for x in alignment.batches_of_texts(iter([batch, batch, batch]), 1, 1)] == [2, 2, 2]


def test_long_rows_are_held_a_few_at_a_time(spark):
    """Row groups end by size and not after 100 rows; the looking up of counts runs in a write, with its small Arrow batches."""
    from pathlib import Path

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from taproot.llm.common import LONG_ROWS, written

    rows = spark.range(90, numPartitions=1).select(F.expr("cast(concat_ws('', transform(sequence(1, 12000), k -> sha2(concat(id, k), 256))) as binary)").alias("words"))
    table = written(rows, LONG_ROWS)
    (file,) = Path(table._taproot_path.removeprefix("file://")).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 2 and all(meta.row_group(k).total_byte_size < 40 << 20 for k in range(meta.num_row_groups))
    out = alignment.alignments(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), *PATHS)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1
