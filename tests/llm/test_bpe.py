import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from taproot.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
HARD = [
    "", " ", "a", "  \n\n  x", "'s'll don't I'VE", "\x1c\x1d x\x85y", "漢字かな" * 50, "᠎ x", "<|endoftext|>", "x  \t",
    "a" * 4000, "ab" * 3000, "՘ab ֋", "₏12 a₂3", "é" * 999, "\U0003fc3f x", "0123456789" * 40, "   　z",
]


@pytest.fixture(scope="module")
def both():
    mine = bpe.ByteBPE(bpe.load_ranks(PATH), P.PATTERN)
    return mine, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})


def test_equals_library(both):
    mine, theirs = both
    r = random.Random(8)
    pool = "aeinst THE  \n.,'é漢0१ßñ​́🙂"
    texts = HARD + ["".join(r.choice(pool) for _ in range(r.randint(1, 300))) for _ in range(400)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert mine.decode(ids) == theirs.decode_bytes(ids)


def test_leftmost_pair_goes_first():
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 256, b"ba": 257, b"aba": 258, b"abab": 259}
    for t in (b"ababab", b"babab", b"aabb", b"b", b""):
        parts = [t[i : i + 1] for i in range(len(t))]
        while True:
            pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merged(t, ranks) == [ranks[p] for p in parts]


def test_cache_turns_over(both):
    mine, theirs = both
    small = bpe.ByteBPE(mine.ranks, P.PATTERN)
    small.KEEP = 3
    text = " ".join(f"word{i % 11}x" for i in range(200))
    assert small.encode(text) == theirs.encode_ordinary(text) and len(small.cache) <= 3


def test_operator(spark, both):
    theirs = both[1]
    rows = [*enumerate(HARD), (100, None), (100, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = bpe.encode(docs, PATH, P.PATTERN, ids=True).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for g in got:
        raw = (texts[g.doc_id] or "").encode()
        ids = theirs.encode_ordinary(texts[g.doc_id] or "")
        assert (g.n_tokens, g.ids) == (len(ids), ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    shipped = bpe.encode(docs, PATH, P.PATTERN, ship=True)
    assert sorted(r.n_tokens for r in shipped.collect()) == sorted(g.n_tokens for g in got)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
