"""Secret scans in DataFrame functions: patterns, and a battery of randomness tests.

Base findings are three patterns.  The battery adds tokens that look drawn at random.  For each run
of at least ``LEAST`` characters of encoded text an encoding is inferred (hex, base32 or base64) and
three tests ask whether its symbols are uniform and independent: a chi-squared test over the
encoding's alphabet, a runs test about the alphabet's middle, and lag-one serial correlation.  Words
and numbers fail them.  What passes all three must also be a discovery against the hypothesis of
ordinary text, whose chi-squared statistic grows with length: p-values of all candidates of a
document, 1 where the battery fails, go through a Benjamini-Hochberg step weighted by length, so that
short tokens, which no test can tell from words, cannot carry one another.

Every step is linear in the text but for sorting and prefix sums, which add a logarithm: arrays are
never grown element by element, and a value that a lambda needs is worked out once, outside of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame

from taproot.llm.common import F

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: The same, but directories that lead to a token are matched apart from it, outside of the group.
PATHED = rf"(?<![A-Za-z0-9+/_=-])/?(?:[a-z][a-z_-]{{1,15}}/)+|([A-Za-z0-9+/_=-]{{{LEAST},}})"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Sums of squared and of cubed symbol shares of ordinary text (letters), and of numbers for hex.
TEXT = {"hex": (0.1, 0.01), "base32": (0.066, 0.0058), "base64": (0.066, 0.0058)}
#: Share of neighbouring letters and digits of ordinary text that change class; a capital before a small letter does not count.
SWITCH = {"hex": 0.15, "base32": 0.06, "base64": 0.2}
SPREAD = 1.5  # variance of such changes in ordinary text, over that of independent ones
KINDS = ("assign", "access", "hex", "random")
PIECE = 1024  # characters of the pieces that redaction cuts a text into
FOUND = "array<struct<start:int,stop:int,found:string>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once; a plain expression would be repeated inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(values: Column, join) -> Column:
    """Running results of an associative ``join`` over an array: each pass joins what stands 1, 2, 4, .. places before."""
    strides = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))

    def once(acc: Column, stride: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= stride, join(x, F.get(acc, i - stride))).otherwise(x))

    return F.aggregate(strides, values, once)


def located(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """All matches of ``pattern``, leftmost and non-overlapping, as structs of start, stop and text.

    A match is kept if its ``group`` has ``least`` characters; it uses up its text either way.
    Positions count code points.  They follow from the pieces between the matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.arrays_zip(whole.alias("w"), part.alias("p"), F.split(text, pattern, -1).alias("gap"))

    def spans(matches: Column) -> Column:
        stops = scan(F.transform(matches, lambda m: F.length(m["gap"]) + F.length(m["w"])), lambda x, y: x + y)
        placed = let(stops, lambda at: F.transform(matches, lambda m, i: F.struct(
            (F.get(at, i) - F.length(m["w"])).alias("start"), F.get(at, i).alias("stop"), F.when(F.length(m["p"]) >= least, m["w"]).alias("found"))))
        return F.filter(placed, lambda m: m["found"].isNotNull())

    full = let(F.filter(pieces, lambda m: m["w"].isNotNull()), spans)
    return F.when(text.rlike(pattern), full).otherwise(F.array().cast(FOUND))


def tail(z: Column) -> Column:
    """P(Z > z) of a standard normal; error below 1e-7 (a polynomial of Zelen and Severo)."""
    a = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * a)
    series = F.lit(1.330274429)
    for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = series * t + c
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * series * t
    return F.when(z >= 0, upper).otherwise(1 - upper)


def symbols(tokens: Column) -> Column:
    """Each token's inferred encoding and the values of its symbols."""

    def one(t: Column) -> Column:
        def read(x: Column, is_hex: Column, is_32: Column) -> Column:
            name = F.when(is_hex, "hex").when(is_32, "base32").otherwise("base64")
            plain = F.when(is_hex, F.lower(x)).otherwise(F.translate(x, "-_=", "+/"))
            alphabet = F.when(is_hex, ALPHABETS["hex"]).when(is_32, ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
            number = x.rlike("^[0-9]*$")  # a plain number is no encoded text
            letters = F.filter(F.split(F.when(number, "").otherwise(plain), ""), lambda c: c != "")
            values = let(alphabet, lambda a: F.transform(letters, lambda c: F.instr(a, c) - 1))
            return F.struct(t["start"].alias("start"), t["stop"].alias("stop"), name.alias("kind"), values.alias("v"))

        kinds = lambda x: F.struct(x.alias("x"), x.rlike("^([0-9a-f]+|[0-9A-F]+)$").alias("hex"), x.rlike("^[A-Z2-7]+$").alias("b32"))
        return let(F.regexp_replace(t["found"], "=+$", ""), lambda x: let(kinds(x), lambda k: read(k["x"], k["hex"], k["b32"])))

    return F.transform(tokens, one)


def statistics(tokens: Column) -> Column:
    """Counts behind the tests: squares of symbol counts, runs about the middle, serial products, class changes."""

    def one(t: Column) -> Column:
        size = F.when(t["kind"] == "hex", 16.0).when(t["kind"] == "base32", 32.0).otherwise(64.0)
        letters = F.when(t["kind"] == "hex", 10).when(t["kind"] == "base32", 26).otherwise(0)

        def class_of(x: Column) -> Column:
            """0 capitals, 1 small letters, 2 digits, 3 others; 1 and 2 where case says nothing."""
            wide = F.when(x < 26, 0).when(x < 52, 1).when(x < 62, 2).otherwise(3)
            return F.when(t["kind"] == "base64", wide).when((x < letters) == (t["kind"] == "hex"), 2).otherwise(1)

        def class_step(acc: Column, c: Column) -> Column:
            new = (c != acc["last"]) & ~((acc["last"] == 0) & (c == 1))
            pair = (c < 3) & (acc["last"] >= 0)
            return F.struct(
                (acc["switches"] + F.when(pair & new, 1.0).otherwise(0.0)).alias("switches"),
                (acc["pairs"] + F.when(pair, 1.0).otherwise(0.0)).alias("pairs"),
                F.when(c < 3, c).otherwise(acc["last"]).alias("last"),
            )

        def sorted_step(acc: Column, x: Column) -> Column:
            same = F.when(x == acc["last"], acc["same"] + 1).otherwise(1.0)
            return F.struct((acc["squares"] + 2 * same - 1).alias("squares"), same.alias("same"), x.alias("last"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["last"] < 0
            up, was = x * 2 >= size, acc["last"] * 2 >= size
            return F.struct(
                (acc["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"),
                (acc["runs"] + F.when(first | (up != was), 1.0).otherwise(0.0)).alias("runs"),
                (acc["sum"] + x).alias("sum"),
                (acc["square"] + x * x).alias("square"),
                (acc["cross"] + F.when(first, 0.0).otherwise(x.cast("double") * acc["last"])).alias("cross"),
                x.alias("last"),
            )

        pick = lambda *names: F.struct(*[F.lit(0.0).alias(n) for n in names], F.lit(-1).alias("last"))
        squares = F.aggregate(F.sort_array(t["v"]), pick("squares", "same"), sorted_step, lambda a: a["squares"])
        rest = F.aggregate(t["v"], pick("high", "runs", "sum", "square", "cross"), step)
        changes = F.aggregate(F.transform(t["v"], class_of), pick("switches", "pairs"), class_step)
        n = F.size(t["v"]).cast("double")
        return F.struct(
            *[t[x].alias(x) for x in ("start", "stop", "kind")], size.alias("k"), n.alias("n"), squares.alias("squares"),
            rest.alias("r"), changes.alias("c"), F.element_at(t["v"], 1).cast("double").alias("x1"), F.element_at(t["v"], -1).cast("double").alias("xn"),
        )

    return F.transform(F.filter(tokens, lambda t: F.size(t["v"]) >= 4), one)


def p_values(stats: Column, switches: bool = False) -> Column:
    """``random``: the least of the three tests' p-values times three; ``text``: that of ordinary text.

    The latter is of the chi-squared statistic; with ``switches``, of it and the class changes together
    (the sum of both deviates over the root of two), which tells short tokens from words better.
    """

    def by_kind(t: Column, of) -> Column:
        return F.when(t["kind"] == "hex", of("hex")).when(t["kind"] == "base32", of("base32")).otherwise(of("base64"))

    def one(t: Column) -> Column:
        n, k, r = t["n"], t["k"], t["r"]
        chi = k / n * t["squares"] - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        low = n - r["high"]
        mean = 1 + 2 * r["high"] * low / n
        var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        z_runs = (r["runs"] - mean) / F.sqrt(var)
        m = r["sum"] / n
        spread = F.greatest(r["square"] - n * m * m, F.lit(1e-9))
        serial = (r["cross"] - m * (2 * r["sum"] - t["x1"] - t["xn"]) + (n - 1) * m * m) / spread
        z_serial = (serial + 1 / n) * F.sqrt(n)
        worst = F.least(tail(z_chi), 2 * tail(F.abs(z_runs)), 2 * tail(F.abs(z_serial)))
        square, cube = by_kind(t, lambda x: F.lit(TEXT[x][0])), by_kind(t, lambda x: F.lit(TEXT[x][1]))
        text_mean = k * (1 - square) + n * (k * square - 1)
        text_var = 4 * n * k * k * F.greatest(cube - square * square, F.lit(0.0)) + 2 * (k - 1)
        z_text = (text_mean - chi) / F.sqrt(text_var)
        if switches:
            rate = by_kind(t, lambda x: F.lit(SWITCH[x]))
            often = t["c"]["pairs"]
            z_switch = F.when(often > 0, (t["c"]["switches"] - rate * often) / F.sqrt(F.greatest(often, F.lit(1.0)) * rate * (1 - rate) * SPREAD)).otherwise(0.0)
            z_text = (z_text + z_switch) / math.sqrt(2)
        text = tail(z_text)
        return F.struct(t["start"].alias("start"), t["stop"].alias("stop"), n.alias("n"), F.least(3 * worst, F.lit(1.0)).alias("random"), text.alias("text"))

    return F.transform(stats, one)


def discoveries(tests: Column, rate: float, level: float) -> Column:
    """Tokens that pass the battery at ``level`` and are discoveries at false-discovery ``rate``.

    A token's p-value is that of ordinary text, or 1 if the battery fails at ``level``.  Weights grow
    with length and have mean one; p-values are divided by them before the step-up.
    """

    def weighed(mean: Column) -> Column:
        p = lambda t: F.when(t["random"] >= level, t["text"]).otherwise(1.0)
        return F.transform(tests, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), (p(t) * mean / t["n"]).alias("q"), (t["random"] >= level).alias("passed")))

    def bound(w: Column) -> Column:
        m = F.size(w)
        ranked = F.sort_array(F.transform(w, lambda t: t["q"]))
        return F.coalesce(F.array_max(F.filter(ranked, lambda q, i: q <= rate * (i + 1) / m)), F.lit(-1.0))

    def under(w: Column, top: Column) -> Column:
        kept = F.filter(w, lambda t: t["passed"] & (t["q"] <= top))
        return F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")))

    mean = F.aggregate(tests, F.lit(0.0), lambda a, t: a + t["n"]) / F.size(tests)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    found = let(let(mean, weighed), lambda w: let(bound(w), lambda top: under(w, top)))
    return F.when(F.size(tests) > 0, found).otherwise(none)


def marked(rank: int, kind: str):
    return lambda t: F.struct(t["start"].alias("start"), F.lit(rank).alias("rank"), t["stop"].alias("stop"), F.lit(kind).alias("kind"))


def scanned(text: Column, *, rate: float = 0.01, level: float = 1e-3, switches: bool = False) -> list[Column]:
    """The findings of each kind in ``text``, in the order of ``KINDS``; each is an array of ``start, rank, stop, kind``.

    ``rate`` is the false-discovery rate, ``level`` that of the battery, ``switches`` whether class
    changes count as evidence too, and tokens are parted from directories before them.
    """
    x = F.coalesce(text, F.lit(""))
    tokens = located(x, PATHED, 1, LEAST) if switches else located(x, TOKEN)
    for step in (symbols, statistics, lambda c: p_values(c, switches), lambda c: discoveries(c, rate, level)):
        tokens = let(tokens, step)
    found = [located(x, ASSIGN, 2, 12), located(x, ACCESS), located(x, HEX), tokens]
    return [F.transform(c, marked(rank, kind)) for rank, (kind, c) in enumerate(zip(KINDS, found, strict=True))]


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda t: F.concat_ws(":", t["kind"], t["start"].cast("string"), t["stop"].cast("string"))), ",")


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row: key, counts of the base kinds and of random tokens, base digest and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by kind in the
    order assign, access, hex, random; ``how`` goes to ``scanned``.  A null text is an empty one and has no findings.  Repeated rows
    stay; no other column is read.  Row by row, without a shuffle.
    """
    d = docs.select(F.col(key).alias("key"), F.struct(*[c.alias(k) for k, c in zip(KINDS, scanned(F.col(text), **how), strict=True)]).alias("f"))
    every = lambda *kinds: listed(F.array_sort(F.concat(*[F.col("f")[k] for k in kinds])))
    counts = [F.size(F.col("f")[k]).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return d.select(F.col("key").alias(key), *counts, F.sha2(every(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"), every(*KINDS).alias("spans"))


def redacted(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", **how) -> DataFrame:
    """``docs`` with every finding of ``text`` replaced by ``mark``; overlapping ones by one mark.

    All rows and columns stay, whatever their names; texts without findings, and null ones, are as they were.
    """
    d = docs.select(F.struct(*docs.columns).alias("row"), F.array_sort(F.concat(*scanned(F.col(text), **how))).alias("found"))
    x = F.col("row")[text]
    pieces = F.regexp_extract_all(x, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(reach: Column) -> Column:
        """Bounds of the text before, between and after the marks; ``reach`` is the furthest end so far."""
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
        gaps = F.transform(F.col("found"), lambda t, i: F.when(t["start"] >= before(i), F.struct(before(i).alias("a"), t["start"].alias("b"))))
        last = F.struct(F.element_at(reach, -1).alias("a"), F.length(x).alias("b"))
        return F.concat(F.filter(gaps, lambda g: g.isNotNull()), F.array(last))

    def part(p: Column, g: Column) -> Column:
        def inside(k: Column) -> Column:
            low = F.greatest(g["a"] - k * PIECE, F.lit(0))
            return F.substring(F.get(p, k), low + 1, F.least(g["b"] - k * PIECE, F.lit(PIECE)) - low)

        spots = F.sequence(F.floor(g["a"] / PIECE).cast("int"), F.floor((g["b"] - 1) / PIECE).cast("int"))
        return F.when(g["b"] > g["a"], F.array_join(F.transform(spots, inside), "")).otherwise("")

    gaps = lambda: let(scan(F.transform(F.col("found"), lambda t: t["stop"]), F.greatest), between)
    whole = let(pieces, lambda p: F.array_join(F.transform(gaps(), lambda g: part(p, g)), mark))
    fresh = F.when(F.size("found") > 0, whole).otherwise(x)
    return d.select(*[(fresh if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
