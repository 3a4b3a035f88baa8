"""Secret scan with DataFrame functions only: fixed formats, and a battery of randomness tests for other tokens.

Fixed formats are assignments (``password=...``), access keys and long hexadecimal runs. Besides, every run of 20 or more
characters of ``A-Za-z0-9+/_-`` (with padding) is a candidate if its characters say in which encoding it may be: hexadecimal,
base 32, or digits with letters of one case, all with or without separators; letters of both cases, base 62, 64 or its variant for
URLs, or all of these characters. Letters of one case alone are words, and digits alone numbers. Three tests hold the
candidate against random characters of its alphabet: chi-squared uniformity (by its exact mean and variance, as tokens are
short), the runs test about the middle of the alphabet and the circular serial correlation at lag one. The least of the three
p-values, corrected for being the least of three, is the token's; it is uniform for random tokens.

What is reported is under control of the false discovery rate, in each class of lengths (powers of two), as longer tokens show
their structure better. Tokens with a p-value above ``PLAIN`` are taken to be random. As random tokens have uniform p-values,
these say how many random ones there are above any smaller p-value; what is there beyond that and beyond two standard errors of
the estimate is structured. The least p-value is sought above which at most ``Q`` of all tokens are structured by this
estimate, and the tokens above it are spans of kind ``random``. It is never below ``Q`` over the number of tokens, where
a token is structured whatever the others are. p-values are counted in bins of a twentieth of a power of ten, so that this needs a few hundred counts and no sort.

Null text counts as empty; each row is judged on its own, repeated rows repeat the result; null ids stay. All offsets
are code points, ends exclusive. All steps are linear in the length of a token, and nearly so in the number of matches of a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.rows import unused

#: Base formats: kind, expression, a cheaper test that every match passes, and the group whose length counts with its least length.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Characters that a token without its separators has at least.
LEAST_BODY = 16
Q, PLAIN = 0.05, 0.1
#: Bins of the p-value: a twentieth of a power of ten, down to 1e-20.
BINS_PER_DECADE, LAST_BIN = 20, 400
CLASSES = 20
#: Matches of a row whose offsets are summed up in one go.
BLOCK = 64

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches, with their texts: lengths of the parts between them and of themselves, summed up.

    Offsets are summed up for blocks of matches first, since an array that grows by one element at a time is copied each time.
    """
    pat = F.lit(pattern)
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, pat, F.lit(0))
    judged = F.regexp_extract_all(text, pat, F.lit(group))
    zipped = F.arrays_zip(between.alias("gap"), found.alias("hit"), judged.alias("part"))
    parts = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.char_length(x["hit"]).alias("size"), F.char_length(x["part"]).alias("judged")))
    blocks = lambda parts: F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, F.lit(BLOCK)))

    def starts(blocks: Column) -> Column:
        step = lambda a, block: F.struct((a["at"] + F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["size"], F.lit(0)))).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    def spans(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["size"]
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("token"))
            return F.struct(F.coalesce(end, start).alias("at"), F.when(x["judged"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        empty = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    return _bound(parts, lambda p: _bound(blocks(p), lambda b: F.flatten(F.zip_with(b, starts(b), spans))))


def _only(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the fixed formats, by start and then by kind."""
    none = F.array().cast(SPAN)
    assign = F.when(text.rlike("(?i)password|passwd|secret|token|api_?key"), _only(_matches(text, ASSIGN, 0, 2, 6))).otherwise(none)
    access = F.when(text.contains("AKIA"), _only(_matches(text, ACCESS, 1))).otherwise(none)
    hexes = F.when(text.rlike("[0-9a-f]{24}"), _only(_matches(text, HEX, 2))).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def encoded(token: Column) -> Column:
    """``body, alphabet`` of the narrowest encoding that explains a token's characters; null: it is made of words or numbers.

    Separators are part of the body only where the encoding has them as characters.
    """

    def inferred(t: Column) -> Column:
        whole, bare = t["whole"], t["bare"]
        digit, lower, upper = bare.rlike("[0-9]"), bare.rlike("[a-z]"), bare.rlike("[A-Z]")
        of = lambda body, alphabet: F.struct(body.alias("body"), F.lit(alphabet).alias("alphabet"))
        both = _UP + _LOW + _DIGITS
        return (
            F.when(~lower & ~upper | ~digit & ~(lower & upper), F.lit(None))
            .when(bare.rlike("^[0-9a-f]+$"), of(bare, _DIGITS + "abcdef"))
            .when(bare.rlike("^[0-9A-F]+$"), of(bare, _DIGITS + "ABCDEF"))
            .when(bare.rlike("^[A-Z2-7]+$"), of(bare, _UP + "234567"))
            .when(~lower, of(bare, _DIGITS + _UP))
            .when(~upper, of(bare, _DIGITS + _LOW))
            .when(whole.rlike("^[A-Za-z]+$"), of(whole, _UP + _LOW))
            .when(whole.rlike("^[A-Za-z0-9]+$"), of(whole, both))
            .when(whole.rlike("^[A-Za-z0-9+/]+$"), of(whole, both + "+/"))
            .when(whole.rlike("^[A-Za-z0-9_-]+$"), of(whole, both + "-_"))
            .otherwise(of(whole, both + "+/-_"))
        )

    whole = F.rtrim(token, F.lit("="))
    found = _bound(F.struct(whole.alias("whole"), F.translate(whole, "+/_-", "").alias("bare")), inferred)
    return _bound(found, lambda e: F.when(F.char_length(e["body"]) >= LEAST_BODY, e))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a rational approximation of erfc whose error is under 2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def randomness(body: Column, alphabet: Column) -> Column:
    """p-value of the body as random characters of the alphabet (both not null)."""
    measured = F.struct(body.alias("body"), alphabet.alias("alphabet"), F.split(body, "").alias("chars"), F.char_length(body).cast("double").alias("n"), F.char_length(alphabet).cast("double").alias("k"))
    return _bound(measured, _p_value)


def _p_value(t: Column) -> Column:
    n, k = t["n"], t["k"]
    # at most as many different characters as the alphabet has, each counted in one pass
    times = lambda c: n - F.char_length(F.replace(t["body"], c, F.lit("")))
    same = F.aggregate(F.array_distinct(t["chars"]), F.lit(0.0), lambda a, c: a + times(c) * times(c))
    values = F.transform(t["chars"], lambda c: (F.position(c, t["alphabet"]) - 1).cast("double"))
    # runs and sums in one fold over the values; "last" starts with the final value, so that the products are circular
    zero = F.lit(0.0)
    first = lambda v: F.struct(F.element_at(v, -1).alias("last"), zero.alias("runs"), zero.alias("high"), zero.alias("s"), zero.alias("ss"), zero.alias("lag"))

    def step(a: Column, v: Column) -> Column:
        crossed = F.when((a["last"] * 2 >= k) != (v * 2 >= k), 1.0).otherwise(0.0)
        return F.struct(v.alias("last"), (a["runs"] + crossed).alias("runs"), (a["high"] + F.when(v * 2 >= k, 1.0).otherwise(0.0)).alias("high"), (a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"), (a["lag"] + a["last"] * v).alias("lag"))

    def least(a: Column, same: Column) -> Column:
        chi = k / n * same - n
        p_chi = _upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        # circular runs: crossings around the circle have mean 2 * n1 * n2 / (n - 1)
        n1, n2 = a["high"], n - a["high"]
        mean = 2 * n1 * n2 / (n - 1)
        var = F.greatest(4 * n1 * n2 * (n1 - 1) * (n2 - 1) / ((n - 1) * (n - 1) * (n - 2)), F.lit(0.25))
        p_runs = F.when((n1 < 2) | (n2 < 2), 2 * _upper_tail(F.sqrt(n))).otherwise(2 * _upper_tail(F.abs(a["runs"] - mean) / F.sqrt(var)))
        spread = n * a["ss"] - a["s"] * a["s"]
        r = (n * a["lag"] - a["s"] * a["s"]) / F.when(spread > 0, spread)
        sd = F.sqrt(n * n / ((n - 1) * (n - 1) * (n - 2)))
        p_serial = F.coalesce(2 * _upper_tail(F.abs(r + 1 / (n - 1)) / sd), F.lit(0.0))
        # the least of three uniform values is below x with a probability of 1 - (1 - x) ** 3
        return _bound(F.least(p_chi, p_runs, p_serial, F.lit(1.0)), lambda x: F.when(x >= 1, 1.0).otherwise(-F.expm1(3 * F.log1p(-x))))

    folded = _bound(values, lambda v: F.aggregate(v, first(v), step))
    return _bound(F.struct(folded.alias("sums"), same.alias("same")), lambda a: least(a["sums"], a["same"]))


def candidates(text: Column) -> Column:
    """Array of (start, kind, end, class, bin) of all tokens with an inferred encoding, base formats included."""
    out = "array<struct<start:int,kind:int,end:int,class:int,bin:int>>"
    tokens = F.transform(_matches(text, CANDIDATE, 3), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), encoded(s["token"]).alias("e")))

    def judged(s: Column) -> Column:
        size = F.least(F.floor(F.log2((s["end"] - s["start"]).cast("double"))), F.lit(CLASSES)).cast("int")
        bin = F.least(F.floor(-F.log10(F.greatest(randomness(s["e"]["body"], s["e"]["alphabet"]), F.lit(1e-30))) * BINS_PER_DECADE), F.lit(LAST_BIN)).cast("int")
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), size.alias("class"), bin.alias("bin"))

    found = F.transform(F.filter(tokens, lambda s: s["e"].isNotNull()), judged)
    return F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), found.cast(out)).otherwise(F.array().cast(out))


def cutoffs(scanned: DataFrame, column: str, q: float = Q) -> dict[int, int]:
    """For each class of lengths the bin up to which (exclusive) tokens are reported; classes without tokens are absent.

    ``CLASSES * (LAST_BIN + 1)`` counts at most reach the driver.
    """
    counts = scanned.select(F.explode(column).alias("c")).groupBy("c.class", "c.bin").agg(F.count("*").alias("n")).collect()
    out: dict[int, int] = {}
    plain = round(-BINS_PER_DECADE * math.log10(PLAIN))
    for size in sorted({r["class"] for r in counts}):
        of = {r["bin"]: r["n"] for r in counts if r["class"] == size}
        sure = reported = sum(n for b, n in of.items() if b < plain)
        out[size] = plain
        for b in range(plain, min(LAST_BIN, math.floor(BINS_PER_DECADE * math.log10(sum(of.values()) / q)))):
            reported += of.get(b, 0)
            # random ones below PLAIN and above the lower edge of the bin, by those above PLAIN
            random = sure * (PLAIN - 10 ** (-(b + 1) / BINS_PER_DECADE)) / (1 - PLAIN)
            if reported and 1 - (sure + random + 2 * math.sqrt(random)) / reported <= q:
                out[size] = b + 1
    return out


def _random(spans: Column, base: Column, cut: dict[int, int]) -> Column:
    """The candidates that are reported and overlap no base span."""

    def stays(s: Column) -> Column:
        below = F.lit(0)
        for size, b in sorted(cut.items()):
            below = F.when(s["class"] == size, F.lit(b)).otherwise(below)
        return (s["bin"] < below) & ~F.exists(base, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))

    return _only(F.filter(spans, stays))


def found_cutoffs(docs: DataFrame, text: str) -> dict[int, int]:
    """Cutoffs over all rows: a pass that counts the p-values of all candidates."""
    return cutoffs(docs.select(candidates(F.coalesce(docs[text], F.lit(""))).alias("_candidates")), "_candidates")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, counts of each base kind, base_sha256 and all spans of each row.

    Two passes over the texts: one counts the candidates' p-values over all rows, one builds the spans.
    """
    cut = found_cutoffs(docs, text)
    whole = F.coalesce(docs[text], F.lit(""))
    marked = docs.select(docs[id].alias("_id"), whole.alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    marked = marked.withColumn("_all", F.array_sort(F.concat(F.col("_base"), _random(candidates(F.col("_text")), F.col("_base"), cut))))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return marked.select(
        F.col("_id").alias(id), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_all")).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans by one. Null texts stay null; ``n_chars`` follows where there is one."""
    cut = found_cutoffs(docs, text)
    base, every = unused(docs, "_base"), unused(docs, "_all")
    whole = docs[text]
    marked = docs.withColumn(base, base_spans(F.coalesce(whole, F.lit(""))))
    marked = marked.withColumn(every, F.array_sort(F.concat(F.col(base), _random(candidates(F.coalesce(whole, F.lit(""))), F.col(base), cut))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        apart = F.concat(a["out"], F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], apart).otherwise(a["out"]).alias("out"))

    cleaned = F.aggregate(F.col(every), first, step, lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.char_length(whole))))
    any_found = F.size(every) > 0
    new = {text: F.when(any_found, cleaned).otherwise(whole)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(any_found, F.char_length(cleaned).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return marked.withColumns(new).select(*docs.columns)
