"""Personal data: fixed formats, and bootstrapped contextual extraction of further identifiers.

Base spans are emails, IPv4 addresses, card numbers (Luhn) and international phone numbers. They are the seeds. Every
identifier-like token (four digits or more, or an at sign) and every seed is an instance; the words around it make its lexical
patterns: the two words before it, and the word before with the word after it. Patterns are known by 128 bits of hashes.

1. A pass over all texts counts how often the context of each pattern with ``SUPPORT`` different instances occurs at all; its
   precision is the share of these places that hold an instance. Words that precede everything have a low one.
2. Pattern and instance scores pass over the graph. A seed scores one; a pattern with ``SUPPORT`` confident instances scores
   its precision times the mean score of its instances (with one doubtful instance added); another instance scores one
   minus the product of its patterns' doubts. So what a pattern finds supports further patterns, and itself: in each round
   a pattern gets the score at which it stands still. Instances that are alike are one with a weight. Rounds end when no
   pattern comes in and no score changes by more than ``STILL``.
3. Tokens in a pattern with a final score of ``CONFIDENT`` are spans of kind ``found``.

The graph holds a pattern and instance pair once, so frequent pairs are summed before they are joined. Null text counts
as empty; null ids stay; rows repeated with id and text have the same spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.rows import KEY_TYPE, pieces, row_key
from rasterloom.runtime import checkpoint

KINDS = ("email", "ip", "card", "phone", "found")
FOUND = 4
SUPPORT, STILL, CONFIDENT = 3, 1e-4, 0.6
#: The most that one pattern counts for an instance.
MOST = 0.999
#: Forms of patterns: the two words before, and the words on both sides.
LEFT, BOTH = 0, 1
#: Bits of the filter over patterns at most (32 MB), and bytes of texts whose words are hashed at once.
MAX_BITS, CHUNK = 1 << 28, 1 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# runs are taken whole: giving characters back, or starting inside a run of digits, never helps these expressions
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ZEROED = bytes(48 if 48 <= c <= 57 else c for c in range(256))
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at sign outwards: a match has one at sign, and takes all local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)  # nothing before the sign can belong to a later match
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, by kind and then by start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _plain(word: str) -> bytes:
    return word.lower().encode("utf-8", "surrogatepass").translate(_ZEROED)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and two 64-bit hashes of each (two columns): a polynomial over its bytes, then mixed."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.flatnonzero(~_BLANK[b])
    if not len(inside):
        return np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(inside) > 1)))
    sizes = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    value = b[inside].astype(np.uint64) + np.uint64(1)
    out = np.empty((len(first), 2), np.uint64)
    for k, factor in enumerate(_FACTORS):
        powers = np.multiply.accumulate(np.full(int(sizes.max()), factor, np.uint64))
        out[:, k] = _mixed(np.add.reduceat(value * powers[place], first))
    return inside[first], out


def _pattern(form: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128 bits (two columns) of each pattern: its form and the hashes of its two words."""
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(form + 1)) * np.uint64(0xD6E8FEB86659FD93))


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[tuple[int, str, str]]]]:
    """(kind, start, end, normal form, patterns) of each seed and each other identifier-like token; patterns: (form, word, word)."""
    if not re.search("[0-9@]", text):
        return []
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, spans, k = [], sorted((a, b, kind) for kind, a, b in base), 0
    taken: list[tuple[int, int, int, int, int]] = []
    for a, b, kind in spans:
        while k < len(words) and words[k][1] <= a:
            k += 1
        last = k
        while last + 1 < len(words) and words[last + 1][0] < b:
            last += 1
        taken.append((k, last, kind, a, b))
    inside = {i for first, last, *_ in taken for i in range(first, last + 1)}
    for i, (a, b) in enumerate(words):
        if i in inside:
            continue
        token = text[a:b]
        if sum(map(token.count, "0123456789")) >= 4 or "@" in token:
            lead = len(token) - len(token.lstrip("\"'([{<,;:."))
            body = token[lead:].rstrip("\"')]}>,;:.!?")
            if body:
                taken.append((i, i, FOUND, a + lead, a + lead + len(body)))
    for first, last, kind, a, b in sorted(taken):
        before, after = [text[x:y] for x, y in words[max(0, first - 2) : first]], [text[x:y] for x, y in words[last + 1 : last + 2]]
        patterns = [(LEFT, *before)] if len(before) == 2 else []
        if before and after:
            patterns.append((BOTH, before[-1], after[0]))
        out.append((kind, a, b, text[a:b].lower(), patterns))
    return out


def extract(docs: DataFrame, text: str, id: str) -> DataFrame:
    """``id, key, base, found`` of each row: a key of id and text, base spans, and all instances with their patterns."""
    kind = docs.schema[id].dataType.simpleString()
    pair = pa.struct([("p", pa.int64()), ("q", pa.int64())])
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    inst = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.binary()), ("patterns", pa.list_(pair))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            base, found, words = [], [], []
            for t in b.column(2).to_pylist():
                spans = base_spans(t or "")
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                found.append(instances(t or "", spans))
                words += [_plain(w) for *_, ps in found[-1] for _, *pair in ps for w in pair]
            hashed = word_hashes(b" ".join(words))[1].reshape(-1, 2, 2)
            forms = np.array([f for row in found for *_, ps in row for f, *_ in ps], np.uint64).reshape(-1, 1)
            ids = np.where(forms == LEFT, _pattern(LEFT, hashed[:, 0], hashed[:, 1]), _pattern(BOTH, hashed[:, 0], hashed[:, 1])).view(np.int64).tolist()
            at, out = iter(ids), []
            for row in found:
                out.append([{"kind": k, "start": s, "end": e, "instance": xxhash.xxh3_128_digest(n.encode("utf-8", "surrogatepass")), "patterns": [dict(zip("pq", next(at))) for _ in ps]} for k, s, e, n, ps in row])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, span), pa.array(out, inst)], ["id", "key", "base", "found"])

    schema = f"id {kind}, key {KEY_TYPE}, base array<struct<kind:int,start:int,end:int>>, found array<struct<kind:int,start:int,end:int,instance:binary,patterns:array<struct<p:bigint,q:bigint>>>>"
    return docs.select(docs[id], row_key(docs, id, text), docs[text]).mapInArrow(run, schema)


class Sieve:
    """A Bloom filter over patterns, of at most ``MAX_BITS`` bits: with more patterns it only lets more others through."""

    def __init__(self, patterns: DataFrame) -> None:
        self.bits = min(MAX_BITS, max(1 << 10, 1 << (16 * patterns.count()).bit_length()))
        place = F.explode(F.array(*[F.col(c).bitwiseAND(F.lit(self.bits - 1).cast("long")) for c in "pq"])).alias("at")
        words = patterns.select(place).groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def passes(self, p: np.ndarray) -> np.ndarray:
        out = np.ones(len(p), bool)
        for c in range(2):
            at = p[:, c] & np.uint64(self.bits - 1)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def count_contexts(docs: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    """``p, q, places``: how often the context of each pattern ``p, q`` occurs in all texts.

    Workers hash the contexts of all places and hand on, summed up, those that pass a filter over the patterns; the join decides.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Sieve(patterns))

    def contexts(texts: list[bytes]) -> np.ndarray:
        begin, h = word_hashes(b"\n".join(texts))
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")
        # an identifier stands after two words (and is one itself), or between two words
        inside = owner[:-2] == owner[2:]
        return np.concatenate((_pattern(LEFT, h[:-2][inside], h[1:-1][inside]), _pattern(BOTH, h[:-2][inside], h[2:][inside])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sent.value
        for b in batches:
            held, size, some = [], 0, []
            for i, t in enumerate(b.column(0).to_pylist()):
                held.append(_plain(t or ""))
                size += len(held[-1])
                if size >= CHUNK or i == b.num_rows - 1:
                    found = contexts(held)
                    some.append(found[sieve.passes(found)])
                    held, size = [], 0
            found = np.concatenate(some) if some else np.empty((0, 2), np.uint64)
            found = found[np.lexsort(found.T)]
            first = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]).any(axis=1)))) if len(found) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[first, 0].view(np.int64)), pa.array(found[first, 1].view(np.int64)), pa.array(np.diff(np.append(first, len(found))))], ["p", "q", "n"])

    seen = docs.select(docs[text]).mapInArrow(run, "p long, q long, n long").groupBy("p", "q").agg(F.sum("n").alias("places"))
    return seen.join(patterns.select("p", "q"), ["p", "q"])


def confident_patterns(edges: DataFrame, docs: DataFrame, text: str, support: int = SUPPORT, still: float = STILL, confident: float = CONFIDENT) -> DataFrame:
    """``p, q, score`` of the patterns that are confident in the end. ``edges``: p, q, instance, seed (0 or 1), n (times seen).

    A pattern counts as soon as ``support`` different instances with a confident score stand in it: seeds at first, found
    ones later. Neither scores nor patterns are ever taken back, so the rounds end.
    """
    wide = checkpoint(edges.groupBy("p", "q").agg(F.count("*").alias("kinds"), F.sum("n").alias("held")).where(F.col("kinds") >= support))
    precision = wide.join(count_contexts(docs, wide, text), ["p", "q"], "left").select("p", "q", (F.col("held") / F.greatest(F.coalesce("places", F.lit(0)), "held")).alias("precision"))
    graph = checkpoint(edges.join(precision.where(F.col("precision") >= confident), ["p", "q"]).select("p", "q", "instance", "seed", "precision"))
    graph = checkpoint(_condensed(graph))
    state = graph.groupBy("instance").agg(F.max("seed").cast("double").alias("score"), F.lit(0.0).alias("doubt"))
    before = graph.select("p", "q", F.lit(None).cast("double").alias("before")).limit(0)
    while True:
        scored = checkpoint(_scored(graph, state, before, confident).where(F.col("sure") >= support).select("p", "q", "score"))
        moved = scored.join(before, ["p", "q"], "left").where(F.col("before").isNull() | (F.col("score") - F.col("before") > still))
        if moved.isEmpty():
            return scored.where(F.col("score") >= confident)
        before = scored.withColumnRenamed("score", "before")
        doubt = F.sum(F.log(1 - F.least(F.coalesce("before", F.lit(0.0)), F.lit(MOST))))
        state = graph.join(before, ["p", "q"], "left").groupBy("instance").agg(F.max("seed").alias("seed"), doubt.alias("doubt"))
        state = checkpoint(state.select("instance", F.greatest(F.col("seed").cast("double"), 1 - F.exp("doubt")).alias("score"), "doubt"))


def _condensed(graph: DataFrame) -> DataFrame:
    """The graph with one instance for all that are alike, ``weight`` in number: seeds or not, in the same patterns (128 bits)."""
    alike = graph.groupBy("instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("p", "q")).alias("a"), F.bit_xor(F.xxhash64("q", "p", F.lit(1))).alias("b"))
    one = alike.groupBy("seed", "n", "a", "b").agg(F.min("instance").alias("instance"), F.count("*").alias("weight"))
    return graph.join(one.select("instance", "weight"), "instance")


def _scored(graph: DataFrame, state: DataFrame, before: DataFrame, confident: float) -> DataFrame:
    """``p, q, score, sure``: the score at which a pattern stands still while the others keep theirs, and its confident instances.

    With d for the doubt of an instance's other patterns its score is 1 - d + d * score, so the mean is linear in the
    pattern's own score, and what would take rounds without end where few of many instances are seeds is one division.
    """
    own = F.least(F.coalesce("before", F.lit(0.0)), F.lit(MOST))
    rest = F.when(F.col("seed") == 1, 0.0).otherwise(F.exp(F.col("doubt") - F.log(1 - own)))
    edges = graph.join(state, "instance").join(before, ["p", "q"], "left").withColumn("rest", rest)
    sums = edges.groupBy("p", "q").agg(F.max("precision").alias("precision"), F.sum("weight").alias("n"), F.sum(F.col("weight") * (1 - F.col("rest"))).alias("fixed"), F.sum(F.col("weight") * F.col("rest")).alias("free"), F.coalesce(F.sum(F.when(F.col("score") >= confident, F.col("weight"))), F.lit(0)).alias("sure"))
    still = F.expr("precision * fixed / (n + 1 - precision * free)")
    return sums.select("p", "q", F.when(still <= MOST, still).otherwise(F.col("precision") * (F.col("fixed") + MOST * F.col("free")) / (F.col("n") + 1)).alias("score"), "sure")


def find(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, base, spans`` of each row: arrays of (kind, start, end), by kind and then by start."""
    rows = checkpoint(extract(docs, text, id))
    seen = rows.select("key", F.explode("found").alias("f")).select("key", "f.*", F.explode("f.patterns").alias("pattern")).withColumns({"p": F.col("pattern.p"), "q": F.col("pattern.q")})
    edges = seen.groupBy("p", "q", "instance").agg(F.max((F.col("kind") < FOUND).cast("int")).alias("seed"), F.count("*").alias("n"))
    good = confident_patterns(checkpoint(edges), docs, text)
    new = seen.where(F.col("kind") == FOUND).join(good, ["p", "q"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    joined = rows.join(new, "key", "left")
    return joined.select(F.col("id").alias(id), "base", F.array_sort(F.concat("base", F.coalesce("new", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))).alias("spans"))


def digest(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, counts of each base kind, base_sha256 and all spans of each row."""
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find(docs, text, id).select(id, *[count(k) for k in range(4)], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
