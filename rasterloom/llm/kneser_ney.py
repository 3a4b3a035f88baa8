"""Quality rules with a character 4-gram perplexity band for each language.

The language model is an interpolated modified Kneser-Ney model over UTF-16 code units, one for each value of ``lang``.
It learns
from all rows with at most a tenth as many of ``SYMBOLS`` as words: a row with more is judged like any other, but does not
teach the model that such text is usual. Workers add up packed 4-grams of their rows, Spark sums them up, and continuation counts, the
counts of counts and the three discounts of each order follow by grouping. Probabilities and back-off weights are
stored in sorted hash arrays, found through a directory over the leading bits of the hash. A row's own counts are held out
when it is judged: an n-gram or context that no other place than this row has counts as unseen, so that a row
of random characters cannot explain itself. For this the arrays hold how often each n-gram and context occurs.

The arrays are broadcast in shards of about ``SLOTS`` entries (50 MB each); every n-gram that was counted is stored. What is asked to score a
4-gram hangs on its third unit: a probability has it last but one, a back-off weight has it last. The shard of that unit
therefore scores the 4-gram alone, and a row's surprise is the sum over the shards, which a worker reads one after the
other. Probabilities of single units are in every shard.

A row is rejected where its mean surprise (natural log of the perplexity) leaves its language's band. The band is taken from
the rows of the language that the model learns from and that pass the base rules: quartiles, and a multiple of their distance on either side, widened
for short texts by the spread that so few characters have. The upper reach is the longer one, as a text with a passage
in another language is surprising but clean, while strings that no language makes lie far above it.

Null text counts as empty. Null languages are a language of their own. Rows with fewer than four units and rows of a language
without a band are judged by the base rules alone. Repeated rows are counted and judged each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.rows import pieces, row_key, without
from rasterloom.runtime import checkpoint

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
ORDER = 4
#: Entries of a shard of the model, about: a shard has all entries of its units.
SLOTS = 1 << 21
#: Units that are handled at once by a worker.
CHUNK = 1 << 17
#: Distinct 4-grams of a language that a worker adds up before it hands them on.
HELD = 1 << 19
#: Reach of the band below and above the quartiles, in distances between them, and the least distance.
REACH_LOW, REACH_HIGH, LEAST_SPREAD = 4.0, 14.0, 0.05
#: What the band is wider for n units, times the square root of n.
SHORT = 2.0
#: Surprise is counted in bins of this width.
BIN = 0.005


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of all texts as 64-bit numbers, and for each the index of its text."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    u = np.frombuffer(b"".join(raw), "<u2").astype(np.uint64)
    if len(u) < ORDER:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = u[:-3] << np.uint64(48) | u[1:-2] << np.uint64(32) | u[2:-1] << np.uint64(16) | u[3:]
    owner = np.repeat(np.arange(len(raw)), sizes)
    inside = owner[:-3] == owner[3:]
    return grams[inside], owner[:-3][inside]


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    """Indexes of texts, about ``CHUNK`` units at a time."""
    at, size = [], 0
    for i, t in enumerate(texts):
        at.append(i)
        size += len(t)
        if size >= CHUNK:
            yield at
            at, size = [], 0
    if at:
        yield at


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first)


def teaches(text: str) -> bool:
    """Whether the model learns from a row: it has at most a tenth as many symbols as words."""
    symbols = sum(map(text.count, SYMBOLS))
    return not symbols or 10 * symbols <= len(text.encode("utf-8", "surrogatepass").split())


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang", chosen: Callable[[str], bool] | None = None) -> DataFrame:
    """``lang, g, n``: packed 4-grams of all rows (or of those whose text is chosen), with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = Counter()

        def out(name: str | None, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()).take(pa.array(np.zeros(len(k), np.int32))), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "g", "n"])

        for b in pieces(batches):
            by: dict[str | None, list[str]] = {}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if chosen is None or chosen(t or ""):
                    by.setdefault(name, []).append(t or "")
            for name, texts in by.items():
                for at in _chunks(texts):
                    k, c = np.unique(_packed([texts[i] for i in at])[0], return_counts=True)
                    if len(k):
                        held.setdefault(name, []).append((k, c.astype(np.int64)))
                        size[name] += len(k)
                    if size[name] > HELD:
                        k, c = _added(*zip(*held[name]))
                        if len(k) > HELD // 2:
                            yield out(name, k, c)
                            held[name], size[name] = [], 0
                        else:
                            held[name], size[name] = [(k, c)], len(k)
        for name, parts in held.items():
            if parts:
                yield out(name, *_added(*zip(*parts)))

    counted = docs.select(docs[text], docs[lang].cast("string")).mapInArrow(run, "lang string, g long, n long")
    return counted.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _units(g: Column, k: int) -> Column:
    """The last k units of a packed gram."""
    return g if k == ORDER else g.bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long"))


def model_table(counts: DataFrame) -> DataFrame:
    """``lang, k, g, logp, back, times, before``: interpolated log-probabilities and back-off weights of all n-grams, and how often they occur at all and before another unit.

    The highest order has the counts themselves, the lower ones the numbers of different units before the gram.
    """
    tables = {ORDER: checkpoint(counts.select("lang", "g", "n", F.col("n").alias("times")))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = checkpoint(tables[k + 1].groupBy("lang", _units(F.col("g"), k).alias("g")).agg(F.count("*").alias("n"), F.sum("times").alias("times")))
    lower, out = None, []
    for k in range(1, ORDER + 1):
        t = tables[k]
        nth = [F.count(F.when(F.col("n") == i, 1)).cast("double") for i in range(1, 5)]
        of = t.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(nth, 1)], F.count("*").alias("types"))
        y = F.expr("n1 / greatest(n1 + 2 * n2, 1.0)")
        # counts of counts that vanish (tiny corpora) leave the usual ranges; the discounts are kept inside them
        cut = lambda i, a, b: F.greatest(F.lit(0.1), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(b) / F.greatest(F.col(a), F.lit(1.0))))
        of = of.select("lang", "types", cut(1, "n1", "n2").alias("d1"), cut(2, "n2", "n3").alias("d2"), cut(3, "n3", "n4").alias("d3"))
        t = t.join(of, t.lang.eqNullSafe(of.lang)).drop(of.lang)
        d = F.expr("case when n = 1 then d1 when n = 2 then d2 else d3 end")
        t = t.withColumn("d", d)
        if k == 1:
            total = t.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
            t = t.join(total, t.lang.eqNullSafe(total.lang)).drop(total.lang)
            t = t.withColumn("p", F.expr("(n - d) / total + mass / total / types")).withColumn("suffix", F.lit(0))
        else:
            context = F.shiftrightunsigned("g", 16).alias("h")
            sums = t.groupBy("lang", context).agg(F.sum("n").alias("total"), F.sum("d").alias("mass"), F.sum("times").alias("before"))
            own = sums.select(F.col("lang").alias("sl"), F.col("h").alias("sh"), "total", "mass")
            t = t.withColumn("h", context).join(own, F.col("lang").eqNullSafe(F.col("sl")) & (F.col("h") == F.col("sh")))
            low = lower.select(F.col("lang").alias("ll"), F.col("g").alias("lg"), F.col("p").alias("lp"))
            t = t.join(low, F.col("lang").eqNullSafe(F.col("ll")) & (_units(F.col("g"), k - 1) == F.col("lg")))
            t = t.withColumn("p", F.expr("(n - d) / total + mass / total * lp"))
            # the weight of a context belongs to the gram of the order below
            back = sums.select(F.col("lang").alias("bl"), F.col("h").alias("bh"), F.expr("cast(ln(mass / total) as float)").alias("weight"), F.col("before").alias("seen"))
            out[-1] = out[-1].join(back, F.col("lang").eqNullSafe(F.col("bl")) & (F.col("g") == F.col("bh")), "left").select("lang", "k", "g", "logp", F.coalesce("weight", "back").alias("back"), "times", F.coalesce("seen", "before").alias("before"))
        lower = checkpoint(t.select("lang", "g", "times", "p"))
        out.append(lower.select("lang", F.lit(k).alias("k"), "g", F.expr("cast(ln(p) as float)").alias("logp"), F.lit(0.0).cast("float").alias("back"), "times", F.lit(0).cast("long").alias("before")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole


class Scorer:
    """Looks up log-probabilities in sorted hash arrays; units that are in none have the log-probability ``worst``."""

    def __init__(self, names: list[str | None], lang: np.ndarray, k: np.ndarray, g: np.ndarray, logp: np.ndarray, back: np.ndarray, times: np.ndarray, before: np.ndarray, worst: float) -> None:
        """``lang`` holds indexes of ``names``; the other columns are those of :func:`model_table`."""
        h = np.empty(len(k), np.uint64)
        for i, x in enumerate(names):
            for order in range(1, ORDER + 1):
                at = (lang == i) & (k == order)
                h[at] = self.hashed(g[at].view(np.uint64), x, order)
        by = np.argsort(h)
        self.keys, self.logp, self.back = h[by], logp[by].astype(np.float32), back[by].astype(np.float32)
        self.times, self.before = (np.minimum(x[by], np.iinfo(np.uint32).max).astype(np.uint32) for x in (times, before))
        self.bits = max(1, int(len(h)).bit_length())
        self.start = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.worst = float(worst)

    @staticmethod
    def hashed(g: np.ndarray, lang: str | None, order: int) -> np.ndarray:
        """A one-to-one mixing of the grams of a language and order."""
        seed = xxhash.xxh64_intdigest(f"{order}:{'' if lang is None else '.' + lang}")
        x = g ^ np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the arrays, or -1."""
        at = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return at
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        i, end = self.start[bucket].astype(np.int64), self.start[bucket + 1]
        open_ = np.flatnonzero(i < end)
        while len(open_):
            hit = self.keys[i[open_]] == h[open_]
            at[open_[hit]] = i[open_[hit]]
            open_ = open_[~hit]
            i[open_] += 1
            open_ = open_[i[open_] < end[open_]]
        return at

    @staticmethod
    def _elsewhere(at: np.ndarray, times: np.ndarray, owner: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Which of the entries ``at`` occur in other places than the row ``owner`` that asks. units: how many each row has.

        It is enough to count among those that ask: where a row found a longer n-gram with this end elsewhere, so is the end.
        """
        out = at >= 0
        rare = np.flatnonzero(out)
        rare = rare[times[at[rare]] <= units[owner[rare]]]
        _, which, own = np.unique(owner[rare] * len(times) + at[rare], return_inverse=True, return_counts=True)
        out[rare] = times[at[rare]] > own[which]
        return out

    def surprise(self, grams: np.ndarray, lang: str | None, owner: np.ndarray) -> np.ndarray:
        """-log p of the last unit of each packed 4-gram, with the counts of its row ``owner`` held out."""
        out = np.zeros(len(grams))
        left, units = np.arange(len(grams)), np.bincount(owner)
        for order in range(ORDER, 0, -1):
            g = grams[left] if order == ORDER else grams[left] & np.uint64((1 << 16 * order) - 1)
            at = self.find(self.hashed(g, lang, order))
            seen = self._elsewhere(at, self.times, owner[left], units)
            out[left[seen]] -= self.logp[at[seen]]
            left, g = left[~seen], g[~seen]
            if order > 1 and len(left):
                back = self.find(self.hashed(g >> np.uint64(16), lang, order - 1))
                found = self._elsewhere(back, self.before, owner[left], units)
                out[left[found]] -= self.back[back[found]]
        out[left] -= self.worst
        return out


class Model:
    """Shards of a model, each a broadcast :class:`Scorer`."""

    def __init__(self, shards: list[Broadcast]) -> None:
        self.shards = shards

    def scorers(self) -> Iterator[tuple[int, Scorer]]:
        """One shard after the other; where there are several, a worker holds one at a time."""
        for i, x in enumerate(self.shards):
            yield i, x.value
            if len(self.shards) > 1 and getattr(x, "_path", None):
                x.__dict__.pop("_value", None)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", slots: int = SLOTS, chosen: Callable[[str], bool] | None = None) -> Model:
    """The model of all rows (or of those whose text is chosen), in shards of about ``slots`` entries."""
    table = checkpoint(model_table(count_grams(docs, text, lang, chosen)))
    size, worst = table.agg(F.count("*"), F.min("logp")).first()
    n = 1 if size <= slots else -(-2 * size // slots)
    last = F.col("g").bitwiseAND(F.lit((1 << 16) - 1).cast("long"))
    before = F.shiftrightunsigned("g", 16).bitwiseAND(F.lit((1 << 16) - 1).cast("long"))
    names = [r["lang"] for r in table.where("k = 1").select("lang").distinct().orderBy("lang").collect()]  # a few languages
    number = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names if x is not None]), F.col("lang")) - 1 + int(None in names), F.lit(0)).cast("int") if names else F.lit(0)
    shards = []
    for i in range(n):
        own = table if n == 1 else table.where((F.col("k") == 1) | (last % n == i) | (before % n == i))
        t = own.select(number.alias("lang"), "k", "g", "logp", "back", "times", "before").toArrow()
        shards.append(docs.sparkSession.sparkContext.broadcast(Scorer(names, *(t.column(c).to_numpy() for c in t.column_names), worst or 0.0)))
        shards[-1].__dict__.pop("_value", None)
    return Model(shards)


WINDOW = 5


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            duplicates += line in seen
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + WINDOW - max(upto, i)
                upto = i + WINDOW
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), duplicates, repeated


def measure(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", id: str = "doc_id") -> DataFrame:
    """``id``, the base counts, ``lang``, units scored and their mean surprise for each row (null where none is scored)."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.shards)
        for b in batches if n > 1 else pieces(batches):  # every batch reads all shards
            texts, langs = [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist()
            total, units = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            by: dict[str | None, list[int]] = {}
            for i, name in enumerate(langs):
                by.setdefault(name, []).append(i)
            for shard, scorer in model.scorers():
                for name, rows in by.items():
                    for at in _chunks([texts[i] for i in rows]):
                        own = np.array([rows[i] for i in at])
                        grams, owner = _packed([texts[i] for i in own])
                        if n > 1:
                            here = (grams >> np.uint64(16) & np.uint64(0xFFFF)) % np.uint64(n) == shard
                            grams, owner = grams[here], owner[here]
                        total[own] += np.bincount(owner, scorer.surprise(grams, name, owner), len(own))
                        units[own] += np.bincount(owner, minlength=len(own))
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            mean = pa.array(total / np.maximum(units, 1), pa.float64(), mask=units == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(langs, pa.string()), pa.array(units), mean], ["id", *COUNTS, "lang", "n_units", "surprise"])

    fields = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(docs[id], docs[text], docs[lang].cast("string")).mapInArrow(run, f"id {kind}, {fields}, lang string, n_units long, surprise double").withColumnRenamed("id", id)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bands(measured: DataFrame) -> DataFrame:
    """``lang, low, high``: quartiles of the surprise of rows that the model learns from and that pass the base rules, and ``REACH`` distances beyond."""
    bins = measured.where("not base_failed and surprise is not null and 10 * n_symbols <= n_words").groupBy("lang", F.floor(F.col("surprise") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    # every language has few bins, so that these sums are over few rows
    upto = F.expr("sum(n) over (partition by lang order by bin)")
    whole = F.expr("sum(n) over (partition by lang)")
    at = bins.withColumn("upto", upto).withColumn("whole", whole)
    q = at.groupBy("lang").agg(F.min(F.expr("case when 4 * upto >= whole then bin end")).alias("a"), F.min(F.expr("case when 4 * upto >= 3 * whole then bin end")).alias("b"))
    a, b = F.col("a") * BIN, (F.col("b") + 1) * BIN
    apart = F.greatest(b - a, F.lit(LEAST_SPREAD))
    return q.select("lang", (a - REACH_LOW * apart).alias("low"), (b + REACH_HIGH * apart).alias("high"))


def verdicts(docs: DataFrame, text: str, lang: str, id: str) -> DataFrame:
    """Measures of each row with its band, ``base_failed``, ``reason`` and ``kept``."""
    rows = measure(docs, train(docs, text, lang, chosen=teaches), text, lang, id)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = checkpoint(rows.withColumn("base_failed", failed))
    band = bands(rows).withColumnRenamed("lang", "_lang")
    wider = SHORT / F.sqrt(F.greatest(F.col("n_units"), F.lit(1)))
    joined = rows.join(band, rows.lang.eqNullSafe(band["_lang"]), "left")
    reason = F.when(F.col("base_failed"), "base rules").when(F.col("surprise") < F.col("low") - wider, "too predictable").when(F.col("surprise") > F.col("high") + wider, "too surprising")
    return joined.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> DataFrame:
    """``id``, base counts, base_failed, kept, surprise, the band of each row, and why it is rejected (null: kept)."""
    return verdicts(docs, text, lang, id).select(id, *COUNTS, "base_failed", "kept", "surprise", "low", "high", "reason")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps; as ids may repeat or be null, rows are told apart by id, text and language."""
    keyed = docs.select(row_key(docs, id, text, lang).alias("_key"), docs[text].alias("_text"), docs[lang].alias("_lang"))
    bad = verdicts(keyed, "_text", "_lang", "_key").where("not kept").select("_key").distinct()
    return without(docs, bad, id, text, lang)
