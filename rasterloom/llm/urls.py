"""URL filter: host and path rules, and a Bloom filter cascade over all domains of the corpus.

The list is a table of domains, of any size; a listed domain blocks its host and all subdomains. Keys are domains: those of two
labels and more that a host lies in, itself included (a host of one label is its own only key). The cascade's first filter
encodes the listed keys. The second encodes those unlisted keys of the corpus that the first one lets through by mistake, the
third the listed ones that the second one holds by mistake, and so on until a filter makes no mistakes. As the key universe is
complete, membership is exact for every host of the corpus: walking the filters, the first that lacks a key decides. Filters
are built in Spark (words of bits are or-ed by position) and sent to the workers; the pages are not joined with anything.
Keys are known by 126 bits of hashes, so that the universe travels as pairs of numbers.

Filters take ``BITS`` bits a key. The first filter of a cascade grows with the list, the second with the mistakes that the first makes
over the universe, one key in about fifty. Keys are dealt by hash to as many shards as keep the filters of each within
``MAX_BITS``, by the numbers of listed and of all keys; each shard has a cascade, and a worker asks one after the other, of which it holds
one at a time, in a single pass over the pages.

Null urls and urls without ``://`` have the empty host and path; the empty host is a key like any other. Repeated rows
stay; rows are judged one by one. Null and repeated domains in the list change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.runtime import checkpoint

#: Bits and hashes for each key: one mistake in about fifty.
BITS, HASHES = 8, 5
MAX_BITS = 1 << 28
MAX_LEVELS = 64

#: (verdict, domain, path): a rule fits its domain and all subdomains where the path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: What is let through by mistake.
MISTAKES = 1 / 40

#: The default list has each of these names, alone and with each number below ``SITES``, under each of these domains.
SITES = 100
NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
UNDER = ("com", "net", "org", "info", "example.com", "example.net", "example.org")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def default_list() -> list[str]:
    return [f"{name}{n}.{domain}" for name in NAMES for domain in UNDER for n in ("", *range(SITES))]


def keys_of(host: str) -> list[tuple[int, int]]:
    """Two non-negative hashes of each key of a host."""
    out, at, end = [], 0, host.rfind(".")
    while True:
        out.append(_hashes(host[at:]))
        at = host.find(".", at) + 1
        if not 0 < at <= end:
            return out


def _hashes(key: str) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return both >> 65, both & (1 << 63) - 1


def _hashed(df: DataFrame, keys: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """``a, b``: the distinct keys of the texts in the only column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = list({k for text in set(x.column(0).to_pylist()) if text is not None for k in keys(text)})
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return df.mapInArrow(run, "a long, b long").distinct()


class Cascade:
    """Alternating Bloom filters over pairs of hashes."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []

    @staticmethod
    def places(a: np.ndarray, b: np.ndarray, bits: int, i: int) -> np.ndarray:
        return (a % bits + i * (b % bits)) % bits

    def passes(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits, words = self.levels[level]
        held = np.ones(len(a), bool)
        for i in range(HASHES):
            at = self.places(a, b, bits, i)
            held &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return held

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for the keys of the universe."""
        out = np.full(len(a), len(self.levels) % 2 == 1)
        left = np.arange(len(a))
        for level in range(len(self.levels)):
            held = self.passes(level, a[left], b[left])
            out[left[~held]] = level % 2 == 1
            left = left[held]
        return out


def _filter_bits(keys: DataFrame, n: int, level: int) -> tuple[int, np.ndarray]:
    bits = (max(1024, n * BITS) | 1) + 2 * level  # another modulus on each level, so that the same mistake does not come back
    place = F.explode(F.array(*[F.pmod(F.pmod("a", F.lit(bits)) + i * F.pmod("b", F.lit(bits)), F.lit(bits)) for i in range(HASHES)])).alias("p")
    word = F.shiftright("p", 6)
    found = keys.select(place).groupBy(word.alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros((bits + 63) // 64, np.uint64)
    words[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits, words


def build_cascade(listed: DataFrame, others: DataFrame) -> Cascade:
    """The cascade of the keys ``a, b`` that are listed, over those that are not."""
    cascade, inside, outside = Cascade(), checkpoint(listed), checkpoint(others)
    n = inside.count()
    while n or not cascade.levels:
        if len(cascade.levels) == MAX_LEVELS:
            raise ValueError("a listed and an unlisted key have the same hashes")
        cascade.levels.append(_filter_bits(inside, n, len(cascade.levels)))
        sent, level = outside.sparkSession.sparkContext.broadcast(cascade), len(cascade.levels) - 1

        def wrong(batches: Iterator[pa.RecordBatch], sent=sent, level=level) -> Iterator[pa.RecordBatch]:
            for x in batches:
                yield x.filter(pa.array(sent.value.passes(level, x.column(0).to_numpy(), x.column(1).to_numpy())))

        inside, outside = checkpoint(outside.mapInArrow(wrong, "a long, b long")), inside
        n = inside.count()
    return cascade


def shards_for(listed: int, keys: int, max_bits: int = MAX_BITS) -> int:
    """Shards whose filters have at most about ``max_bits`` each: all levels of a cascade over so many keys, added up."""
    inside, outside, total = float(listed), float(keys - listed), 0.0
    while inside >= 1:
        total += inside * BITS
        inside, outside = outside * MISTAKES, inside
    return max(1, -(-int(total) // max_bits))


def build(hosts: DataFrame, domains: DataFrame, max_bits: int = MAX_BITS) -> list[Broadcast]:
    """Cascades over all keys of the column of hosts, those in the column of listed domains being listed; dealt by ``a``."""
    universe = checkpoint(_hashed(hosts, keys_of))
    listed = checkpoint(universe.join(_hashed(domains, lambda d: [_hashes(d)]), ["a", "b"], "left_semi"))
    shards = shards_for(listed.count(), universe.count(), max_bits)
    out = []
    for k in range(shards):
        own = lambda df, k=k: df.where(F.col("a") % shards == k) if shards > 1 else df
        out.append(hosts.sparkSession.sparkContext.broadcast(build_cascade(own(listed), own(universe).join(listed, ["a", "b"], "left_anti"))))
        out[-1].__dict__.pop("_value", None)
    return out


def asked(shards: list[Broadcast], hosts: list[str]) -> dict[str, bool]:
    """Whether each host is listed; hosts have to be in the universe."""
    keys, owner = [], []
    for i, host in enumerate(hosts):
        own = keys_of(host)
        keys += own
        owner += [i] * len(own)
    (a, b), owner, held = np.array(keys, np.int64).reshape(-1, 2).T, np.array(owner, np.int64), np.zeros(len(hosts), bool)
    for k, x in enumerate(shards):
        here = a % len(shards) == k
        held[owner[here][x.value.listed(a[here], b[here])]] = True
        if len(shards) > 1 and getattr(x, "_path", None):
            x.__dict__.pop("_value", None)
    return dict(zip(hosts, held.tolist()))


def judge(pages: DataFrame, url: str = "url", id: str = "page_id", rules: tuple = RULES, domains: DataFrame | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """``id, host, path, rule, verdict`` of each row: the rule's verdict, else block if the host is listed, else allow.

    domains: a table whose only column has the listed domains in lower case; default: :func:`default_list`.
    """
    kind = pages.schema[id].dataType.simpleString()
    if domains is None:
        domains = pages.sparkSession.createDataFrame([(d,) for d in default_list()], "domain string")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parts = pages.select(pages[id].alias("id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    shards = build(parts.select("host").distinct(), domains, max_bits)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            hosts = x.column(1).to_pylist()
            held = asked(shards, list(set(hosts)))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([held[h] for h in hosts], pa.bool_())], ["id", "host", "path", "rule", "said", "listed"])

    keyed = parts.select("id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    out = keyed.mapInArrow(blocked, f"id {kind}, host string, path string, rule string, said string, listed boolean")
    return out.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def oracle(rules: tuple = RULES) -> str:
    """The same result in DuckDB SQL, with the default list."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda d, p: f"((host = '{d}' or ends_with(host, '.{d}')) and starts_with(path, '{p}'))"
    rule = " ".join(f"when {fits(d, p)} then '{d}{p}'" for _, d, p in by_length)
    said = " ".join(f"when {fits(d, p)} then '{v}'" for v, d, p in by_length)
    listed = ", ".join(f"('{d}')" for d in default_list())
    return f"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
listed as (select * from (values {listed}) t(domain)),
blocked as (select distinct host from parts, listed where host = domain or ends_with(host, '.' || domain))
select page_id, host, path, case {rule} end as rule,
  case {said} when host in (select host from blocked) then 'block' else 'allow' end as verdict
from parts"""
