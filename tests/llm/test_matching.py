import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate as D
from rasterloom.llm import induced, licenses, suffix_dedup, urls

SCHEMA = "doc_id long, text string, k1 string, id string, spans string, words string, h string, _key string, score string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, *"abcdefg") for i, t in enumerate(texts)], SCHEMA)


# -- external induced sorting ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("memory", [0, 200, 3000, 1 << 30])
def test_induced_order_and_common_prefixes(tmp_path, memory):
    r = random.Random(memory)
    for _ in range(150):
        n, a, cap = r.randint(1, 70), r.choice([1, 2, 3, 8]), r.choice([3, 8, 10, 100])
        t = [r.randint(1, a) for _ in range(n)] + [0]
        if r.random() < 0.3:
            t = (t[:5] * 20)[: n // 2] + t
            t = [max(1, x) for x in t[:-1]] + [0]
        store = induced.Store(str(tmp_path), memory)
        store.step = r.choice([1, 2, 7, 1024])
        blocks = list(induced.Sorter(np.array(t, np.uint16), a + 1, store, cap).sorted())
        got, common = np.concatenate([p for p, _ in blocks]).tolist(), np.concatenate([c for _, c in blocks]).tolist()
        want = sorted(range(len(t)), key=lambda i: t[i:], reverse=True)
        assert got == want

        def shared(x, y):
            k = 0
            while k < cap and max(x, y) + k < len(t) and t[x + k] == t[y + k]:
                k += 1
            return k

        assert common == [0, *(shared(x, y) for x, y in zip(want, want[1:]))]
    assert not list(tmp_path.iterdir())


def test_repeated_starts_equal_brute_force():
    r = random.Random(2)
    for _ in range(400):
        size, a = r.choice([2, 3, 5]), r.choice(["a", "ab", "abc"])
        xs = ["".join(r.choice(a) for _ in range(r.randint(size, size + 8))).encode() for _ in range(r.randint(1, 6))]
        ws = [r.randint(1, len(x) - size + 1) for x in xs]
        n = Counter(x[i : i + size] for x, w in zip(xs, ws) for i in range(w))
        assert [q.tolist() for q in induced.repeated_starts(xs, ws, size, r.choice([100, 1 << 28]))] == [[i for i in range(w) if n[x[i : i + size]] > 1] for x, w in zip(xs, ws)]


def test_shared_bytes_are_one_symbol():
    """Parts of 64 starts whose strings hold the same 337 bytes: a quarter of the symbols, the starts of brute force."""
    r = random.Random(22)
    make = lambda n: "".join(r.choice("ab") for _ in range(n)).encode()
    parts, size = [], 64
    for _ in range(40):
        core, sides = make(401 - size), [(make(63), make(63)) for _ in range(2)]
        for _ in range(r.randint(2, 6)):
            (x, y), at = r.choice(sides), r.randrange(30)
            x, y = (x[:at] + b"c" + x[at + 1 :], y) if r.random() < 0.4 else (x, y[: at + 1] + b"c" + y[at + 2 :]) if r.random() < 0.5 else (x, y)
            left, right = r.choice([0, 0, r.randrange(64)]), r.choice([63, 63, r.randrange(64)])
            if 63 - left + right >= 63:
                parts.append((x[left:], core, y[:right]))
    shard, names = induced.Shard(size, 1 << 20), {}
    for x, core, y in parts:
        if core not in names:
            names[core] = shard.name()
        shard.add(x + core + y, len(x) + len(y) - 62, (len(x), len(x) + len(core), names[core]))
    assert 0 < 4 * shard.size < 1.25 * sum(len(x + core + y) for x, core, y in parts)
    n = Counter((x + core + y)[i : i + 400] for x, core, y in parts for i in range(len(x) + len(y) - 62))
    got = [q.tolist() for q in shard.repeated()]
    assert got == [[i for i in range(len(x) + len(y) - 62) if n[(x + core + y)[i : i + 400]] > 1] for x, core, y in parts]
    assert any(got) and not all(len(q) == len(x) + len(y) - 62 for q, (x, _, y) in zip(got, parts))


def test_least_values_of_ranges(tmp_path):
    r = np.random.default_rng(3)
    for n in (1, 5, 1023, 1024, 1025, 9000):
        x = r.integers(0, 400, n).astype(np.uint16)
        a, b = np.sort(r.integers(0, n, (2, 3000)), axis=0)
        got = induced.RangeMin(x, induced.Store(str(tmp_path), 1 << 20)).least(a, b)
        assert got.tolist() == [int(x[i : j + 1].min()) for i, j in zip(a.tolist(), b.tolist())]


def test_a_shard_many_times_larger_than_memory():
    """The sorter's arrays and queues are on disk: memory that is not mapped files stays near the bound, and the result is the same."""
    r, letters = random.Random(4), "etaoin shrdlu"
    base = "".join(r.choice(letters) for _ in range(20_000))
    strings, windows = [], []
    for _ in range(700):
        i = r.randrange(len(base) - 200)
        strings.append((base[i : i + 100] + r.choice(letters) + base[i + 100 : i + 200]).encode())
        windows.append(len(strings[-1]) - 119)
    counts = Counter(x[i : i + 120] for x, w in zip(strings, windows) for i in range(w))
    want = [[i for i in range(w) if counts[x[i : i + 120]] > 1] for x, w in zip(strings, windows)]
    memory, shard = 60_000, induced.Shard(120, 60_000)
    for x, w in zip(strings, windows):
        shard.add(x, w)
    assert 8 * 8 * shard.size > 100 * memory  # a few arrays of eight bytes a suffix
    tracemalloc.start()
    got = [x.tolist() for x in shard.repeated()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and any(want)
    assert peak < 1_500_000, peak


# -- suffix-array deduplication -----------------------------------------------------------------------------------------------------


def plain_dedup(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(c for c, x in zip(b, gone) if not x)
        out.append((len(b), sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def copied_texts(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 120))) for _ in range(30)]
    out = []
    for _ in range(90):
        x, k = r.choice(base), r.random()
        i = r.randrange(len(x))
        out.append(x[:i] + r.choice(base)[: r.randint(0, 200)] + x[i:] if k < 0.3 else x[:i] + "Z" + x[i + 1 :] if k < 0.5 else "ab " * r.randint(1, 60) if k < 0.6 else x)
    return out


@pytest.mark.parametrize("seed,shard,memory,hot", [(4, 2000, 5000, 1024), (5, 8 << 20, 64 << 20, 1), (6, 8 << 20, 64 << 20, 3)])
def test_dedup_equals_brute_force(spark, seed, shard, memory, hot):
    texts = [*copied_texts(seed), None, "", None, "x" * 300, "short"]
    want = plain_dedup(texts, 80)
    docs = frame(spark, texts, [i if i % 7 else None for i in range(len(texts))])
    got = suffix_dedup.digest(docs, length=80, gram=16, shard=shard, memory=memory, hot=hot).collect()
    assert Counter(tuple(r)[1:] for r in got) == Counter(want)
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = suffix_dedup.deduplicated(docs, length=80, gram=16).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == want[r.doc_id][3] for r in kept if r.doc_id is not None)


def test_planted_passages_go_by_their_bytes(spark):
    """Passages of 40 to 120 words in three texts each: gone where they have 400 bytes with what surrounds them alike, else whole."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in range(40, 121, 4)]
    exact = ["".join(r.choice("qrstuv") for _ in range(n)) for n in (397, 398, 399, 400)]  # a blank on each side belongs to what repeats
    texts, sizes = [], []
    for p in [*passages, *exact]:
        for own in "XYZ":
            texts.append(" ".join(word() for _ in range(80)) + f"{own} {p} {own}" + " ".join(word() for _ in range(80)))
            sizes.append(len(p.encode()) + 2)
    clean = [" ".join(word() for _ in range(200)) for _ in range(20)]
    got = {x.doc_id: x for x in suffix_dedup.digest(frame(spark, texts + clean)).collect()}
    assert {n >= 400 for n in sizes[: 3 * len(passages)]} == {True, False}
    for i, n in enumerate(sizes):
        assert (got[i].n_removed, got[i].n_spans) == ((n, 1) if n >= 400 else (0, 0)), (i, n)
        assert got[i].n_bytes == len(texts[i].encode())
    assert all(got[len(texts) + k].n_removed == 0 for k in range(20))


def test_dedup_at_full_length(spark):
    r = random.Random(9)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, q = make(400), make(399)
    texts = [make(300) + p + make(100), make(50) + p, make(200) + q + make(200), q + "!" + make(100), make(1_200_000)[:600_000] + p, "z" * 401]
    got = sorted(suffix_dedup.digest(frame(spark, texts)).collect())
    assert [tuple(r)[1:] for r in got] == plain_dedup(texts[:4], 400)[:4] + [(600_400, 400, 1, hashlib.sha256(texts[4][:600_000].encode()).hexdigest()), (401, 401, 1, hashlib.sha256(b"").hexdigest())]


def test_dedup_of_an_empty_table(spark):
    assert suffix_dedup.digest(frame(spark, [])).collect() == []


# -- decontamination ------------------------------------------------------------------------------------------------------------------


def plain_alignment(p, q):
    best, row = 0, [0] * (len(p) + 1)
    for w in q:
        new = [0]
        for j, x in enumerate(p, 1):
            new.append(max(0, row[j - 1] + (2 if w == x else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best / (2 * len(q))


def test_alignment_equals_brute_force():
    r = random.Random(3)
    for _ in range(500):
        p, q = ([bytes([97 + r.randrange(4)]) for _ in range(r.randint(1, 25))] for _ in range(2))
        score, a, z = D.align(p, q)
        assert score == plain_alignment(p, q)
        if score:
            assert plain_alignment(p[a:z], q) == score


def benchmark(r, n=12):
    words = ["w%d" % i for i in range(400)] + ["the", "of", "to", "a"] * 40
    return [" ".join(r.choice(words) for _ in range(r.randint(20, 45))) for _ in range(n)], words


def test_copies_are_found_and_clean_texts_are_not(spark):
    r = random.Random(4)
    items, words = benchmark(r)
    filler = lambda n: " ".join("f%d" % r.randrange(2000) for _ in range(n))

    def edited(t):
        w = t.split()
        for k in range(3, len(w), 8):
            w[k] = "changed"
        return " ".join(w)

    hot = [filler(30) + " " + items[0].upper() + "! " + filler(20) for _ in range(120)]
    copies = [filler(40) + " " + items[i] + ", " + filler(60) for i in range(1, 8)] + [filler(10) + " " + edited(items[i]) + " " + filler(10) for i in range(8, 12)]
    clean = [filler(200) for _ in range(20)] + ["the of to a the of to a " + filler(5)] * 30 + [None, "", "w1 w2"]
    texts = hot + copies + clean
    table = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (None, "zz yy"), (0, items[0])], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in D.matches(frame(spark, texts), table).collect()}
    want = {(i, 0) for i in range(120)} | {(120 + k, k + 1) for k in range(11)}
    assert set(got) == want
    assert all(got[i, 0].score == 1 and (got[i, 0].start, got[i, 0].end) == (30, 30 + len(items[0].split())) for i in range(120))
    docs = frame(spark, [*texts, texts[0]], [*range(len(texts)), None])
    kept = D.keep_clean(docs, table)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == list(range(131, len(texts)))


def test_edited_and_partial_copies_are_found_in_many_rows(spark):
    r = random.Random(6)
    words = ["w%d" % i for i in range(400)]
    items = [" ".join(r.sample(words, 38)) for _ in range(2)]
    filler = lambda n: " ".join("f%d" % r.randrange(2000) for _ in range(n))
    edited = " ".join("changed" if k % 6 == 5 else w for k, w in enumerate(items[0].split()))
    half = " ".join(items[1].split()[:19])
    texts = [f"{filler(20)} {edited} {filler(20)}" for _ in range(40)] + [f"{filler(20)} {half} {filler(20)}" for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(x.doc_id, x.item_id): x.score for x in D.matches(frame(spark, texts), table).collect()}
    assert set(got) == {(i, i // 40) for i in range(80)}
    assert all(v == (58 / 76 if k == 0 else 0.5) for (_, k), v in got.items())


def test_slices_of_items_give_the_same(spark, monkeypatch):
    r = random.Random(5)
    items, _ = benchmark(r)
    table = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    docs = frame(spark, items * 2)
    whole = sorted(D.matches(docs, table).collect())
    monkeypatch.setattr(D, "SLICE", 60)
    assert sorted(D.matches(docs, table).collect()) == whole
    assert D.matches(frame(spark, []), table).collect() == [] and D.matches(docs, table.limit(0)).collect() == []


def seed_places(items, rare):
    out = {}
    for k, q, n in D.seeds(items, rare).tolist():
        out.setdefault(tuple(items[k][q : q + n]), []).append((k, q))
    return {g: sorted(p) for g, p in out.items()}


def plain_seeds(items, rare):
    """Runs made longer word by word."""
    out, new = {}, {}
    for k, words in enumerate(items):
        n = min(D.N, len(words))
        for q in range(len(words) - n + 1):
            new.setdefault(tuple(words[q : q + n]), []).append((k, q))
    while new:
        longer = {}
        for run, places in new.items():
            for k, q in places:
                if len(places) <= rare or q + len(run) == len(items[k]) and q == 0:
                    out.setdefault(run, []).append((k, q))
                elif q + len(run) < len(items[k]):
                    longer.setdefault((*run, items[k][q + len(run)]), []).append((k, q))
        new = longer
    return {g: sorted(p) for g, p in out.items() if g}


def test_seeds_equal_those_made_longer_word_by_word():
    r = random.Random(1)
    for _ in range(60):
        items = [[b"%d" % r.randrange(r.choice([1, 2, 5])) for _ in range(r.randint(0, 25))] for _ in range(r.randint(0, 9))]
        for rare in (1, 2, 5):
            assert seed_places(items, rare) == plain_seeds(items, rare)
            plain, known = plain_seeds(items, D.RARE), D.Seeds(items)
            for words in [*items[:3], [b"%d" % r.randrange(3) for _ in range(30)]]:
                want = sorted((k, p, q) for g, places in plain.items() for p in range(len(words) - len(g) + 1) if tuple(words[p : p + len(g)]) == g for k, q in places)
                assert sorted(known.hits(words)) == want


def test_repetitive_items_take_seconds(spark):
    begun = time.time()
    one = [b"ha"] * 4096
    assert len(D.seeds([one] * 24 + [[b"ha", b"hi"] * 50_000])) > 0 and time.time() - begun < 60
    table = spark.createDataFrame([(1, "ha " * 9000), (2, "a b c d e f g")], "item_id int, text string")
    docs = frame(spark, ["ha " * 5000, "ha " * 10, "x a b c d e f g y", None])
    got = {(x.doc_id, x.item_id) for x in D.matches(docs, table).collect()}
    assert got == {(0, 1), (2, 2)}


def test_matches_equal_all_alignments(spark):
    """Every passage that holds a seed, aligned with its item: nothing else and nothing less."""
    r = random.Random(12)
    items = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randint(3, 20))) for _ in range(12)]
    texts = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts += [" ".join(f"f{k}" for k in range(9)) + " " + " ".join(w for w in items[k % 12].split() if r.random() > 0.15) for k in range(30)]
    listed = [D.words_of(t) for t in items]
    plain = plain_seeds(listed, D.RARE)
    want = {}
    for i, t in enumerate(texts):
        words = D.words_of(t)
        hits = [(k, p, q) for g, places in plain.items() for p in range(len(words) - len(g) + 1) if tuple(words[p : p + len(g)]) == g for k, q in places]
        for k, begin, end in D._passages(words, hits, [(None, w) for w in listed]):
            score, a, z = D.align(words[begin:end], listed[k])
            if score >= D.LEAST:
                best = max(want.get((i, k), (0, 0, 0)), (score, -(begin + a), begin + z))
                want[i, k] = best
    table = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(x.doc_id, x.item_id): (x.score, -x.start, x.end) for x in D.matches(frame(spark, texts), table).collect()}
    assert len(want) > 20 and got == want


def test_common_runs_are_made_longer_and_long_items_cut(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(D, "RARE", 3)
    monkeypatch.setattr(D, "PART", 60)
    head = "which of the following is true about"
    items = [f"{head} k{i} " + " ".join("z%d" % r.randrange(5000) for _ in range(6)) for i in range(20)] + [head]
    book = ["b%d" % i for i in range(500)]
    table = spark.createDataFrame([*enumerate(items), (50, " ".join(book)), (51, items[3])], "item_id int, text string")
    listed = [D.words_of(t) for t in items]
    places = seed_places(listed, 3)
    assert max(map(len, places.values())) <= 3 and tuple(head.encode().split()) in places and places == plain_seeds(listed, 3)
    filler = " ".join("f%d" % i for i in range(30))
    texts = [f"{filler} {t} {filler}" for t in items] + [f"{filler} {' '.join(book[200:260])} {filler}", f"{filler} {' '.join(book[210:230])} {filler}"]
    got = {(x.doc_id, x.item_id): x.score for x in D.matches(frame(spark, texts), table).collect()}
    assert all(got[i, i] == 1 for i in range(21)) and got[3, 51] == 1
    assert got[21, 50] > 0.7 and (22, 50) not in got
    assert all(i == k or k in (20, 51) or got[i, k] < 1 for i, k in got)


# -- URLs -----------------------------------------------------------------------------------------------------------------------------


def plain_url(u, domains=tuple(urls.default_list())):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(d + p), d + p, v) for v, d, p in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, "block" if any(host == d or host.endswith("." + d) for d in domains) else "allow")
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark):
    r = random.Random(6)
    parts = ["http://", "https://", "WWW.", "free-bets", "Example", ".com", ".net", ".org", "/en/", "/en/7", "/de/8", "/es/", "?x=1", "#t", "é", "spam-farm.", "://", "/", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(800)] + [None, "", "no scheme", "http://", "x://a.com/en/"] * 2
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x", "y") for i, t in enumerate(texts)], "page_id long, url string, host string, rule string")
    got = urls.judge(docs).collect()
    assert Counter(tuple(x)[1:] for x in got) == Counter(plain_url(t) for t in texts)
    assert all(tuple(x)[1:] == plain_url(texts[x.page_id]) for x in got if x.page_id is not None)
    assert urls.judge(docs.limit(0)).collect() == []


@pytest.mark.parametrize("max_bits", [urls.MAX_BITS, 2000])
def test_hundreds_of_listed_domains_equal_brute_force(spark, max_bits):
    r = random.Random(7)
    hosts = [".".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5))) for _ in range(3000)] + ["", "com", ".", "a..b", "x" * 200 + ".y"]
    domains = [h for h in r.sample(hosts, 700) if h.count(".") > 0] + ["com", "never.seen", None, "a.b", "a.b"]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    listed = spark.createDataFrame([(d,) for d in domains], "domain string")
    got = {x.page_id: x.verdict for x in urls.judge(pages, domains=listed, max_bits=max_bits, rules=()).collect()}
    known = {d for d in domains if d}

    def blocked(h):
        parts = h.split(".")
        return h in known or any(".".join(parts[i:]) in known for i in range(1, len(parts) - 1))

    assert got == {i: "block" if blocked(h) else "allow" for i, h in enumerate(hosts)}
    assert 0.2 < sum(v == "block" for v in got.values()) / len(hosts) < 0.95
    assert set(x.verdict for x in urls.judge(pages, domains=listed.limit(0), rules=()).collect()) == {"allow"}


def test_cascade_is_exact_for_its_universe(spark):
    hosts = [f"h{i}.com" for i in range(6000)]
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    (cascade,) = urls.build(table, table.where("cast(replace(substr(host, 2), '.com', '') as int) % 3 = 0"))
    assert len(cascade.value.levels) > 2
    assert urls.asked([cascade], hosts) == {h: i % 3 == 0 for i, h in enumerate(hosts)}


def test_shards_are_sized_by_the_universe():
    assert urls.shards_for(0, 0) == urls.shards_for(10, 1000) == 1
    assert urls.shards_for(10**6, 10**10) > urls.shards_for(10**6, 10**9) >= 1
    assert urls.shards_for(10**6, 10**10) * urls.MAX_BITS >= 10**10 * urls.MISTAKES * urls.BITS
    assert len(urls.default_list()) == len(set(urls.default_list())) == 4242


def test_shards_keep_within_the_bound(spark):
    hosts = [f"h{i}.com" for i in range(6000)]
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    shards = urls.build(table, table.where("host like '%7.com'"), 4000)
    assert len(shards) > 1
    for x in shards:
        assert sum(bits for bits, _ in x.value.levels) < 4 * 4000 + 2000 * len(x.value.levels)
    assert urls.asked(shards, hosts) == {h: h.endswith("7.com") for h in hosts}


# -- licenses ---------------------------------------------------------------------------------------------------------------------------


def plain_licenses(text):
    w = licenses.template_words(text or "")
    found = {}
    for name, templates in licenses.TEMPLATES.items():
        for t in templates:
            tw = licenses.template_words(t)
            want = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
            w2 = max(4, 1 << (len(want) - 1).bit_length())
            step = max(1, w2 // 4)
            n = max(0, len(w) - 4)
            for s in range(0, n, step):
                have = {tuple(w[i : i + 5]) for i in range(s, min(n, s + w2 + step))}
                share = len(want & have) / len(want)
                if share >= 0.8:
                    found[name] = max(found.get(name, 0), share)
    return found


def test_licenses_equal_brute_force(spark):
    r = random.Random(7)
    filler = lambda n: " ".join("f%d" % r.randrange(500) for _ in range(n))
    texts = [None, "", "one two", "the mit license", filler(5000)]
    for templates in licenses.TEMPLATES.values():
        for t in templates:
            w = t.split()
            edited = list(w)
            if len(w) > 30:
                edited[len(w) // 2] = "EDITED"
            for body in (t, t.upper(), " ".join(w[: len(w) // 2]), " ".join(edited)):
                texts.append(f"{filler(r.randint(0, 40))}\n# {body}\n{filler(r.randint(0, 40))}")
    docs = frame(spark, texts)
    got = {}
    for x in licenses.scan(docs).collect():
        got.setdefault(x.doc_id, {})[x.license] = x.containment
    want = {i: plain_licenses(t) for i, t in enumerate(texts)}
    assert got == {i: x for i, x in want.items() if x}
    again = licenses.scan(frame(spark, [texts[5], texts[5], texts[5]], [1, 1, None])).collect()
    assert len(again) == 2 and licenses.scan(frame(spark, [])).collect() == []


def test_bands_meet_the_stated_probability_for_templates_of_every_size():
    for n in range(1, 3000):
        w = licenses.size_class(n)
        step, width = licenses.window_shape(w)
        assert n <= w and width >= n + step - 1  # a template lies inside a window wherever it begins
        shared = -(-n * 4 // 5)
        alike = shared / (max(width, shared) + n - shared)
        assert (1 - alike) ** licenses.BANDS < 1 / 3000


def test_slices_of_hundreds_of_templates_equal_brute_force(spark, monkeypatch):
    r = random.Random(9)
    words = ["t%d" % i for i in range(900)]
    templates = {f"L{i}": [" ".join(r.choice(words) for _ in range(r.randint(5, 40)))] for i in range(200)}
    monkeypatch.setattr(licenses, "TEMPLATES", templates)
    monkeypatch.setattr(licenses, "SLICE", 1500)
    filler = lambda: " ".join("f%d" % r.randrange(500) for _ in range(r.randint(0, 30)))
    texts = [f"{filler()} {templates[f'L{r.randrange(200)}'][0]} {filler()} {' '.join(templates[f'L{r.randrange(200)}'][0].split()[:-1])}" for _ in range(60)]
    got = {}
    for x in licenses.scan(frame(spark, texts)).collect():
        got.setdefault(x.doc_id, {})[x.license] = x.containment
    assert got == {i: x for i, t in enumerate(texts) if (x := plain_licenses(t))}


def test_no_python_in_the_native_license_scan(spark):
    plan = licenses.scan(frame(spark, ["a"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, ["a"]), {"x": ["only four words here"]})
