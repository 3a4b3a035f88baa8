"""Packing, hard negatives and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import negatives, packing, periodic, queries

SF = "/root/testdata/sf0.001"


# -- periodic runs -----------------------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    """Every period, every stretch."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, e - a, q) for (a, e), q in best.items())


def random_words(r):
    words = [bytes([97 + r.randrange(r.choice([1, 2, 3, 26]))]) for _ in range(r.randint(0, 80))]
    if r.random() < 0.5 and len(words) > 3:
        a = r.randrange(len(words))
        p = r.randint(1, max(1, (len(words) - a) // 2))
        words = words[:a] + (words[a : a + p] * len(words))[: len(words) - a]
        words += words[: r.choice([0, len(words) // 2, len(words)])]
    return words


@pytest.mark.parametrize("least", [12, 4, 2])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(150):
        documents = [random_words(r) for _ in range(r.randint(1, 10))]
        assert periodic.find_runs(documents, least) == [plain_runs(d, least) for d in documents]


def test_runs_of_known_strings():
    fibonacci = [b"a", b"ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for text in (fibonacci[-1], b"a" * 3000, b"ab" * 700 + b"c", (b"abc" * 9 + b"x") * 9, b""):
        words = [bytes([c]) for c in text]
        assert periodic.find_runs([words]) == [plain_runs(words)]


def test_previous_factors_and_blocks():
    words = list(b"abaababaabaab")
    sa = sorted(range(len(words)), key=lambda i: words[i:])

    def common(i, j):
        return next((k for k in range(len(words)) if max(i, j) + k >= len(words) or words[i + k] != words[j + k]), 0)

    size, origin = periodic.previous_factors(sa, [0, *(common(i, j) for i, j in zip(sa, sa[1:]))])
    assert size == [max((common(j, i) for j in range(i)), default=0) for i in range(len(words))]
    assert all(common(o, i) == n for i, (o, n) in enumerate(zip(origin, size)) if n)
    assert periodic.blocks(size) == [0, 1, 2, 3, 6, 11, 13]


def expected_digest(id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(id).encode())
    if id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    keep = [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()), sha(b" ".join(keep)))


def test_op13_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    short = [(i, t) for i, t in rows if len((t or "").split()) < 1500]
    assert len(got) == len(rows) and len(short) > 100 and any(got[i][1] for i, _ in short)
    for i, t in short:
        assert got[i] == expected_digest(i, t)


def test_runs_edges(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 40), (None, None), (5, "x y z\u001c" * 20), (5, "x y z\u001c" * 20), (80, "a b c " * 30_000), (7, "\U0001f600 é " * 9)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, id int, runs int")
    got = sorted(map(tuple, periodic.digest(docs).collect()), key=str)
    want = sorted((expected_digest(i, t) for i, t in texts if i != 80), key=str)
    assert [g for g in got if g[0] != 80] == want
    runs = {r["doc_id"]: r for r in periodic.find(docs).where("doc_id = 80").collect()}[80]
    assert [tuple(x) for x in runs["runs"]] == [(0, 90_000, 3)] and runs["collapsed"] == "a b c" and runs["n_words"] == 90_000
    assert periodic.digest(docs.limit(0)).count() == 0


# -- packing -----------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts, window=4096):
    """Every document's ids once and in order, windows without gaps."""
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    wanted = {i: [*library_ids(t), 2] for i, t in texts}
    assert set(pieces) == set(wanted)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(wanted[i])
            at += r["length"]
            assert r["ids_crc32"] == crc(wanted[i][r["start"] : at])
        assert at == len(wanted[i])
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return windows


def test_op11_packs_everything(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    windows = check_packing(queries.op11_packing(spark, SF).collect(), texts)
    total = sum(r["length"] for own in windows.values() for r in own)
    assert len(windows) <= -(-total // 4096) + 1


def test_short_way_equals_library():
    with open(PATH) as f:
        words = packing.Words(f.read())
    assert words.short
    r = random.Random(5)
    letters = [chr(c) for c in range(1, 0x250)] + ["Σ", "ς", "İ", "́", "ﬁ", "ẞ", "中", "\U0001f600"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(4000)] + ["it's they'LL 'RE x's", "<|endoftext|> a<|startoftext|>", "Ördnung12³ ÉTÉ\u0085x a b", "é".encode().decode(), "é"]
    for t in [*texts, *letters]:
        assert np.frombuffer(words.text(t), "<u4").tolist() == library_ids_cached(t), repr(t)


_TOKENIZER = []


def library_ids_cached(text):
    from tokenizers import Tokenizer

    if not _TOKENIZER:
        _TOKENIZER.append(Tokenizer.from_file(PATH))
        _TOKENIZER[0].encode_special_tokens = True
    return _TOKENIZER[0].encode(text, add_special_tokens=False).ids


def best_sum(lengths, room):
    reach = {0}
    for x in lengths:
        reach |= {a + x for a in reach if a + x <= room}
    return max(reach)


def test_fullest_is_closest():
    r = random.Random(2)
    for _ in range(300):
        have = {r.randint(1, 40): r.randint(1, 4) for _ in range(r.randint(0, 7))}
        room = r.randint(0, 120)
        got = packing.fullest(have, room)
        assert all(0 < n <= have[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == best_sum([k for k, n in have.items() for _ in range(n)], room)


def test_multisets_use_all_lengths():
    r = random.Random(3)
    have = {k: r.choice([1, 5, 1_000_000_007]) for k in r.sample(range(1, 4097), 900)}
    made = packing.multisets(have)
    assert len(made) <= len(have)
    for k, n in have.items():
        assert sum(c.get(k, 0) * times for c, times in made) == n
    assert all(sum(k * n for k, n in c.items()) <= 4096 for c, _ in made)
    assert len(packing.places(made)) <= len(made) * 90


def test_packing_edges(spark):
    texts = [(1, None), (2, ""), (3, "word " * 9_000), (4, "x"), (5, "\U0001f600é " * 50), (6, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, length int, salt int, number int")
    rows = packing.pack(docs, PATH, ids=True).collect()
    check_packing(rows, texts)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    check_packing(packing.pack(docs, PATH, window=64).collect(), texts, 64)
    twice = packing.pack(spark.createDataFrame([(None, "same text")] * 3, "doc_id long, text string"), PATH).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
    assert packing.pack(docs.limit(0), PATH).count() == 0


# -- hard negatives ----------------------------------------------------------------------------------------------------


def plain_mine(rows, every=2, positives=5, negatives_=10):
    """All products."""
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (label, [256 * float(x) for x in v])
        own[i] = min(own.get(i, key), key)
    own = {i: (label, [int(np.floor(x)) for x in v]) for i, (label, v) in own.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        scores = sorted((-dot(v, w), i, other) for i, (other, w) in own.items() if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scores if s[2] == label][:positives]:
            hit = [s for s in scores if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives_]
            out += [(a, i, k, j, -p, -n) for k, (n, j, _) in enumerate(hit, 1)]
    return sorted(out)


def mined(spark, rows, every=2):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, label int, embedding array<float>, id int, norm double")
    return sorted(map(tuple, negatives.mine(negatives.candidates(df), F.expr(f"id % {every} = 0")).collect()))


def test_negatives_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, int(r.integers(0, 3)), [float(np.float32(x)) for x in r.normal(size=6) * r.choice([0.2, 1, 4])]) for i in range(300)]
    rows += [(1000 + i, i % 4, [0.5, 0.25, 0.0, -0.5, 1.0, 0.125]) for i in range(40)]  # ties
    want = plain_mine(rows, 5)
    assert len(want) > 500
    assert mined(spark, rows, 5) == want
    monkeypatch.setattr(negatives, "SLICE", 4000)  # many slices of anchors
    assert mined(spark, rows, 5) == want


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (2, 1, [2.0, 1.0]), (4, 2, [1.0, 1.0]), (4, 2, [1.0, 1.0]), (4, 3, [9.0, 9.0]), (6, None, [1.0, 1.0]), (8, 2, None),
        (10, 2, [1.0, None]), (12, 2, [nan, 1.0]), (14, 2, [inf, 1.0]), (16, 2, []), (18, 1, []), (20, 1, [1.0]), (22, 2, [0.5]), (None, 2, [1.0, 1.0]), (24, 2, [0.0, 0.0]), (26, 1, [0.0, 0.0]),
        (28, 1, [-1.0, -1.0]), (30, 2, [0.001, -0.001]),
    ]
    assert mined(spark, rows) == plain_mine(rows)
    assert mined(spark, []) == []
    huge = [(i, i % 2, [float(np.float32(x * 1e4)) for x in (1 + i % 7, 3e8, -i)]) for i in range(30)]
    want = [(*t[:4], *(min(x, (1 << 63) - 1) for x in t[4:])) for t in plain_mine(huge)]
    assert [t[:4] for t in mined(spark, huge)] == [t[:4] for t in want]


def test_buckets_are_left_out(monkeypatch):
    a = negatives.Anchors(np.array([0]), np.array([1]), np.array([[3.0, 4.0]]), np.array([0]), np.array([-np.inf]), np.array([np.inf]), np.array([-np.inf]), True, 2)
    long, short = np.array([[30.0, 40.0], [3.0, 4.0], [6.0, 8.0]]), np.array([[0.0, 1.0]])
    a.look(np.array([1, 2, 3]), np.array([1, 1, 1]), long, 50.0)
    assert a.bound.tolist() == [50.0] and a.found.tolist() == [1, 3]
    monkeypatch.setattr(negatives, "_products", lambda *x: pytest.fail("multiplied"))
    a.look(np.array([4]), np.array([1]), short, 1.0)
