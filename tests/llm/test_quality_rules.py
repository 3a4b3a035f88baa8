import math
import random
from collections import Counter

import pytest

from rasterloom.llm import kneser_ney as K
from rasterloom.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, surprise string, kept string, _key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "a", "b", "c") for i, t, g in rows], SCHEMA)


def corpus(seed=5, n=60):
    r = random.Random(seed)
    syllables = ["an", "the", "in", "er", "on", "re", "st", "ou"]
    make = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(30, 90)))
    return [(i, make() + ".", ["en", "de", None][i % 3]) for i in range(n)]


def plain_counts(text):
    words = text.encode().split()
    lines, dup = [], 0
    for x in text.split("\n"):
        if x.encode().split():
            dup += x in lines
            lines.append(x)
    w = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(w)
    inside = {j for i, x in enumerate(w) if n[x] > 1 for j in range(i, i + 5)}
    return len(words), sum(len(x.decode()) for x in words), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_base_counts_equal_brute_force():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b", "ab ", "a ", " ", "\n", "\t", "é", " ", "\x1c", "#", "|", "a b a b\n"]) for _ in range(r.randint(0, 60)))
        assert K.base_counts(t) == plain_counts(t), t


def plain_model(rows):
    """Interpolated modified Kneser-Ney over UTF-16 units, with dictionaries."""
    def units(t):
        raw = t.encode("utf-16-le")
        return [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]

    grams = Counter(tuple(u[i : i + 4]) for t in rows for u in [units(t)] for i in range(len(u) - 3))
    tables, times = {4: grams}, {4: grams}
    for k in (3, 2, 1):
        tables[k], times[k] = Counter(g[1:] for g in tables[k + 1]), Counter()
        for g, n in times[k + 1].items():
            times[k][g[1:]] += n
    cuts = {}
    for k, t in tables.items():
        n = [sum(c == i for c in t.values()) for i in range(1, 5)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        cuts[k] = [max(0.1, min(i - 0.05, i - (i + 1) * y * n[i] / max(n[i - 1], 1))) for i in (1, 2, 3)]

    def cut(k, c):
        return cuts[k][min(c, 3) - 1]

    sums, mass = {}, {}
    for k, t in tables.items():
        sums[k], mass[k] = Counter(), Counter()
        for g, c in t.items():
            sums[k][g[:-1]] += c
            mass[k][g[:-1]] += cut(k, c)

    def p(g):
        k = len(g)
        h = g[:-1]
        if k == 1:
            return (tables[1][g] - cut(1, tables[1][g])) / sums[1][()] + mass[1][()] / sums[1][()] / len(tables[1])
        return (tables[k][g] - cut(k, tables[k][g])) / sums[k][h] + mass[k][h] / sums[k][h] * p(g[1:])

    before = {k: Counter() for k in times}
    for k, t in times.items():
        for g, n in t.items():
            before[k][g[:-1]] += n
    worst = min(math.log(p(g)) for t in times.values() for g in t)

    def surprise(t):
        """Probabilities of what other places have too, else the weight of the context (if other places have it) and a unit less."""
        u = units(t)
        places = [tuple(u[i : i + 4]) for i in range(len(u) - 3)]
        own = {k: Counter(g[-k:] for g in places) for k in times}
        contexts = {k: Counter(g[-k:-1] for g in places) for k in times}
        total = 0.0
        for place in places:
            for k in (4, 3, 2, 1):
                g, h = place[-k:], place[-k:-1]
                if times[k][g] > own[k][g]:
                    total += math.log(p(g))
                    break
                if k == 1:
                    total += worst
                elif h in times[k - 1] and before[k][h] > contexts[k][h]:
                    total += math.log(mass[k][h] / sums[k][h])
        return -total / max(len(places), 1)

    return surprise


def test_surprise_equals_a_plain_model(spark):
    rows = corpus()
    docs = frame(spark, rows)
    model = K.train(docs)
    got = {r.doc_id: r for r in K.measure(docs, model).collect()}
    for lang in ("en", "de", None):
        own = [(i, t) for i, t, g in rows if g == lang]
        model = plain_model([t for _, t in own])
        for i, t in own:
            assert got[i].surprise == pytest.approx(model(t), abs=1e-4)
            assert tuple(got[i][c] for c in K.COUNTS) == plain_counts(t)


def test_no_ngram_is_lost_in_small_shards(spark):
    rows = [x for x in corpus(n=30) if x[2] == "en"]
    docs = frame(spark, rows)
    plain = plain_model([t for _, t, _ in rows])
    got = {r.doc_id: r.surprise for r in K.measure(docs, K.train(docs, slots=256)).collect()}
    assert all(got[i] == pytest.approx(plain(t), abs=1e-4) for i, t, _ in rows)


def test_strings_of_no_language_are_rejected(spark):
    r = random.Random(2)
    junk = "".join(chr(r.randrange(0x4E00, 0x9FFF)) + (" " if k % 5 == 0 else "") for k in range(600))
    same = "the " * 100
    rows = [*corpus(n=90), (900, junk, "en"), (901, same, "en"), (902, None, "en"), (903, "", None), (904, "x", "xx"), (None, corpus()[0][1], "en"), (None, corpus()[0][1], "en")]
    got = K.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    assert not by[900].base_failed and not by[900].kept
    assert by[901].base_failed and not by[901].kept
    assert by[902].n_words == by[903].n_words == 0 and by[902].surprise is None and not by[902].kept
    assert all(by[i].kept for i in range(90)) and sum(x.kept for x in got if x.doc_id is None) == 2
    kept = K.keep_good(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in kept.collect()) == sorted([*range(90), -1, -1])
    assert {x._key for x in kept.collect()} == {"c"}


def test_junk_does_not_teach_the_model_that_it_is_usual(spark):
    good = corpus(n=90)
    stuck = [(200 + i, " ".join(w + "#$%"[i % 3] * 3 for w in t.split()), g) for i, t, g in corpus(seed=6, n=24)]
    piped = [(300 + i, " | ".join(t.split()), g) for i, t, g in corpus(seed=7, n=24)]
    got = {x.doc_id: x for x in K.judge(frame(spark, good + stuck + piped)).collect()}
    assert all(got[i].kept for i, *_ in good)
    assert not any(got[i].kept for i, *_ in stuck + piped)
    assert sum(not got[i].base_failed for i, *_ in stuck + piped) > 40


def test_both_ends_of_the_band_reject_in_each_language(spark):
    r = random.Random(9)
    syllables = {"en": ["an", "the", "in", "er", "on", "re", "st", "ou", "ha", "ing", "ly", "ed"], "de": ["sch", "ein", "ü", "ch", "ge", "ung", "ber", "den", "keit", "ß", "ver", "tz"], None: ["ción", "ñ", "os", "la", "que", "ar", "mente", "es", "bo", "ga", "ra", "do"]}
    word = lambda g: "".join(r.choice(syllables[g]) for _ in range(r.randint(1, 3)))
    rows = [(i, " ".join(word(g) for _ in range(r.randint(60, 120))), g) for i in range(240) for g in [["en", "de", None][i % 3]]]
    few = {g: [a, b, a + b] for g, x in syllables.items() for a, b in [sorted(x, key=len)[-2:]]}

    def varied(words):
        """Few words, but hardly any run of five twice."""
        out = [words[0]] * 4
        seen = set()
        while len(out) < 110:
            fresh = [w for w in words if (*out[-4:], w) not in seen]
            out.append(r.choice(fresh or words))
            seen.add(tuple(out[-5:]))
        return " ".join(out)

    dull = [(300 + i, varied(few[g]), g) for i, g in enumerate(few)]
    odd = [(310 + i, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(80)), g) for i, g in enumerate(few)]
    got = {x.doc_id: x for x in K.judge(frame(spark, rows + dull + odd)).collect()}
    assert all(got[i].kept and got[i].reason is None for i, *_ in rows)
    assert not any(got[i].base_failed for i, *_ in dull + odd)
    assert {got[i].reason for i, *_ in odd} == {"too surprising"}
    assert {got[i].reason for i, *_ in dull} == {"too predictable"}, [got[i] for i, *_ in dull]
    assert not any(got[i].kept for i, *_ in dull + odd)
    # kept is what the band says, row by row
    for x in got.values():
        wider = K.SHORT / math.sqrt(sum(len(t) - 3 for i, t, _ in rows + dull + odd if i == x.doc_id))
        assert x.kept == (not x.base_failed and x.low - wider <= x.surprise <= x.high + wider)


def test_own_counts_are_held_out(spark):
    docs = frame(spark, [*corpus(n=60), (900, "qzxv jkwq " * 1 + "".join(chr(0x4E00 + k) for k in range(400)), "en")])
    got = {x.doc_id: x for x in K.measure(docs, K.train(docs)).collect()}
    assert got[900].surprise > 5 * max(got[i].surprise for i in range(0, 60, 3))


def test_rules_on_an_empty_table(spark):
    assert K.judge(frame(spark, [])).collect() == [] and K.keep_good(frame(spark, [])).collect() == []


# -- classifier ------------------------------------------------------------------------------------------------------------------


def labelled(n=600, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 120))]
        text = " ".join(words) + "." if good else r.choice([" | ".join(words), "!! ".join(w.upper() for w in words), " ".join(words[:3] * 30), "## ".join(words)])
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Q.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 100 < len(held) < 200
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_labels_of_held_out_rows_are_never_seen(spark):
    rows, labels = labelled(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    import zlib

    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    one, two = (Q.judge(docs, spark.createDataFrame(x, "doc_id long, quality int")).orderBy("doc_id").collect() for x in (labels, turned))
    assert [r.score for r in one] == [r.score for r in two]


def test_compiled_columns_equal_the_rules(spark):
    rows, labels = labelled(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stats = Q.measured(docs)
    model = Q.train(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 0 < len(model.rules) < 100
    import numpy as np

    t = stats.select("*", model.column().alias("score")).toPandas()
    assert np.allclose(model.score(t[list(Q.STATISTICS)].to_numpy()), t["score"])


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b c", "z"), (3, "word " * 50_000, "w"), (3, "word " * 50_000, "w")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.judge(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got) and all(r.held_out is not None for r in got)
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 1), (7, 0)], "doc_id long, quality int")
    assert len(Q.judge(docs, odd).collect()) == 5
    assert Q.judge(docs.limit(0), none).collect() == []
