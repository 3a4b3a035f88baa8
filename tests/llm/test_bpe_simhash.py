import hashlib
import random

import public_tokenizers
import tiktoken
import xxhash

from rasterloom.llm import bpe, simhash

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, n_tokens string, fp string, component_id string"
TEXTS = ["", None, "one", "The cat sat on the mat.", "The cat sat on the mat.", " \n\t ", "é😀 naïve  x" * 3, "ab" * 5000, "word " * 3000, "l'été 123456 !!!???"]


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 4 else None, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def reference():
    ranks = bpe.parse_ranks(open(PATH, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_merge_loop(spark):
    ref = reference()
    got = bpe.encode_documents(frame(spark, TEXTS), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        r = by[i if i != 4 else None]
        assert list(r.ids) == ref.encode_ordinary(t or "")
        assert bytes(r.decoded) == (t or "").encode()


def test_digests_of_random_texts(spark):
    ref, r = reference(), random.Random(7)
    texts = ["".join(r.choice("abcdeth  nio's\n\t019.!?-éüß中😀") for _ in range(r.randint(0, 200))) for _ in range(300)]
    got = bpe.digest_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect()
    for row in got:
        ids = ref.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_encoding_an_empty_table(spark):
    assert bpe.digest_documents(frame(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(fps):
        groups.setdefault(find(k), []).append(i)
    return {i: min(x for x in g if x is not None) if any(x is not None for x in g) else None for g in groups.values() for i in g}, dict(fps)


def near_texts():
    r = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    out = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(40, 400))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = "edit%d" % r.randint(0, 99)
            out.append(" ".join(copy))
    return out


def test_components_equal_brute_force(spark):
    texts = TEXTS + near_texts()
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)]
    want, fps = plain_components(rows)
    for tile in (2048, 3):
        got = simhash.near_duplicates(frame(spark, texts), tile=tile).collect()
        assert len(got) == len(texts)
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(int(r.fingerprint, 16) == fps[r.doc_id] for r in got)


def test_close_random_fingerprints_meet(spark):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(50)]
    fps = set(base) | {x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in base}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), tile=2)
    links = {frozenset((x.a, x.b)) for x in got.collect()}
    for x in signed:
        for y in signed:
            if x < y and ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 3:
                seen, todo = {x}, [x]
                while todo:
                    at = todo.pop()
                    new = {z for link in links if at in link for z in link} - seen
                    seen |= new
                    todo += new
                assert y in seen


def test_keep_one_of_each_group(spark):
    texts = near_texts()
    docs = frame(spark, texts)
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.keep_one(docs).collect()
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)
    assert set(kept[0].asDict()) == set(docs.columns)


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
