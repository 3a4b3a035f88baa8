import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from rasterloom.llm import bpe, queries


def corpus(r):
    words = ["".join(r.choice(["an", "the", "in", "er", "on", "re", "st", "ou", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    clean = [text(r.randint(40, 200)) for _ in range(60)]
    items = [" ".join("q%d" % r.randrange(900) for _ in range(30)) for _ in range(4)]
    rows = list(enumerate(clean))
    rows += [(100, clean[0]), (101, clean[1]), (102, "too short"), (103, "same words again and " * 40), (104, None), (105, clean[5] + " " + items[0] + " " + clean[6])]
    rows += [(106, text(80) + " password=hunter2222 " + text(20)), (106, text(90)), (None, text(70))]
    return rows, items


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    rows, items = corpus(random.Random(3))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "secret scan", "byte-level BPE"]
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        read = stage(spark, read, str(tmp_path))
        steps.append(read.collect())
    ids = [sorted((-1 if x.doc_id is None else x.doc_id) for x in s) for s in steps]
    assert all(set(s[0].asDict()) == set(docs.columns) for s in steps[:4])
    assert ids[0] == sorted([*range(60), 100, 101, 105, 106, 106, -1])
    assert ids[1] == sorted([*range(60), 105, 106, 106, -1])
    assert ids[2] == ids[3] == sorted([*range(60), 106, 106, -1])
    secret = [x for x in steps[3] if "[SECRET]" in x.text]
    assert len(secret) == 1 and "hunter" not in secret[0].text and secret[0].n_chars == len(secret[0].text)
    ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((len(ref.encode_ordinary(x.text)), hashlib.sha256(x.text.encode()).hexdigest()) for x in steps[3])
    assert sorted((x.n_tokens, x.decoded_sha256) for x in steps[4]) == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, steps[4]))


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.ORACLE) <= set(queries.QUERIES)
