"""License scan with DataFrame functions only: MinHash bands of overlapping windows retrieve templates, shingles verify them.

Texts are cut into lower-case words of letters and digits and into shingles of five words. Texts without any shingle of a
template can collide with none and are left out first, by the same shingle hashes. The others are cut into windows:
templates are grouped by the power of two ``w`` at or above their number of shingles, and windows of ``5 w / 4`` shingles start
at every ``w / 4`` (of ``w + 1`` at every shingle for the shortest), so each place where a template may stand lies inside
a window. A window that holds 0.8 of a template has a Jaccard similarity of 0.29 at least with it; ``BANDS`` bands of one
MinHash each miss it with a probability of at most 0.71 ** 24, less than one in three thousand. What the bands retrieve is
verified: the exact share of the template's shingles that stand in the window has to be ``LEAST`` or more.

Null or empty texts match nothing. Rows that share an id give one row for each license, with the best containment.
Templates of under five words are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, LEAST, BANDS = 5, 0.8, 24
#: Words of templates that a plan carries as literals at once; more of them take several passes over the texts.
SLICE = 20_000

# Notices of common licenses as their authors publish them, and usual one-line notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column) -> Column:
    """Hashes of all runs of five words, in order, from the array of word hashes."""
    n = F.size(hashes) - WIDTH + 1
    run = F.transform(F.slice(hashes, 1, F.greatest(n, F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(hashes, i + k) for k in range(1, WIDTH)]))
    return F.when(n > 0, run).otherwise(F.array().cast("array<bigint>"))


def _slices(templates: dict[str, list[str]]) -> Iterator[list[tuple[str, list[str]]]]:
    """(license, words) of the templates, about ``SLICE`` words at a time."""
    held, size = [], 0
    for name, texts in templates.items():
        for t in texts:
            words = template_words(t)
            if held and size + len(words) > SLICE:
                yield held
                held, size = [], 0
            held.append((name, words))
            size += len(words)
    yield held


def window_shape(w: int) -> tuple[int, int]:
    """Step and length of the windows for templates of ``w`` shingles at most."""
    step = max(1, w // 4)
    return step, w + step


def size_class(shingles: int) -> int:
    """The power of two at or above a number of shingles."""
    return 1 << (shingles - 1).bit_length()


def _templates(spark: SparkSession, rows: list[tuple[str, list[str]]]) -> list[tuple[str, int, list[int]]]:
    """(license, w, distinct shingle hashes) of each template, hashed by the same function as the texts."""
    if any(len(w) < WIDTH for _, w in rows):
        raise ValueError(f"a template has fewer than {WIDTH} words")
    one = spark.range(1)
    hashes = one.select(*[word_hashes(F.array(*[F.lit(x) for x in w])).alias(f"t{k}") for k, (_, w) in enumerate(rows)])
    hashed = hashes.select(*[F.array_distinct(shingles(F.col(f"t{k}"))).alias(f"t{k}") for k in range(len(rows))]).first()
    return [(name, size_class(len(h)), list(h)) for (name, _), h in zip(rows, hashed)]


def _signature(window: Column) -> Column:
    """The least hash of the window under each band's hash function."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(window, lambda h: F.xxhash64(h, b))))


def _windows(starts: Column, w: int, width: int, hashes: list[int]) -> Column:
    """Array of (w, window) of the windows of ``h`` that hold one of the hashes."""
    held = F.filter(F.transform(starts, lambda s: F.slice("h", s + 1, width)), lambda x: F.exists(x, lambda h: h.isin(hashes)))
    return F.transform(held, lambda x: F.struct(F.lit(w).alias("w"), x.alias("window")))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text", id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """``id, license, containment`` for each row and license that is found in it."""
    found = None
    for part in _slices(templates or TEMPLATES):
        one = _found(docs, _templates(docs.sparkSession, part), text, id, least)
        found = one if found is None else found.union(one)
    return found.groupBy("id", "license").agg(F.max("containment").alias("containment")).withColumnRenamed("id", id)


def _found(docs: DataFrame, known: list[tuple[str, int, list[int]]], text: str, id: str, least: float) -> DataFrame:
    spark = docs.sparkSession
    every = sorted({h for *_, hs in known for h in hs})
    # explode() of a single value keeps the optimizer from writing the whole expression into every use of its result
    cut = docs.select(docs[id].alias("id"), F.explode(F.array(words(docs[text]))).alias("words"))
    cut = cut.select("id", F.explode(F.array(word_hashes(F.col("words")))).alias("words")).select("id", F.explode(F.array(shingles(F.col("words")))).alias("h"))
    near = cut.where(F.exists("h", lambda x: x.isin(every)))
    windows, bands = [], None
    for w in sorted({w for _, w, _ in known}):
        own = [(name, hs) for name, size, hs in known if size == w]
        step, width = window_shape(w)
        hashes = sorted({h for _, hs in own for h in hs})
        starts = F.sequence(F.lit(0), F.size("h") - 1, F.lit(step))
        windows.append(_windows(starts, w, width, hashes))
        literal = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*[F.lit(h).cast("long") for h in hs]).alias("template")) for name, hs in own])
        # the templates' bands: a table of BANDS rows for each template, whatever the corpus is
        one = spark.range(1).select(F.inline(literal)).select(F.lit(w).alias("w"), "license", "template", F.posexplode(_signature(F.col("template"))).alias("band", "least"))
        bands = one if bands is None else bands.union(one)
    parts = near.select("id", F.inline(F.concat(*windows))).select("id", "w", "window", F.posexplode(_signature(F.col("window"))).alias("band", "least"))
    met = parts.join(F.broadcast(bands), ["w", "band", "least"])
    share = F.size(F.array_intersect("template", "window")) / F.size("template")
    return met.select("id", "license", share.alias("containment")).where(F.col("containment") >= least)
