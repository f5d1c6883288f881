"""License scans by MinHash bands, in DataFrame functions only.

Texts and license templates are sets of 5-word shingles.  A text is read in
overlapping windows whose length and step follow the templates' length class,
so a passage as long as a template lies whole in one window.  The minima of
``bands`` hash functions over a window's shingles are its bands, and a
template with an equal band is retrieved.  The number of bands follows from
the least similarity that a window holding CONTAINMENT of a template can have,
so that it misses all bands with probability below MISS.  Retrieved templates
are verified by the exact containment of their shingles in the window.

A window without any template's shingle cannot agree with a template in a
minimum, so only windows around such shingles are hashed; nothing is lost.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, with_once

SHINGLE_WORDS = 5
#: Percent of a template's shingles that a window must hold.
CONTAINMENT = 75
#: Probability that a window which holds them shares no band.
MISS = 1e-6
#: Length classes of templates, in words, doubled further as far as longer
#: templates need; a window is 1.5 times as long and windows start every half
#: length.
CLASSES = (8, 16, 32, 64)

# Short passages by which licenses are commonly stated.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Proprietary", "No part of this publication may be reproduced without the prior written permission of the publisher"),
)


def window_words(length: int) -> int:
    return length + length // 2


def window_step(length: int) -> int:
    return length // 2


def least_similarity(length: int, containment: int = CONTAINMENT) -> float:
    """The least Jaccard similarity of a template of a class and a full window
    that holds ``containment`` percent of it."""
    shortest = 5 if length == CLASSES[0] else length // 2 + 1
    whole = window_words(length) - SHINGLE_WORDS + 1
    sizes = range(shortest - SHINGLE_WORDS + 1, length - SHINGLE_WORDS + 2)
    return min((need := math.ceil(containment * m / 100)) / (whole + m - need) for m in sizes)


def band_count(length: int, containment: int = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one minimum each, so that (1 - similarity) ** bands <= miss."""
    return math.ceil(math.log(miss) / math.log(1 - least_similarity(length, containment)))


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    spaced = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def _steps(last: Column) -> Column:
    """0 .. last, empty if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of the 5-word shingles, in order."""
    return F.transform(_steps(F.size(words) - SHINGLE_WORDS),
                       lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)]))


def shingle_texts(words: Column) -> Column:
    """The distinct 5-word shingles themselves."""
    return F.array_distinct(F.transform(_steps(F.size(words) - SHINGLE_WORDS),
                                        lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE_WORDS))))


def band_keys(hashes: Column, length: Column | int, bands: int) -> Column:
    """One key per band: the band's number and the minimum of its hash
    function over the shingles."""
    band = F.sequence(F.lit(1), F.lit(bands))
    return F.transform(band, lambda b: F.xxhash64(F.lit(length), b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))))


def length_classes(templates) -> tuple[int, ...]:
    """CLASSES, doubled as far as the longest template.

    A template without a shingle could not be found and raises."""
    sizes = [len(re.findall("[A-Za-z0-9]+", text)) for _, text in templates]
    if short := [i for i, n in enumerate(sizes) if n < SHINGLE_WORDS]:
        raise ValueError(f"templates of under {SHINGLE_WORDS} words: {short}")
    classes = list(CLASSES)
    while classes[-1] < max(sizes, default=0):
        classes.append(2 * classes[-1])
    return tuple(classes)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``(template, license, length, shingles, hashes)`` of the templates."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)],
                                 "template int, license string, text string")
    words = words_of(F.col("text"))
    length = F.lit(None).cast("int")
    for c in reversed(length_classes(templates)):
        length = F.when(F.size("words") <= c, F.lit(c)).otherwise(length)
    rows = rows.withColumn("words", words).withColumn("length", length)
    return rows.select(
        "template", "license", "length", shingle_texts(F.col("words")).alias("shingles"),
        shingle_hashes(F.col("words")).alias("hashes"))


def license_matches(docs: DataFrame, templates=TEMPLATES, containment: int = CONTAINMENT) -> DataFrame:
    """``doc_id, license, template, shared, template_shingles, first_word`` for
    each template of which a window of ``docs(doc_id, text)`` holds at least
    ``containment`` percent of the shingles.

    ``template`` is the place in ``templates`` (passages of 5 words or more;
    shorter ones raise),
    ``shared`` the shingles in the best window, ``first_word`` where the
    first such window starts.  Texts without a match, null or empty ones and
    those under five words give no rows; rows that repeat a doc_id count as
    one document; other columns are ignored.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    # the templates are a fixed list: a few hundred shingles and bands
    held = [(r.template, r.license, r.length, list(r.shingles), list(r.hashes)) for r in table.collect()]
    known = sorted({h for *_, hashes in held for h in hashes})
    read = with_once(docs.select("doc_id", "text"), words=words_of(F.col("text"))).drop("text")
    read = with_once(read, hashes=shingle_hashes(F.col("words")))
    at = F.filter(_steps(F.size("hashes") - 1), lambda i: F.get("hashes", i).isin(known))
    read = stored(with_once(read, at=at).where(F.size("at") > 0), "license-hits")
    found = None
    for length in sorted({h[2] for h in held}):
        own = [h for h in held if h[2] == length]
        part = _class_matches(read, own, length, band_count(length, containment), containment)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct(F.col("shared"), -F.col("first_word"))).alias("best")
    return (found.groupBy("doc_id", "license", "template", "template_shingles").agg(best)
            .select("doc_id", "license", "template", F.col("best.shared").alias("shared"), "template_shingles",
                    (-F.col("best.col2")).alias("first_word")))


def _class_matches(read: DataFrame, own: list, length: int, bands: int, containment: int) -> DataFrame:
    """Verified matches of one length class."""
    spark = read.sparkSession
    wide, step = window_words(length), window_step(length)
    whole = wide - SHINGLE_WORDS + 1
    mine = sorted({h for *_, hashes in own for h in hashes})
    places = F.filter("at", lambda i: F.get("hashes", i).isin(mine))
    starts = F.transform(places, lambda i: F.sequence(
        F.greatest(F.ceil((i - whole + 1) / step).cast("int"), F.lit(0)), F.floor(i / step).cast("int")))
    windows = (read.withColumn("k", F.explode(F.array_distinct(F.flatten(starts))))
               .select("doc_id", (F.col("k") * step).alias("first_word"), F.slice("words", F.col("k") * step + 1, wide).alias("window"),
                       F.array_distinct(F.slice("hashes", F.col("k") * step + 1, whole)).alias("hashes")))
    keys = spark.createDataFrame([(t, name, shingles, hashes) for t, name, _, shingles, hashes in own],
                                 "template int, license string, shingles array<string>, hashes array<long>")
    keys = keys.select("template", "license", "shingles", F.explode(band_keys(F.col("hashes"), length, bands)).alias("band"))
    held = [r.band for r in keys.select("band").distinct().collect()]  # bands times templates of the class
    windows = with_once(windows, bands=band_keys(F.col("hashes"), length, bands))
    met = (windows.withColumn("band", F.explode(F.filter("bands", lambda b: b.isin(held)))).drop("bands", "hashes").join(F.broadcast(keys), "band")
           .dropDuplicates(["doc_id", "first_word", "window", "template"]))
    shared = F.size(F.array_intersect("shingles", shingle_texts(F.col("window"))))
    return (with_once(met, shared=shared).withColumn("template_shingles", F.size("shingles"))
            .where(F.col("shared") * 100 >= F.col("template_shingles") * containment)
            .select("doc_id", "license", "template", "shared", "template_shingles", "first_word"))
