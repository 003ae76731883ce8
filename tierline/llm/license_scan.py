"""License scans: an exact set-similarity join of text blocks and templates.

Blocks are the lines of a text.  A template is found in a block when the block
holds at least ``THRESHOLD`` of the template's distinct words.  Words of the
templates get one global order, rarest in the corpus first.  With ``need`` =
ceil(THRESHOLD x size): a template and a block that qualify share a word among
the template's first ``size - need + 1`` words and among the block's first
``its template words - need + 1`` (prefix filter); a block with fewer than
``need`` template words is out (length filter); with a shared word at positions
i and j at most ``min(i, j) + 1 + min(rest of template, rest of block)`` words
are common (positional filter).  Pairs that pass are verified by the whole intersection.
All steps are DataFrame operations; templates are a fixed short list, the only
side that is broadcast.

Phrases are found beside it: places where a phrase's words stand one after the
other.  Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z
become lower case.  (``lower`` also changes letters beyond ASCII; none of them
becomes a letter of a phrase, and none is a separator before or after.)

Defined results: a null text is the empty text: no words, no labels, score 0.
Repeated texts give equal results.  Texts and lines of any length are read
whole.  The score is the largest containment found, 1 where a phrase stands.
Other columns pass through; result columns replace columns of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License notices and their labels.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the software without restriction", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
)


def words(text: Column) -> Column:
    """The words of a text in order; the first and last element may be empty."""
    return F.split(F.lower(text), SEPARATORS)


def _template_words(text: str) -> list[str]:
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(out))


def _need(size: int, threshold: float) -> int:
    return math.ceil(round(threshold * size, 9))


def frequencies(texts: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Documents that hold each template word, over all of ``texts`` (w)."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    got = (texts.select(F.explode(F.array_intersect("w", known)).alias("word"))
           .groupBy("word").count().collect())          # at most one row a template word
    return {r["word"]: r["count"] for r in got}


def template_matches(texts: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                     threshold: float = THRESHOLD) -> DataFrame:
    """``texts`` (key, t) joined with ``templates``: key, template, label,
    containment, one row per key and template with the largest containment."""
    spark = texts.sparkSession
    sets = [_template_words(t) for t, _ in templates]
    vocabulary = sorted({w for s in sets for w in s})
    count = frequencies(texts.select(words(F.col("t")).alias("w")), vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    ranked = [sorted(order[w] for w in s) for s in sets]
    index = spark.createDataFrame(
        [(n, rank, i, len(r), _need(len(r), threshold), r, templates[n][1])
         for n, r in enumerate(ranked) for i, rank in enumerate(r[:len(r) - _need(len(r), threshold) + 1])],
        "template int, rank int, i int, size int, need int, ranks array<int>, label string")
    starts = sorted({r for s in ranked for r in s[:len(s) - _need(len(s), threshold) + 1]})
    inverse = {i: w for w, i in order.items()}
    least = min(_need(len(r), threshold) for r in ranked)

    rank_of = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    known = F.array(*[F.lit(w) for w in vocabulary])
    prefix_words = F.array(*[F.lit(inverse[r]) for r in starts])
    blocks = (texts.where(F.arrays_overlap(words(F.col("t")), prefix_words))
              .select("key", F.posexplode(F.split("t", "\n")).alias("line", "block"))
              .select("key", "line", F.array_intersect(words(F.col("block")), known).alias("own"))
              .where(F.size("own") >= least)
              .select("key", "line", F.array_sort(F.transform("own", lambda w: rank_of[w])).alias("own")))
    probes = blocks.select("key", "line", "own", F.posexplode("own").alias("j", "rank"))
    held = F.size("own")
    pairs = (probes.join(F.broadcast(index), "rank")
             .where((held >= F.col("need"))
                    & (F.col("j") <= held - F.col("need"))
                    & (F.least("i", "j") + 1 + F.least(F.col("size") - F.col("i"), held - F.col("j")) - 1 >= F.col("need"))))
    common = F.size(F.array_intersect("own", "ranks"))
    return (pairs.withColumn("common", common).where(F.col("common") >= F.col("need"))
            .groupBy("key", "template", "label").agg(F.max(F.col("common") / F.col("size")).alias("containment")))


def _places(phrase: str, w: Column) -> Column:
    """Indexes in ``w`` where the phrase's words start."""
    first, *rest = phrase.split(" ")

    def here(word, i):
        test = word == first
        for k, other in enumerate(rest, 1):
            test = test & F.coalesce(F.get(w, i + k) == other, F.lit(False))
        return F.when(test, i)

    return F.filter(F.transform(w, here), lambda i: i.isNotNull())


def scan(df: DataFrame, text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES,
         templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels
    and score.  Labels depend on the text alone, so equal texts share a row of
    the template join."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(t)
    matched = (template_matches(df.select(key.alias("key"), t.alias("t")), templates, threshold)
               .groupBy("key").agg(F.collect_set("label").alias("__found"), F.max("containment").alias("__part")))
    w = F.col("__w")
    lead = F.when(w[0] == "", 1).otherwise(0)
    tail = F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    base = df.withColumns({"__key": key, "__w": words(t)})
    columns = {"n_words": (F.size(w) - lead - tail).cast("long")}
    for n, (phrase, _) in enumerate(phrases):
        holds = F.array_contains(w, phrase.split(" ")[-1]) & F.array_contains(w, phrase.split(" ")[0])
        columns[f"__at{n}"] = F.when(holds, _places(phrase, w)).otherwise(F.array().cast("array<int>"))
    columns["__lead"] = lead
    base = base.withColumns(columns).drop("__w")
    places = F.concat(*[F.col(f"__at{n}") for n in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"__at{n}") > 0, F.lit(label))
                                       for n, (_, label) in enumerate(phrases)]))
    base = (base.withColumns({"__places": places, "__labels": F.array_sort(F.array_distinct(labels))})
            .drop(*[f"__at{n}" for n in range(len(phrases))]))
    both = base.join(matched.withColumnRenamed("key", "__key"), "__key", "left")
    found = F.coalesce("__found", F.array().cast("array<string>"))
    return both.withColumns({
        "n_base": F.size("__places").cast("long"),
        "first_word": (F.array_min("__places") - F.col("__lead")).cast("long"),
        "last_word": (F.array_max("__places") - F.col("__lead")).cast("long"),
        "base_labels": F.array_join("__labels", ","),
        "labels": F.array_join(F.array_sort(F.array_union("__labels", found)), ","),
        "score": F.when(F.size("__places") > 0, 1.0).otherwise(F.coalesce("__part", F.lit(0.0))),
    }).drop("__key", "__places", "__labels", "__lead", "__found", "__part")
