"""License scan: fixed phrases, and an exact set-similarity join of text blocks with templates.

A block is a line of a document, or a run of consecutive words across line ends as long as a template
and its share of foreign words, with every start covered, so wrapped lines and comment marks do not
matter. Blocks are taken as sets of words; a template is found in a block that holds at least
``CONTAINMENT`` of its words. Tokens are ordered by their frequency over the whole
corpus, rare ones first. A block that meets the threshold must hold one of the template's first
``size - needed + 1`` tokens (prefix filter), at least ``needed`` words (length filter) and, from the
first common token on, enough tokens on both sides (positional filter). All blocks that pass are
verified on their full sets. Only DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.llm.tokens import words
from stratafold.operators.lookup import lookup_join
from stratafold.session import stage

CONTAINMENT = 0.8

# fixed values: the phrases of the base rules and their labels
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# fixed values: well-known sentences of public licenses, by label
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "this program is licensed under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def needed(size: int) -> int:
    """Words of a template of ``size`` distinct words that a block must hold."""
    return math.ceil(CONTAINMENT * size - 1e-9)


def run_length(text: str) -> int:
    """Consecutive words in which a template is looked for across line ends."""
    return math.ceil(len(text.split()) / CONTAINMENT - 1e-9)


def _phrase_places() -> Column:
    """(start, label) of each place where the words of a phrase stand consecutively."""
    arrays = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        same = " AND ".join(f"get(w, i + {k}) = '{part}'" for k, part in enumerate(parts))
        present = " AND ".join(f"array_contains(w, '{part}')" for part in parts)
        arrays.append(
            f"IF({present} AND size(w) >= {len(parts)}, transform(filter(sequence(0, size(w) - {len(parts)}), i -> {same}), "
            f"i -> named_struct('start', i, 'label', '{label}')), CAST(array() AS array<struct<start: int, label: string>>))"
        )
    return F.expr(f"concat({', '.join(arrays)})")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=None) -> DataFrame:
    """One row per row of ``df``: its key, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels`` and ``score`` (1 for a phrase, else the largest containment found).

    A missing text counts as empty: no words, no labels, score 0. Rows that share key and text share
    their result and all stay; a missing key is a key. Only these two columns are read.
    """
    templates = TEMPLATES if templates is None else templates
    tokens = [(label, sorted(set(text_.split())), run_length(text_)) for label, text_ in templates]
    vocabulary = sorted({token for _, own, _ in tokens for token in own})
    full = F.coalesce(F.col("_text"), F.lit(""))
    rows = df.select(F.col(key), F.col(text).alias("_text"))
    split = rows.select(key, F.xxhash64("_text").alias("mark"), words(full).alias("w"))
    profiled = split.select(
        key, "mark", F.size("w").cast("bigint").alias("n_words"), _phrase_places().alias("places"),
        F.array_intersect("w", F.lit(vocabulary)).alias("known"),
    )
    profiled = stage(profiled, "license-profiles")
    ordered = _ordered(profiled, vocabulary)
    plans = [(n, label, [t for t in ordered if t in set(own)], run) for n, (label, own, run) in enumerate(tokens)]
    found = _similar_blocks(rows, profiled, key, plans)
    keys = {"_k": F.coalesce(F.col(key).cast("string"), F.lit("")), "_mark": F.col("mark")}
    joined = lookup_join(profiled, found, keys, population=profiled)
    starts, base = F.col("places.start"), F.array_distinct("places.label")
    method = F.coalesce("found_labels", F.array().cast("array<string>"))
    any_base = F.size("places") > 0
    return joined.select(
        key, "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, method)), ",").alias("labels"),
        F.when(any_base, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def _ordered(profiled: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens by document frequency, then by text; as many as the templates have."""
    counted = profiled.select(F.explode("known").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    frequency = {row["token"]: row["n"] for row in counted.collect()}
    return sorted(vocabulary, key=lambda token: (frequency.get(token, 0), token))


def _similar_blocks(rows: DataFrame, profiled: DataFrame, key: str, plans) -> DataFrame:
    """``_k``, ``_mark`` of the documents with a block that meets a threshold, the labels and the
    largest containment."""
    spark = rows.sparkSession
    prefixes = [(n, token, place) for n, _, own, _ in plans for place, token in enumerate(own[: len(own) - needed(len(own)) + 1])]
    first = sorted({token for _, token, _ in prefixes})
    lead = spark.createDataFrame(prefixes, "template int, token string, place int")
    sets = spark.createDataFrame(
        [(n, label, own, len(own), needed(len(own)), run) for n, label, own, run in plans],
        "template int, label string, own array<string>, size int, needed int, run int",
    )
    # no block of a document holds more of a template than the document
    possible = F.array_compact(F.array(*[
        F.when(F.size(F.array_intersect("known", F.lit(own))) >= needed(len(own)), n) for n, _, own, _ in plans
    ]))
    candidates = profiled.where(F.arrays_overlap("known", F.lit(first))).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.col("mark").alias("_mark"), possible.alias("_near")
    ).where(F.size("_near") > 0)
    candidates = stage(candidates.dropDuplicates(["_k", "_mark"]), "license-candidates")
    keys = {"_k": F.coalesce(F.col(key).cast("string"), F.lit("")), "_mark": F.xxhash64("_text")}
    near = lookup_join(rows, candidates, keys, population=rows, broadcast_bytes=32 << 20).where(F.col("_near").isNotNull())
    named = near.select(*[column.alias(name) for name, column in keys.items()], "_text", "_near").dropDuplicates(["_k", "_mark"])
    blocks = named.select("_k", "_mark", F.posexplode(F.split("_text", "\n")).alias("block", "line"))
    held = blocks.select("_k", "_mark", "block", F.array_distinct(words(F.col("line"))).alias("held"))
    wide = held.where(F.size("held") >= min(needed(len(own)) for _, _, own, _ in plans))
    met = wide.withColumn("token", F.explode_outer(F.array_intersect("held", F.lit(first)))).join(F.broadcast(lead), "token")
    earliest = met.groupBy("_k", "_mark", "block", "template").agg(F.min("place").alias("place"), F.first("held").alias("held"))
    paired = earliest.join(F.broadcast(sets), "template").where(
        (F.size("held") >= F.col("needed")) & (F.col("size") - F.col("place") >= F.col("needed"))
    )
    common = paired.withColumn("common", F.size(F.array_intersect("own", "held"))).where("common >= needed")
    either = common.select("_k", "_mark", "label", "common", "size").unionByName(_in_runs(named, sets))
    return either.groupBy("_k", "_mark").agg(
        F.collect_set("label").alias("found_labels"), F.max(F.col("common") / F.col("size")).alias("containment")
    )


def _in_runs(named: DataFrame, sets: DataFrame) -> DataFrame:
    """``_k``, ``_mark``, ``label``, ``common``, ``size`` of the templates met by a run of words.

    A run that meets the threshold can begin at a token of the template, so only these begin one.
    """
    paired = named.select("_k", "_mark", words(F.col("_text")).alias("w"), F.explode("_near").alias("template")).join(
        F.broadcast(sets), "template"
    )
    best = F.expr("""get(transform(
      array(filter(transform(w, (x, i) -> named_struct('i', i, 't', array_position(own, x))), p -> p.t > 0)),
      p -> aggregate(sequence(0, greatest(size(p) - 1, 0)), 0, (most, k) -> greatest(most,
        size(array_distinct(transform(filter(slice(p, k + 1, run), y -> y.i < get(p, k).i + run), y -> y.t)))))), 0)""")
    return paired.withColumn("common", best).where("common >= needed").select("_k", "_mark", "label", "common", "size")
