"""Licence scan: word-bigram Dice coefficient against licence templates.

Every line of a text, and the text as a whole, is a passage. Passages and templates are
normalised (A-Z to a-z, everything but a-z and 0-9 separates words) and reduced to their sets
of word bigrams. Dice = 2 common / (passage + template); at a threshold t only templates of
t / (2 - t) to (2 - t) / t times the passage's size can reach it. Passages outside the bounds
of all templates are dropped before their bigrams are built, and so are those with too many
different words that no template has: all but the first stand second in a bigram of their own
that cannot be common, and at most a share (2 - 2 t) / (2 - t) of a passage's bigrams may not be
common. The rest meet the templates through an inverted index of the template bigrams. Texts
without any of a few words of the templates, one of which every match must hold, are not
split at all. Only DataFrame operations run.

Cases: NULL and empty texts, and passages of fewer than two words, match nothing; a text of
one line is reported once, as a line; repeated rows are scanned one by one; equal scores go
to the template first in name order; other columns are ignored; an empty table or an empty
template list gives an empty result.
"""
from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from .common import prepared

THRESHOLD = 0.8
MAX_TEMPLATES = 5_000
WHOLE = -1  # line number of the passage that is the whole text

# Short notices by which works are put under well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)


def plain(text: Column) -> Column:
    """The text with runs of other characters than A-Z, a-z, 0-9 and line ends as blanks, in lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9\n]+", " "))


def words(line: Column) -> Column:
    """Words of a plain line; an empty line gives one empty word."""
    return F.split(F.trim(line), " ")


def bigrams(of: Column) -> Column:
    """The set of neighbouring word pairs."""
    pairs = F.zip_with(F.slice(of, F.lit(1), F.size(of) - 1), F.slice(of, F.lit(2), F.size(of)),
                       lambda x, y: F.concat_ws(" ", x, y))
    return F.when(F.size(of) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def probe_words(bodies: list[list[str]], threshold: float) -> list[str]:
    """Words one of which is in every passage that matches a template of these words.

    A match has at least m t / (2 - t) of a template's m bigrams, so one of any m - that + 1
    of them; long words are taken until they stand in so many bigrams.
    """
    chosen: list[str] = []
    for body in bodies:
        grams = set(zip(body, body[1:]))
        need = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9) + 1
        for word in sorted(set(body), key=lambda w: (w not in chosen, -len(w), w)):
            if need <= 0:
                break
            covered = {g for g in grams if word in g}
            grams -= covered
            need -= len(covered)
            if covered and word not in chosen:
                chosen.append(word)
    return chosen


def passages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, __row, line (``WHOLE`` for the whole text), words.

    Lines are normalised once; the whole text's words are those of its lines.
    """
    lines = F.transform(F.split(plain(F.coalesce(F.col(text), F.lit(""))), "\n"), words)

    def units(lines: Column) -> Column:
        own = F.transform(lines, lambda w, n: F.struct(n.alias("line"), w.alias("words")))
        whole = F.struct(F.lit(WHOLE).alias("line"), F.array_remove(F.flatten(lines), "").alias("words"))
        return F.when(F.size(lines) > 1, F.concat(own, F.array(whole))).otherwise(own)
    return docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("__row"),
                       F.inline(let(lines, units)))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, key: str = "doc_id",
                  text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, line (-1: the whole text), license, dice: the best template of every matching passage."""
    spark = prepared(docs.sparkSession)
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    rows = [(str(name), str(body)) for name, body in templates] or [("", "")]
    known = (spark.createDataFrame(rows, "license string, body string").coalesce(1)
             .select("license", "body", words(plain(F.col("body"))).alias("words"))
             .select("license", "body", "words", bigrams(F.col("words")).alias("bigrams"))
             .where(F.size("bigrams") > 0).withColumn("template_size", F.size("bigrams")))
    least, most, bodies = known.agg(
        F.min("template_size"), F.max("template_size"), F.collect_list("words")).first()  # at most MAX_TEMPLATES notices
    vocabulary = sorted({w for body in bodies for w in body})
    lowered = F.lower(text)
    probed = functools.reduce(lambda a, b: a | b, (lowered.contains(w) for w in probe_words(bodies, threshold)), F.lit(False))
    low, high = (least * threshold / (2 - threshold), most * (2 - threshold) / threshold) if least else (1, 0)
    foreign = F.size(F.array_except("words", F.array(*map(F.lit, vocabulary)).cast("array<string>")))
    may_differ = F.least(F.size("words") - 1, F.lit(high)) * ((2 - 2 * threshold) / (2 - threshold))
    index = known.select("license", "body", "template_size", F.explode("bigrams").alias("bigram"))
    sized = (passages(docs.where(probed), key, text)
             .where((F.size("words") - 1 >= low) & (foreign - 1 <= may_differ + 1e-9))
             .select("key", "__row", "line", bigrams(F.col("words")).alias("bigrams"))
             .withColumn("size", F.size("bigrams")).where(F.col("size").between(low, high)))
    spread = sized.select("key", "__row", "line", "size", F.explode("bigrams").alias("bigram"))
    bounds = F.expr(f"template_size >= size * {threshold / (2 - threshold)!r}D AND template_size <= size * {(2 - threshold) / threshold!r}D")
    common = (spread.join(F.broadcast(index), "bigram").where(bounds)  # at most MAX_TEMPLATES short notices
              .groupBy("key", "__row", "line", "size", "license", "body", "template_size").agg(F.count(F.lit(1)).alias("common")))
    scored = common.withColumn("dice", 2 * F.col("common") / (F.col("size") + F.col("template_size"))).where(F.col("dice") >= threshold)
    best = scored.groupBy("key", "__row", "line").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), F.col("license"))).alias("best"))
    return best.select(F.col("key").alias(key), "line", "best.license", (-F.col("best.d")).alias("dice"))
