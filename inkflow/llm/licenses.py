"""License scans by an exact set-similarity join; SQL functions and DataFrames only.

Base: the places where the words of a short phrase (PHRASES) stand consecutively, whatever lies between them.

Method: a text's blocks (what blank lines part) and the license notices (TEMPLATES) are sets of words; a block has a
template's label if it holds at least `least` of the template's words.  Words that no template has cannot count, so a block
keeps only the others.  These are counted over all blocks and put into one order, the rarest first.  A block with enough of
a template's words holds one of the template's first |T| - a + 1 words, a being the least overlap: its prefix.  Blocks are
joined with templates on prefix words; the length filter wants a words in the block, the positional filter as many after
the first common word as are still needed, and only the row of the first common word goes on, so a pair is verified
once.

Only the templates, their words and these words' counts are held by the driver and broadcast, bounded by the given
templates and not by the corpus.  Rows are never gathered by word: a frequent word gives a row a block where it is a
prefix word, and no shuffle by it.

Nulls: a null text is empty; a null doc_id stays.  A text without words has no places and no labels.  Repeated
rows stay separate rows.  Very long texts: all steps are linear in the text, and a block's set is bounded by the templates'
words.  Templates that tie or overlap each give their label; labels are distinct.  A template without words is never found.
Other columns, of whatever name, are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import shared_dir, store, text_or_empty

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: License notices as their authors publish them, by label.
TEMPLATES = (
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, and an empty line, or one without words, which parts blocks.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EMPTY_LINE = r"\n[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*+\n"
#: The letters beyond ASCII whose lower case holds one of ASCII.
ODD = ("\u0130", "\u212a")


def template_words(text: str) -> set[str]:
    return {w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w}


def least_overlap(size: int, least: float) -> int:
    return math.ceil(least * size - 1e-9)


def lower_ascii(c: Column, looked_for: set[str]) -> Column:
    """A-Z in lower case.  Where only words of ASCII are looked for, the case of other letters tells nothing, and lower() is
    much faster than translate(); but it makes ASCII of the ODD ones."""
    if not all(w.isascii() for w in looked_for):
        return F.translate(c, UPPER, LOWER)
    return F.when(reduce(lambda a, b: a | b, [c.contains(x) for x in ODD]), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def base_places(low: Column, words: Column, n_words: Column, phrases=PHRASES) -> Column:
    """n_base, first_word, last_word and base, the labels, of a text.  In `spaced` every word has a blank of its own on both
    sides, so a phrase's words are whole words and phrases share no blank; only texts that hold all of a phrase's words need
    it."""
    able = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(w) for w in p.split()]) for p, _ in phrases])
    spaced = F.when(able, F.concat(F.lit(" "), F.array_join(F.flatten(words), "  "), F.lit(" "))).otherwise("")

    def found(s: Column) -> Column:
        count, first, last, labels = [], [], [], []
        for phrase, label in phrases:
            size = len(phrase.split())
            p = " " + "  ".join(phrase.split()) + " "
            there = s.contains(p)
            count.append(F.when(there, ((F.length(s) - F.length(F.replace(s, F.lit(p), F.lit("")))) / len(p)).cast("long")).otherwise(F.lit(0).cast("long")))
            first.append(F.when(there, (blanks(F.substring_index(s, p, 1)) / 2).cast("long")))
            last.append(F.when(there, n_words - (blanks(F.substring_index(s, p, -1)) / 2).cast("long") - size))
            labels.append(F.when(there, F.lit(label)))
        none = F.lit(None).cast("long")
        return F.struct(
            reduce(lambda a, b: a + b, count).alias("n_base"), F.least(*first, none).alias("first_word"), F.greatest(*last, none).alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
        )

    return F.get(F.transform(F.array(spaced), found), F.lit(0))


def scanned(docs: DataFrame, vocabulary: list[str], phrases=PHRASES) -> DataFrame:
    """doc_id, the base columns and blocks, (block, words) of each block with the different words of the vocabulary in it; one
    row per document.  Written, as rows are numbered by the task that reads them."""
    looked_for = {*vocabulary, *(w for p, _ in phrases for w in p.split())}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(text_or_empty(), looked_for).alias("low"))
    flat = F.transform(F.split("low", EMPTY_LINE), lambda b: F.trim(F.regexp_replace(b, BETWEEN, " ")))
    words = F.transform(F.filter(flat, lambda b: b != ""), lambda b: F.split(b, " "))
    rows = rows.select("doc_id", "low", words.alias("every"))
    n_words = F.aggregate("every", F.lit(0).cast("long"), lambda a, w: a + F.size(w))
    own = F.transform("every", lambda w, i: F.struct(i.alias("block"), F.array_distinct(F.filter(w, lambda x: x.isin(vocabulary))).alias("words")))
    rows = rows.select("doc_id", n_words.alias("n_words"), base_places(F.col("low"), F.col("every"), n_words, phrases).alias("b"), F.filter(own, lambda b: F.size(b["words"]) > 0).alias("blocks"))
    return store(rows.select("doc_id", "n_words", "b.*", "blocks").withColumn("row", F.monotonically_increasing_id()), shared_dir(docs.sparkSession, "license-blocks"))


def word_order(blocks: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of blocks that hold a word, then by word."""
    got = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # at most a row a word of the templates
    counts = {r.word: r.n for r in got}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_table(spark: SparkSession, templates: dict[int, tuple[str, set[str]]], order: list[str], least: float) -> DataFrame:
    """(word, at, template, label, need, given): the prefix words of every template and their places in the order."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for k, (label, words) in templates.items():
        given = sorted(words, key=rank.__getitem__)
        need = least_overlap(len(given), least)
        array = F.array(*map(F.lit, given))
        rows += [F.struct(F.lit(w).alias("word"), F.lit(i).alias("at"), F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(need).alias("need"), array.alias("given")) for i, w in enumerate(given[: len(given) - need + 1])]
    return spark.range(1).select(F.inline(F.array(*rows)))


def matches(blocks: DataFrame, templates: dict[int, tuple[str, set[str]]], vocabulary: list[str], least: float) -> DataFrame:
    """(row, block, template, label, containment) of every block (row, block, words) that holds enough of a template."""
    order = word_order(blocks, vocabulary)
    prefixes = prefix_table(blocks.sparkSession, templates, order, least)
    fewest = min(least_overlap(len(w), least) for _, w in templates.values())
    able = sorted({w for _, words in templates.values() for w in sorted(words, key=order.index)[: len(words) - least_overlap(len(words), least) + 1]})
    ordered = blocks.where(F.size("words") >= fewest).select("row", "block", F.array_intersect(F.array(*map(F.lit, order)), F.col("words")).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("j"))), lambda p: p["word"].isin(able))
    candidates = ordered.select("row", "block", "words", F.inline(places)).join(F.broadcast(prefixes), "word")
    left = F.least(F.size("given") - F.col("at"), F.size("words") - F.col("j"))
    passes = candidates.where((F.size("words") >= F.col("need")) & (left >= F.col("need")))
    is_first = F.size(F.array_intersect(F.slice("words", F.lit(1), F.col("j")), F.col("given"))) == 0
    both = passes.where(is_first).withColumn("both", F.size(F.array_intersect("given", "words"))).where(F.col("both") >= F.col("need"))
    return both.select("row", "block", "template", "label", (F.col("both") / F.size("given")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base place, else the largest
    containment found, else 0), templates (how many of its blocks and templates match) per document."""
    spark = docs.sparkSession
    sets = {k: (label, words) for k, (label, text) in enumerate(templates) if (words := template_words(text))}
    vocabulary = sorted(set().union(*(w for _, w in sets.values())))
    rows = scanned(docs, vocabulary or [""])
    kept = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")
    out = rows.select("row", *kept)
    if sets:
        found = matches(rows.select("row", F.inline("blocks")), sets, vocabulary, least)
        found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"), F.count("*").alias("templates"))  # a set of at most the templates' labels
        out = out.join(store(found, shared_dir(spark, "license-matches")), "row", "left")
    else:
        out = out.select("*", F.array().cast("array<string>").alias("more"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("templates"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        score.alias("score"), F.coalesce("templates", F.lit(0)).cast("long").alias("templates"),
    )
