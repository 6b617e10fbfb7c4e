"""License notices in texts by MinHash bands over overlapping windows. DataFrame functions only.

Texts and templates are lower-cased, punctuation becomes blanks, and both are taken as sequences of five-word shingles. A template with s
shingles is sought in windows of s + d shingles that begin every d = ceil(s / 4) shingles, so that some window holds the whole of any occurrence.
An occurrence that shares 80 percent of the template's shingles then has a Jaccard similarity of at least 0.8 / (1.25 + 1 - 0.8) = 0.55 with that
window (s = 1: 0.5), and with ``BANDS`` bands of one row it collides with a probability of at least 1 - 0.5 ** 16, more than 0.99998. A
band's value is the shingle hash that is smallest after an exclusive-or with the band's constant.

A window can only collide if it contains one of the templates' band values, so windows without such a shingle are not worked out; that leaves
out no collision. Colliding windows are verified by exact containment: the share of the template's shingles, as strings, that the window has.

Defined results: a null text counts as empty; texts without a verified window give no row; a row is given per text and template, with its best
window (the first of equals); repeated rows have rows of their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wareloom.functions.text import let
from wareloom.llm.tables import Scratch, field, whole_text

SHINGLE = 5
BANDS = 16
LEAST = 0.8
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|/\\_=+~`^@\t\n\x0b\f\r"
#: Names and texts of common notices; fixed values.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "MIT": ("Released under the MIT License.",),
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

#: Band constants: odd multiples of the golden ratio's 64-bit fraction.
SALTS = tuple(((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63) for k in range(BANDS))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION)), " "), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    return text.lower().translate(str.maketrans(PUNCTUATION, " " * len(PUNCTUATION))).split(" ")


def shingle_at(words: Column, i: Column) -> Column:
    return F.array_join(F.slice(words, i + 1, SHINGLE), " ")


def templates(spark: SparkSession, texts: dict[str, tuple[str, ...]]) -> DataFrame:
    """license, variant, shingles (distinct), s, stride and band values; one row per notice text."""
    rows = []
    for name, variants in texts.items():
        for text in variants:
            words = [w for w in plain_words(text) if w]
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            shingles = list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))
            rows.append((name, len(rows), shingles, len(shingles), -(-len(shingles) // 4)))
    base = spark.createDataFrame(rows, "license string, variant int, shingles array<string>, s int, stride int")
    hashes = F.transform("shingles", lambda x: F.xxhash64(x))
    return base.withColumn("bands", signature(hashes))


def signature(hashes: Column) -> Column:
    """The shingle hash that wins each band."""
    def winner(salt: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(salt)))).bitwiseXOR(F.lit(salt))

    return F.array(*[winner(s) for s in SALTS])


def verified_windows(docs: DataFrame, texts: dict[str, tuple[str, ...]], least: float) -> DataFrame:
    """row, doc_id, license, first_word, n_words, containment and the number of shared shingles of each verified window."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    known = scratch.keep(templates(spark, texts).coalesce(1))
    of_shape: dict[tuple[int, int], set[int]] = {}
    for r in known.select("s", "stride", "bands").collect():  # the templates are parameters
        of_shape.setdefault((r.s, r.stride), set()).update(r.bands)
    values = sorted(set().union(*of_shape.values()))

    def hits_in(words: Column) -> Column:
        count = F.size(words) - (SHINGLE - 1)
        hit = lambda i: F.xxhash64(shingle_at(words, i)).isin(values)
        return F.when(count > 0, F.filter(F.sequence(F.lit(0), count - 1), hit))

    rows = docs.select(field("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    hit = rows.withColumn("hits", let(words_of(F.col("text")), hits_in)).filter(F.size("hits") > 0)
    suspects = scratch.keep(hit.select("doc_id", "hits", words_of(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("row")))

    # Windows of each shape that hold a hit of a template of that shape.
    def windows(s: int, stride: int) -> Column:
        own = F.filter("hits", lambda i: F.xxhash64(shingle_at(F.col("words"), i)).isin(sorted(of_shape[s, stride])))
        around = F.transform(own, lambda i: F.sequence(F.greatest(F.lit(0), F.floor((i - (s + stride) + stride) / stride)).cast("int"), F.floor(i / stride).cast("int")))
        return F.transform(F.array_distinct(F.flatten(around)), lambda k: F.struct(F.lit(s).alias("s"), F.lit(stride).alias("stride"), (k * stride).alias("first_word")))

    begin = F.explode(F.concat(*[windows(s, d) for s, d in sorted(of_shape)])).alias("z")
    all_windows = suspects.select("row", "doc_id", "words", begin).select(
        "row", "doc_id", "z.s", "z.first_word", F.expr(f"slice(words, z.first_word + 1, z.s + z.stride + {SHINGLE - 1})").alias("window"))
    window_starts = F.sequence(F.lit(0), F.greatest(F.size("window") - SHINGLE, F.lit(0)))
    cut = all_windows.filter(F.size("window") >= SHINGLE).withColumn("found", F.transform(window_starts, lambda i: shingle_at(F.col("window"), i)))
    signed = scratch.keep(cut.withColumn("bands", signature(F.transform("found", lambda x: F.xxhash64(x)))))
    side = known.select("license", "variant", F.col("s").alias("ts"), F.posexplode("bands").alias("band", "value"))
    banded = signed.select("row", "doc_id", "s", "first_word", "found", F.posexplode("bands").alias("band", "value"))
    # The template side is a parameter of bounded size.
    candidates = banded.join(F.broadcast(side), (F.col("s") == F.col("ts")) & (banded["band"] == side["band"]) & (banded["value"] == side["value"]))
    shared = F.size(F.array_intersect("shingles", "found"))
    counted = candidates.join(F.broadcast(known.select("variant", "shingles")), "variant").select(
        "row", "doc_id", "license", "first_word", (F.size("found") + SHINGLE - 1).alias("n_words"), shared.alias("shared"), (shared / F.size("shingles")).alias("containment"))
    return counted.filter(F.col("containment") >= least).distinct().withColumn("n_windows", F.count("*").over(Window.partitionBy("row", "license")))


def scan(docs: DataFrame, texts: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment, first_word and n_words of the best window, and the number of verified windows."""
    best = Window.partitionBy("row", "license").orderBy(F.col("containment").desc(), "first_word", "n_words")
    return (verified_windows(docs, texts, least).withColumn("_rank", F.row_number().over(best))
            .filter("_rank = 1").select("doc_id", "license", "containment", "first_word", "n_words", "n_windows"))


def named(docs: DataFrame, texts: dict[str, tuple[str, ...]], family: dict[str, str], least: float = LEAST) -> DataFrame:
    """As :func:`scan`, for wordings named ``license|number``: one row per text and license, with its best wording.

    Where windows of one family run into each other, an incomplete match gives way to one that shares more shingles: a notice of one
    version is no notice of another that differs in a word.
    """
    of = F.create_map(*[F.lit(x) for pair in family.items() for x in pair])
    seen = verified_windows(docs, texts, least).withColumnRenamed("license", "wording").withColumn("license", F.substring_index("wording", "|", 1)).withColumn("family", of[F.col("license")])
    in_order = Window.partitionBy("row", "family").orderBy("first_word", "n_words")
    reached = F.max(F.col("first_word") + F.col("n_words")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = seen.withColumn("_new", (F.coalesce(reached, F.lit(0)) <= F.col("first_word")).cast("int"))
    runs = begins.withColumn("_run", F.sum("_new").over(in_order)).withColumn("_most", F.max("shared").over(Window.partitionBy("row", "family", "_run")))
    best = Window.partitionBy("row", "license").orderBy(F.col("containment").desc(), F.col("shared").desc(), "first_word", "n_words", "wording")
    return (runs.filter("containment = 1 OR shared = _most").withColumn("_rank", F.row_number().over(best))
            .filter("_rank = 1").select("doc_id", "license", "containment", "first_word", "n_words", "n_windows"))
