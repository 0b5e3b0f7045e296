"""License notices: an exact join of text blocks with templates by token containment.

A block is a run of up to four neighbouring lines, so that a notice is found however it is wrapped. A longer
block holds all that a shorter one inside it holds, so only the longest ones are compared. A block matches a template when it holds at least ``threshold`` of the
template's distinct tokens. Tokens are ordered by how many documents hold them, rarest first. A
block that reaches the threshold must hold one of the first ``n - needed + 1`` tokens of the
template, so only blocks with such a token are compared. The templates are a fixed list; the few
statistics about their tokens are all that the driver receives.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywell.llm.columns import document_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
THRESHOLD = 0.8
#: Lines of a block.
LINES = 4


def tokens(text: Column) -> Column:
    """Lower-cased words; only A-Z change case, and any character beyond ASCII belongs to a word."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")


def _template_rows(spark: SparkSession, templates, threshold: float, frequency: dict[str, int]) -> DataFrame:
    """A row for each token of a template's prefix, with its place and the whole token set."""
    rows = []
    for number, (label, words) in enumerate(templates):
        ordered = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        needed = ceil(threshold * len(ordered) - 1e-9)
        rows += [(number, label, ordered, needed, place, ordered[place]) for place in range(len(ordered) - needed + 1)]
    return spark.createDataFrame(
        rows, "template int, label string, wanted array<string>, needed int, place int, token string")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, lines: int = LINES) -> DataFrame:
    """One row per input row: the places of the phrases, the labels, and the best containment.

    Null and empty texts have no words and no labels. Repeated rows each get the result. Ties
    between templates do not matter, as all labels are kept. Long texts are taken whole, a block at a time;
    an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sets = [(label, _plain_tokens(words)) for label, words in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    # lower() also maps two signs beyond ASCII to a letter; what it finds too much is tested again below
    found = docs.select(F.col("doc_id"), text.alias("text"), F.split(F.lower(text), BETWEEN).alias("words"))
    counts = (found.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("token"))
              .groupBy("token").count().collect())
    frequency = {row["token"]: row["count"] for row in counts}
    prefix = _template_rows(spark, sets, threshold, frequency)
    rare = [row["token"] for row in prefix.select("token").distinct().collect()]

    starts = [_starts(F.col("words"), phrase.split()) for _, phrase in phrases]
    maybe = F.arrays_overlap("words", F.lit(rare))
    last_words = sorted({phrase.split()[-1] for _, phrase in phrases})
    found = found.select(
        "doc_id", "text", F.filter("words", lambda w: w != "").alias("words"), maybe.alias("maybe"))
    # a phrase can only stand where its last word occurs
    spelt = F.when(F.arrays_overlap("words", F.lit(last_words)), tokens(F.col("text")))
    found = found.select("doc_id", "text", F.size("words").cast("bigint").alias("n_words"), "maybe", spelt.alias("words"))
    base = found.select(
        F.when(F.col("maybe"), document_key(F.col("doc_id"), F.col("text")))
        .otherwise(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        "doc_id", "n_words", *(s.alias(f"s{i}") for i, s in enumerate(starts)))
    everywhere = F.flatten(F.array(*(F.coalesce(F.col(f"s{i}"), F.array().cast("array<int>")) for i in range(len(phrases)))))
    base = base.select(
        "key", "doc_id", "n_words", F.size(everywhere).cast("bigint").alias("n_base"),
        F.array_min(everywhere).cast("bigint").alias("first_word"),
        F.array_max(everywhere).cast("bigint").alias("last_word"),
        F.filter(F.array(*(F.when(F.size(f"s{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(phrases))),
                 lambda x: x.isNotNull()).alias("base"))

    # a block's tokens in the templates' order; tokens of no template cannot count towards any
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    of_lines = F.transform(F.split("text", "\n"), lambda line: F.array_intersect(F.lit(order), tokens(line)))
    blocks = found.where("maybe").select(document_key(F.col("doc_id"), F.col("text")).alias("key"), of_lines.alias("lines"))
    starts_of = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("lines") - (lines - 1)))
    blocks = blocks.select("key", "lines", F.explode(starts_of).alias("first"))
    held = blocks.select("key", F.array_intersect(F.lit(order), F.flatten(F.expr(f"slice(lines, first, {lines})"))).alias("held"))
    held = held.select("key", "held", F.posexplode("held").alias("at", "token"))
    # around a shared token, no more than the shorter side can be shared before it and after it
    most = (F.least("at", "place") + 1
            + F.least(F.size("held") - F.col("at") - 1, F.size("wanted") - F.col("place") - 1))
    pairs = (held.join(F.broadcast(prefix), "token")
             .where((F.size("held") >= F.col("needed")) & (most >= F.col("needed")))
             .withColumn("common", F.size(F.array_intersect("held", "wanted"))).where("common >= needed"))
    hits = pairs.groupBy("key").agg(
        F.collect_set("label").alias("more"), F.max(F.col("common") / F.size("wanted")).alias("best"))
    none = F.array().cast("array<string>")
    more = F.coalesce(F.col("more"), none)
    return base.join(hits, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _starts(words: Column, phrase: list[str]) -> Column:
    """Places where the phrase stands, null where its words were not even looked up."""
    def here(w: Column, i: Column) -> Column:
        test = w == phrase[0]
        for further, word in enumerate(phrase[1:], 1):
            test = test & F.coalesce(F.get(words, i + further) == word, F.lit(False))
        return test

    marked = F.transform(words, lambda w, i: F.when(here(w, i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _plain_tokens(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()
