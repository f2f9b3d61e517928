"""License scans by diagonal voting.

Every rolling pair of words of a text is joined by hash with the places where templates have it; a
template of three words or more asks for the third word too. A match at word p of the text and t of
the template votes for diagonal p - t. Votes are added up by diagonal, neighbouring diagonals (a word
more or less) merged, and a span holds if it covers enough of the template within about its length.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases of the base count, by label.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Notices and openings of licenses, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
#: Least share of a template's places, widest gap between merged diagonals, most length against the template's.
COVERED, GAP, STRETCH = 0.7, 2, 1.5
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null for none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    trimmed = F.regexp_replace(F.regexp_replace(lowered, "^" + _BREAKS, ""), _BREAKS + "$", "")
    return F.when(trimmed != "", F.split(trimmed, _BREAKS))


def template_places(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """A row for each place of each template: its label, words there, the number of places, whether of the base."""
    rows = []
    for number, (label, text) in enumerate((*phrases, *templates)):
        own, base = text.split(), number < len(phrases)
        k = 2 if len(own) == 2 or base else 3
        for t in range(len(own) - k + 1):
            rows.append((number, label, base, t, own[t], own[t + 1], own[t + 2] if k == 3 else None, len(own) - k + 1, len(own)))
    places = spark.createDataFrame(rows, "template int, label string, base boolean, t int, w1 string, w2 string, w3 string, places int, length int")
    return places.withColumn("hash", F.xxhash64("w1", "w2"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    The score is the largest share of a phrase or template that any span covers. Null and empty texts
    have no words and score 0. Rows of equal id and text get the same result, a row each; a null
    doc_id stays null. Other columns are ignored. Templates are a fixed list, so they are broadcast.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("same"), words(F.col("text")).alias("words"))
    at = texts.where("words is not null").select("doc_id", "same", "words", F.posexplode("words").alias("p", "w1"))
    grams = at.withColumn("w2", F.get("words", F.col("p") + 1)).where("w2 is not null").withColumn("hash", F.xxhash64("w1", "w2"))
    places = F.broadcast(template_places(docs.sparkSession, phrases, templates).alias("m"))
    third = F.col("m.w3").isNull() | (F.get("words", F.col("p") + 2) == F.col("m.w3"))
    found = grams.alias("g").join(places, (F.col("g.hash") == F.col("m.hash")) & (F.col("g.w1") == F.col("m.w1")) & (F.col("g.w2") == F.col("m.w2")) & third)
    votes = found.select("doc_id", "same", "template", "label", "base", "t", "p", "places", "length", (F.col("p") - F.col("t")).alias("diagonal"))

    key = ["doc_id", "same", "template", "label", "base", "places", "length"]
    diagonals = votes.groupBy(*key, "diagonal").agg(F.collect_set("t").alias("seen"), F.min("p").alias("from"), F.max("p").alias("to"))
    order = Window.partitionBy("doc_id", "same", "template").orderBy("diagonal")
    # a phrase of the base stands on one diagonal; other templates' diagonals merge across small gaps
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > GAP) | F.col("base"), F.lit(True))
    merged = diagonals.withColumn("span", F.sum(opens.cast("int")).over(order)).groupBy(*key, "span")
    spans = merged.agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"), F.min("from").alias("from"), F.max("to").alias("to"), F.min("diagonal").alias("start"))
    spans = spans.withColumn("share", F.col("n") / F.col("places")).withColumn("near", F.col("to") - F.col("from") + 1 <= STRETCH * F.col("length"))
    whole = F.col("base") & (F.col("n") == F.col("places"))
    holds = ~F.col("base") & F.col("near") & (F.col("share") >= COVERED)
    shares = F.when(F.col("base") | F.col("near"), F.col("share")).otherwise(0.0)

    told = spans.groupBy("doc_id", "same").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).alias("first_word"),
        F.max(F.when(whole, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(whole, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(whole | holds, F.col("label")))).alias("labels"),
        F.max(shares).alias("score"),
        F.array_sort(F.collect_list(F.when(whole | holds, F.struct("from", F.col("to"), "label")))).alias("spans"),
    )
    counts = texts.select("doc_id", "same", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words")).alias("d")
    told = told.alias("f")
    joined = counts.join(told, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.same") == F.col("f.same")), "left")
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ",").alias(c)
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), listed("base_labels"), listed("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
