"""Licence scans by diagonal voting, with DataFrame functions only.

All rolling word k-grams of a text are joined by hash (and, against collisions, by the words themselves) to the
positions of the same k-grams in the licence templates. A hit votes for the diagonal text position - template position;
votes are counted per diagonal, neighbouring diagonals (words inserted or left out) are merged, and what a merged span
covers of its template decides. The templates are the only broadcast side: as many rows as they have words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import CAPITALS, SMALL

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases with their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Opening passages of public licence texts.
PASSAGES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words(text):
    """Lower-cases A-Z and takes the words, as a column of arrays; null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def _grams(name: str, k: int) -> str:
    gram = ", ' ', ".join(f"{name}[i + {j}]" for j in range(k))
    return f"CASE WHEN size({name}) >= {k} THEN transform(sequence(0, size({name}) - {k}), i -> concat({gram})) ELSE CAST(array() AS array<string>) END"


def template_positions(spark: SparkSession, templates, k: int) -> DataFrame:
    """t_hash, t_gram, t_pos, template, label, base, t_grams: a row for each k-gram of each (label, text, base)."""
    rows = [(i, label, text, base) for i, (label, text, base) in enumerate(templates)]
    # each word is a row of its k-gram and label; a word's length counts k times
    size = sum((len(text) + 1) * k + len(text.split()) * (len(label) + 64) for _, label, text, _ in rows)
    if size > 32 << 20:
        raise ValueError(f"the templates' k-grams are broadcast, take {size} bytes and may have 32 MB at most")
    frame = spark.createDataFrame(rows, "template int, label string, body string, base boolean")
    frame = frame.withColumn("w", words(F.col("body"))).withColumn("grams", F.expr(_grams("w", k)))
    frame = frame.select("template", "label", "base", F.size("grams").alias("t_grams"), F.posexplode("grams").alias("t_pos", "t_gram"))
    return frame.withColumn("t_hash", F.xxhash64("t_gram"))


def license_scan(docs: DataFrame, phrases=PHRASES, passages=PASSAGES, k: int = 3, slack: int = 8, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row of docs.

    Phrases of k words at least count where they stand whole (one diagonal with all their votes). Passages count where
    diagonals at most `slack` apart cover `coverage` of their k-grams. spans: template label, first and last word, share covered.
    score is 1 with a whole phrase, else the best share that a passage covers. Null or empty text, and texts of fewer
    than k words, have no hits: zero counts, null positions, empty labels. Repeated rows are scanned each on its own. A phrase
    of fewer than k words is an error. No rows in, no rows out; other columns are not looked at.
    """
    if short := [text for _, text in phrases if len(text.split()) < k]:
        raise ValueError(f"phrases of fewer than {k} words: {short}")
    templates = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in passages]
    positions = template_positions(docs.sparkSession, templates, k)
    # ids of rows are made in the scan and used within one plan branch
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    rows = rows.select("row_id", "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(_grams("w", k)).alias("grams"))
    rolled = rows.select("row_id", "doc_id", "n_words", F.posexplode_outer("grams").alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    hits = rolled.join(F.broadcast(positions), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    # one row a text stays without a hit, so that every text reaches the result
    hits = hits.where("template IS NOT NULL OR pos IS NULL OR pos = 0").select("row_id", "doc_id", "n_words", "template", "label", "base", "t_grams", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    key = ["row_id", "doc_id", "n_words", "template", "label", "base", "t_grams"]
    votes = hits.repartition("row_id").groupBy(*key, "diagonal").agg(F.collect_set("t_pos").alias("seen"), F.min(F.col("diagonal") + F.col("t_pos")).alias("begin"), F.max(F.col("diagonal") + F.col("t_pos")).alias("end"))
    along = Window.partitionBy("row_id", "template").orderBy("diagonal")
    # base phrases stay on their own diagonal; passages join their neighbours
    fresh = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > slack), 1).otherwise(0)
    merged = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    merged = merged.groupBy(*key, "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"), F.min("begin").alias("begin"), (F.max("end") + k - 1).alias("end"))
    share = F.col("votes") / F.col("t_grams")
    whole = F.col("base") & (F.col("votes") == F.col("t_grams"))
    found = ~F.col("base") & (share >= coverage) & (F.col("end") - F.col("begin") + 1 <= (F.col("t_grams") + k - 1) * 2 + slack)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return merged.groupBy("row_id", "doc_id", "n_words").agg(
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("begin"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("begin"))).cast("long").alias("last_word"),
        joined(F.when(whole, F.col("label"))).alias("base_labels"),
        joined(F.when(whole | found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(whole, F.lit(1.0)).when(~F.col("base"), F.least(share, F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(whole | found, F.struct(F.col("begin").alias("first"), F.col("end").alias("last"), "label", F.round(share, 4).alias("share"))))).alias("spans"),
    ).drop("row_id")
