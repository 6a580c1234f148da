"""License scan by diagonal voting (DataFrame functions only).

Every rolling word 3-gram of a text is hashed and joined to the positions at which license templates hold that gram.  Hits
that stand on one diagonal (position in the text minus position in the template) vote together; neighbouring diagonals, as
left by inserted or lost words, are merged; the span is kept when its grams, compared as text and not only as hashes, cover
enough of the template.  The templates are a short fixed list, so the side that is broadcast never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_latin, named, row_key
from .ranks import copied

GRAM = 3
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The phrases whose places are counted exactly.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Texts that the licenses themselves prescribe.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Diagonals at most so far apart are one span; a span needs this share of the template's grams.
NEAR, COVERED = 4, 0.5


def templates(spark, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """One row per template position: gram hash, template number, position, label, grams in all, exact or voted."""
    if short := [text for _, text in [*phrases, *texts] if text.count(" ") < GRAM - 1]:
        raise ValueError(f"a template needs {GRAM} words or more: {short[0]!r}")
    rows = [(k, label, exact, text.split(" ")) for k, (label, text, exact) in enumerate([(a, t, True) for a, t in phrases] + [(a, t, False) for a, t in texts])]
    t = spark.createDataFrame(rows, "tpl int, label string, exact boolean, words array<string>").withColumn("tpos", F.explode(F.expr(f"sequence(0, size(words) - {GRAM})")))
    return t.select(
        F.expr("xxhash64(words[tpos], words[tpos + 1], words[tpos + 2])").alias("gram"),
        F.expr(f"concat_ws(' ', slice(words, tpos + 1, {GRAM}))").alias("gram_text"),
        "tpl", "tpos", "label", "exact", F.expr(f"size(words) - {GRAM - 1}").alias("grams"),
    )


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """Verified spans, and a row with null label for every document.

    Columns: row (its row_key), n_words, copies (input rows of that key), label, exact, start, end (words, end excluded), score
    (share of the template's grams).  A null text has no words; a text under three words has no grams.  Rows that share a
    doc_id, or have none, are told apart by their texts.
    """
    t = templates(docs.sparkSession, phrases, texts)
    mark = docs.sparkSession.createDataFrame([(0, "", -1, 0, None, False, 1)], "gram long, gram_text string, tpl int, tpos int, label string, exact boolean, grams int")
    words = docs.select(row_key(id_col, text_col).alias("row"), F.array_remove(F.split(lower_latin(F.coalesce(named(text_col), F.lit(""))), NOT_WORD), "").alias("words"))
    grams = words.withColumn(
        "all_grams",  # the first is a mark that keeps the document
        F.expr(f"concat(array(0L), if(size(words) < {GRAM}, array(), transform(sequence(0, size(words) - {GRAM}), i -> xxhash64(words[i], words[i + 1], words[i + 2]))))"),
    )
    # outer: the array is never empty, and the optimiser does not copy its expression into a filter below
    hits = grams.select("row", "words", F.posexplode_outer("all_grams").alias("pos", "gram")).join(F.broadcast(t.unionByName(mark)), "gram")
    hits = hits.filter("tpl = -1 and pos = 0 or tpl >= 0 and pos > 0 and gram_text = concat_ws(' ', slice(words, pos, 3))")
    hits = hits.select("row", F.size("words").alias("n_words"), "tpl", "label", "exact", "grams", "tpos", (F.col("pos") - 1).alias("at")).repartition("row")
    lines = hits.groupBy("row", "tpl", "label", "exact", "grams", (F.col("at") - F.col("tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("tpl") == -1).alias("copies"), F.collect_set("tpos").alias("seen"), F.min("at").alias("start"), F.max(F.col("at") + GRAM).alias("end")
    )
    order = Window.partitionBy("row", "tpl").orderBy("diagonal")
    lines = lines.withColumn("new", F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR), F.lit(True)).cast("int"))
    lines = lines.withColumn("span", F.sum("new").over(order))
    merged = lines.groupBy("row", "tpl", "label", "exact", "grams", "span").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    share = F.col("votes") / F.col("grams")
    return merged.filter(F.col("label").isNull() | F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise(share >= COVERED)).select("row", "n_words", "copies", "label", "exact", "start", "end", F.when(F.col("label").isNull(), 0.0).otherwise(share).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base (places of a phrase), first_word, last_word, base_labels, labels, score.

    phrases and texts are (label, lower-case words joined by one space).  Rows that share a doc_id or have none, and rows that
    repeat one another, each get their own; a null or empty text has no words and no labels.
    """
    s = spans(docs, id_col, text_col, phrases, texts)
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.when(F.col("exact") & F.col("label").isNotNull(), F.col("start"))
    one = s.groupBy("row").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"), F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        labels(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("score").alias("score"),
    )
    return copied(one, "copies", "copy").select(F.col("row.id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
