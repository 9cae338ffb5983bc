"""License scans: an exact set-similarity join of text blocks with license templates, all in DataFrame functions.

A document's words are cut into blocks of WIDTH words, one every STEP words, so that any WIDTH - STEP + 1 consecutive
words lie in one block. A block meets a template when it holds THRESHOLD of the template's distinct words. Words are put
in the order of how many blocks of the whole corpus hold them, rarest first (only words of templates can count, so only
those are kept). With `need` the words asked for, a block and a template that meet have their first common word among
the first `size - need + 1` of either (prefixes), the block has `need` words (length), and after the first common word
each has `need - 1` left (positions): these filters join on words of the prefixes and lose nothing. What passes is
counted exactly, once, at its first common word.

Templates are a parameter of the operator, some tens of lines, and the only thing that is broadcast or collected.

Base labels are phrases whose words stand consecutively; a phrase counts with a score of 1. A null, empty or wordless
text has no words, labels or places and a score of 0; a text of any length is cut whole; repeated rows and equal or null
doc_ids are judged alike and each keep a row; a tie of labels keeps all of them; empty tables give an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwise.llm.common import lower_ascii, read, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, STEP, THRESHOLD = 64, 32, 0.9

#: (phrase, label) of the base.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, text) of the production templates: notices of public licenses. (Fixed values.)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without permission of the publisher"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively, from 0."""
    parts = phrase.split(" ")
    held = F.lit(True)
    for w in parts:
        held &= F.array_contains(words, w)

    def here(i: Column) -> Column:
        found = F.lit(True)
        for k, w in enumerate(parts):
            found &= F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return found

    return F.when(held, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def needed(size: int, threshold: float) -> int:
    """The least number of a template's words that is THRESHOLD of them."""
    return next(n for n in range(size + 1) if n >= threshold * size - 1e-9)


def text_of_list(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")"


def template_table(spark: SparkSession, templates, order: list[str], threshold: float) -> DataFrame:
    """template, label, tokens (in order), size, need; and for each word of the prefix: token, place."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for n, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split(" ")), key=rank.__getitem__)
        need = needed(len(tokens), threshold)
        rows += [f"({n}, {text_of_list([label])}[0], {text_of_list(tokens)}, {need}, {text_of_list([t])}[0], {i})" for i, t in enumerate(tokens[: len(tokens) - need + 1])]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(template, label, tokens, need, token, place)")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """docs(doc_id, text) with their words, places and labels of phrases, labels of templates, and score."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, text in templates for w in text.split(" ")})
    least = min(needed(len(set(text.split(" "))), threshold) for _, text in templates)
    assert max(len(text.split(" ")) for _, text in templates) <= width - step + 1

    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - (width - step) - 1, F.lit(0)), F.lit(step))
    blocks = F.transform(starts, lambda s: F.array_intersect(F.expr(text_of_list(vocabulary)), F.slice("words", s + 1, F.lit(width))))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", n.cast("long").alias("n_words"), *(places(F.col("words"), p).alias(f"phrase_{i}") for i, (p, _) in enumerate(phrases)), blocks.alias("blocks"))
    found = F.array_sort(F.flatten(F.array(*(F.col(f"phrase_{i}") for i in range(len(phrases))))))
    label = [F.when(F.size(f"phrase_{i}") > 0, F.lit(name)) for i, (_, name) in enumerate(phrases)]
    rows = rows.select(
        "doc_id", "n_words", found.alias("found"), F.array_sort(F.array_distinct(F.array_compact(F.array(*label)))).alias("base"),
        F.filter("blocks", lambda b: F.size(b) >= least).alias("blocks"),
    )
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.size("found").cast("long").alias("n_base"),
        F.get("found", F.lit(0)).cast("long").alias("first_word"), F.try_element_at("found", F.lit(-1)).cast("long").alias("last_word"), "base", "blocks",
    )
    rows = stage(rows, "license-blocks")

    each = rows.select("row", F.posexplode("blocks").alias("block", "held"))
    counts = {r["token"]: r["count"] for r in each.select(F.explode("held").alias("token")).groupBy("token").count().collect()}  # words of templates
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    table = template_table(spark, templates, order, threshold)
    ordered = each.select("row", F.array_intersect(F.expr(text_of_list(order)), F.col("held")).alias("held"))
    prefix = ordered.select("row", "held", F.posexplode(F.slice("held", 1, F.greatest(F.size("held") - least + 1, F.lit(0)))).alias("at", "token"))
    after = F.least(F.size("held") - F.col("at"), F.size("tokens") - F.col("place"))
    met = (
        prefix.join(F.broadcast(table), "token")
        .filter((F.size("held") >= F.col("need")) & (after >= F.col("need")))
        .select("row", "label", "token", "need", F.size("tokens").alias("size"), F.array_intersect("held", "tokens").alias("common"))
        .filter((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("token")))
    )
    best = met.groupBy("row").agg(F.collect_set("label").alias("met"), F.max(F.size("common") / F.col("size")).alias("best"))
    labels = F.array_sort(F.array_union("base", F.coalesce("met", F.array().cast("array<string>"))))
    return rows.drop("blocks").join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_HERE = " AND ".join(f"(len(p.words) < {k + 1} OR d.words[i + {k + 1}] = p.words[{k + 1}])" for k in range(max(len(p.split(" ")) for p, _ in PHRASES)))
OP12_SQL = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
        FROM documents),
    phrases AS (SELECT string_split(phrase, ' ') AS words, label FROM (VALUES {_values(PHRASES)}) t(phrase, label)),
    templates AS (SELECT label, list_distinct(string_split(text, ' ')) AS words FROM (VALUES {_values(TEMPLATES)}) t(label, text)),
    places AS (SELECT d.row, d.i, p.label FROM (SELECT row, words, unnest(range(len(words))) AS i FROM docs) d JOIN phrases p ON d.words[i + 1] = p.words[1] AND {_HERE}),
    base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY row),
    blocks AS (SELECT row, words[i + 1 : i + {WIDTH}] AS words FROM (SELECT row, words, unnest(range(0, greatest(len(words) - {WIDTH - STEP}, 1), {STEP})) AS i FROM docs)),
    met AS (SELECT b.row, t.label, len(list_intersect(t.words, b.words)) / len(t.words) AS part FROM blocks b, templates t WHERE 10 * len(list_intersect(t.words, b.words)) >= {round(10 * THRESHOLD)} * len(t.words)),
    best AS (SELECT row, list(DISTINCT label) AS labels, max(part) AS part FROM met GROUP BY row)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, best.labels))), ','), '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0) END::DOUBLE AS score
    FROM docs LEFT JOIN base USING (row) LEFT JOIN best USING (row)
"""
