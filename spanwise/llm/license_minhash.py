"""Licence scan in built-in expressions only: MinHash bands over text windows, then exact containment.

Words are runs of ASCII letters and digits, lower-cased. A template's 5-word shingles are cut into windows
of at most WINDOW shingles; texts are cut into windows of the same sizes that overlap by three quarters
(small windows start at every word). BANDS minima of seeded hashes describe a window, and one equal minimum
retrieves the template: a window that holds three quarters of a template window at the worst offset has
similarity 0.45 or more, so it is missed with probability (1 - 0.45) ** 16 < 1e-4. A retrieved template
counts when at least THRESHOLD of its shingles are among the text's.

A stretch of text that lacks every key word of a template cannot hold THRESHOLD of its shingles (key words are
chosen so that fewer avoid all of them). So windows are built in passages around key words only, which reach
further than any template on both sides; a text without a key word has none. This drops nothing that could
match, and holds at every size.

Defined results: texts that are null, empty or have fewer than five words match nothing; rows without a
doc_id are not reported; rows that repeat a doc_id count as one document whose best containment is kept;
empty input or no templates give no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS, WINDOW, BANDS, THRESHOLD = 5, 24, 16, 0.75
#: Template minima that may stand in the plan as a set; with more, all windows' minima go to the join.
LITERALS = 5000

#: Customary notices that name a licence.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-3-clause-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "No part of this work may be reproduced without permission. All rights reserved.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))


def key_words(text: str, threshold: float = THRESHOLD) -> list[str]:
    """The fewest long words without which less than ``threshold`` of the shingles remain."""
    left, chosen = template_shingles(text), []
    needed = math.ceil(threshold * len(left))
    words = sorted(set(template_words(text)), key=lambda w: (-len(w), w))
    while left and len(left) >= needed:
        word = words.pop(0)
        if any(word in s.split(" ") for s in left):
            chosen.append(word)
            left = [s for s in left if word not in s.split(" ")]
    return chosen


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _shingles(words: Column) -> Column:
    return F.when(
        F.size(words) >= WORDS,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.array_join(F.slice(words, i, WORDS), " ")),
    ).otherwise(F.array().cast("array<string>"))


def _minima(hashes: Column, starts: Column, size: int) -> Column:
    """For every window start, the minimum of each seeded hash over the window's shingles."""
    return F.transform(starts, lambda at: F.transform(hashes, lambda row: F.array_min(F.slice(row, at, size))))


def _bands(size: int, values: list[int] | None) -> Column:
    """(size, band, value) of all windows of one size; with ``values``, only those that have one of them."""
    stride = max(1, size // 4)
    last = F.greatest(F.size("shingles") - size + 1, F.lit(1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(stride)), F.array(last)))
    minima = _minima(F.col("hashes"), starts, size)
    if values is not None:
        minima = F.filter(minima, lambda m: F.exists(m, lambda v: v.isin(values)))
    return F.flatten(F.transform(minima, lambda m: F.transform(m, lambda v, i: F.struct(F.lit(size).alias("size"), i.alias("band"), v.alias("value")))))


def _hashed(frame: DataFrame) -> DataFrame:
    seeds = F.sequence(F.lit(1), F.lit(BANDS))
    return frame.withColumn("hashes", F.transform(seeds, lambda k: F.transform("shingles", lambda s: F.xxhash64(s, k))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, n_shared, n_template and containment of every template found in every text."""
    spark = docs.sparkSession
    templates = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if template_shingles(v)}
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("t_size", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.StringType()))])
    whole = spark.createDataFrame([(k, 0, template_shingles(v)) for k, v in templates.items()], schema)
    cut = []
    for k, v in templates.items():
        own = template_shingles(v)
        size = min(len(own), WINDOW)
        cut += [(k, size, own[i : i + size]) for i in [*range(0, max(1, len(own) - size), WINDOW // 2), len(own) - size]]
    windows = _hashed(spark.createDataFrame(cut, schema))
    wanted = windows.select("key", "t_size", F.posexplode(F.transform("hashes", F.array_min)).alias("band", "value")).toDF("template", "size", "band", "value").distinct()

    lowered = F.lower("text")
    keys = sorted({w for v in templates.values() for w in key_words(v, threshold)})
    possible = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    condition = F.lit(False)
    for w in keys:
        condition = condition | lowered.contains(w)
    possible = possible.where(condition).select(F.col("doc_id").alias("key"), _words(F.col("text")).alias("words"))
    # Filters stay on the words: one on the shingles would be pushed down and split the text again for each of them.
    possible = possible.where(F.size("words") >= WORDS)
    shingled = possible.select("key", F.array_distinct(_shingles(F.col("words"))).alias("shingles"))
    reach = max([1, *(len(template_words(v)) for v in templates.values())])
    spots = F.array_distinct(F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(keys), F.floor(i / reach).cast("int")))))
    passages = possible.select("key", "words", F.explode(spots).alias("at")).select(
        "key", F.slice("words", F.greatest(F.col("at") - 1, F.lit(0)) * reach + 1, F.when(F.col("at") > 0, 3 * reach).otherwise(2 * reach)).alias("passage")
    )
    hashed = _hashed(passages.where(F.size("passage") >= WORDS).distinct().select("key", _shingles(F.col("passage")).alias("shingles")))
    values = [r["value"] for r in wanted.select("value").distinct().collect()] if len(cut) * BANDS <= LITERALS else None
    if not cut:
        return docs.where(F.lit(False)).selectExpr("doc_id", "'' template", "0 n_shared", "0 n_template", "0.0D containment")
    bands = F.array_distinct(F.concat(*[_bands(size, values) for size in sorted({s for _, s, _ in cut})]))
    banded = hashed.select("key", F.explode(bands).alias("b")).select("key", "b.*")
    found = banded.join(wanted, ["size", "band", "value"]).select("key", "template").distinct()
    whole = whole.select(F.col("key").alias("template"), F.col("shingles").alias("t_shingles"))
    both = found.join(whole, "template").join(shingled, "key")
    both = both.select(
        F.col("key").alias("doc_id"), "template", F.size(F.array_intersect("t_shingles", "shingles")).alias("n_shared"), F.size("t_shingles").alias("n_template")
    )
    best = both.groupBy("doc_id", "template", "n_template").agg(F.max("n_shared").alias("n_shared"))
    return best.where(F.col("n_shared") >= threshold * F.col("n_template")).select(
        "doc_id", "template", "n_shared", "n_template", (F.col("n_shared") / F.col("n_template")).alias("containment")
    )


def oracle() -> str:
    """The same answer by looking every template up in every text (for DuckDB)."""
    rows = ", ".join("({}, [{}])".format(f"'{k}'", ", ".join(f"'{s}'" for s in template_shingles(v))) for k, v in TEMPLATES.items())
    return f"""
    with templates(template, t) as (values {rows}),
    cut as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') as w
            from documents where doc_id is not null and text is not null),
    shingled as (select doc_id, list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))) as s from cut),
    counted as (select doc_id, template, max(len(list_intersect(t, s))) as n_shared, max(len(t)) as n_template
                from shingled, templates group by all)
    select doc_id, template, n_shared, n_template, n_shared / n_template as containment
    from counted where n_shared >= {THRESHOLD} * n_template"""
