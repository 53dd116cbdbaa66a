"""Licence scan: Dice coefficient over word bigrams against licence templates.

Lines, whole texts and word windows are normalised (lower case, everything but
a-z and 0-9 as one space) and compared with each template whose size allows the
threshold: two sets of n and m bigrams have a Dice coefficient of at most
2 min(n, m) / (n + m). A window of any place and length, up to the bound of its
template, is reported where neither its lines nor the whole text match the same
template; of windows that overlap, the best is. Only built-in functions run on
the rows.

Null or empty text, and units of fewer than two words: no match. A unit that
reaches the threshold with several templates matches each. Repeated rows are
each scanned, and repeated lines are each reported; empty tables give none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices as licences and their stewards publish them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
}


def all_templates() -> dict[str, str]:
    """The notices, and the full texts in ``licence_texts``."""
    return TEMPLATES | {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in (files(__package__) / "licence_texts").iterdir() if p.name.endswith(".txt")}


def words(text: Column) -> Column:
    """Normalised words of a text."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def runs(w: Column) -> Column:
    """Bigrams of an array of words in their order, as 64-bit hashes."""
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<bigint>"))


def bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words, as 64-bit hashes."""
    return F.array_distinct(runs(w))


def _bounds(text: str, threshold: float) -> tuple[int, int, int, list[str]]:
    """What a unit that reaches the threshold has of a template: so many of its bigrams, at most so many bigrams in a row, and so many of its words; and these words.

    Dice >= t with a template of n bigrams needs t n / (2 - t) of them. A
    lacking word takes its bigrams away, and a bigram is of two words, so the
    words that lack, those of fewest bigrams first, are few.
    """
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    pairs = set(zip(w, w[1:]))
    least = math.ceil(threshold * len(pairs) / (2 - threshold) - 1e-9)
    most = math.ceil((len(w) - 1) * (2 - threshold) / threshold)
    touched = sorted(Counter(x for p in pairs for x in set(p)).values())
    lacking = sum(1 for total in accumulate(touched) if total <= 2 * (len(pairs) - least))
    return least, most, len(touched) - lacking, sorted(set(w))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is worked out once, however often it is used."""
    return rows.select(*rows.columns, F.explode(F.array(value)).alias(name))


def _dice(grams: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(grams, "grams")) / (F.size(grams) + F.size("grams"))


def _best_run(run: Column) -> Column:
    """Best Dice of the stretches from the start of ``run`` (structs ``hit, gap``), and the length of the first that has it."""
    state = F.struct(F.lit(0).alias("k"), F.lit(0).alias("met"), F.lit(0).alias("other"), F.lit(0.0).alias("dice"), F.lit(0).alias("length"))

    def better(s: Column) -> tuple[Column, Column]:
        dice = 2.0 * s["met"] / (s["met"] + s["other"] + F.size("grams"))
        return F.greatest(dice, s["dice"]).alias("dice"), F.when(dice > s["dice"], s["k"]).otherwise(s["length"]).alias("length")

    def step(s: Column, x: Column) -> Column:
        first = (x["gap"] == 0) | (x["gap"] > s["k"])  # in this stretch
        return F.struct((s["k"] + 1).alias("k"), (s["met"] + (first & x["hit"]).cast("int")).alias("met"), (s["other"] + (first & ~x["hit"]).cast("int")).alias("other"), *better(s))

    return F.aggregate(run, state, step, lambda s: F.struct(*better(s)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, line_no, license, dice`` of each match; ``line_no`` counts from 0 and is -1 for the whole text of several lines.

    A match of a word window has the line on which it starts.
    """
    spark = docs.sparkSession
    known = {k: (t, *_bounds(t, threshold)) for k, t in (all_templates() if templates is None else templates).items()}
    known = {k: v for k, v in known.items() if v[1]}
    if not known:
        return docs.select("doc_id", F.lit(0).alias("line_no"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).where("false")
    vocabulary = F.split(F.lit(" ".join(sorted({w for v in known.values() for w in v[4]}))), " ")
    table = spark.createDataFrame([(k, *v) for k, v in sorted(known.items())], "license string, notice string, least int, most int, least_words int, vocabulary array<string>")
    table = spark.createDataFrame(table.select("license", bigrams(words(F.col("notice"))).alias("grams"), "least", "most", "least_words", "vocabulary").collect(), "license string, grams array<bigint>, least int, most int, least_words int, vocabulary array<string>")
    # every unit is a window of the text's words: most texts have too few words of any template
    rows = _once(docs.select("doc_id", "text"), "present", F.array_intersect(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), vocabulary))
    rows = rows.where(F.size("present") >= min(v[3] for v in known.values()))
    rows = rows.crossJoin(F.broadcast(table)).where((F.size("present") >= F.col("least_words")) & (F.size(F.array_intersect("present", "vocabulary")) >= F.col("least_words")))
    rows = _once(rows.drop("present", "vocabulary", "least_words"), "lines", F.transform(F.split("text", "\n"), words)).drop("text")
    rows = _once(rows, "all", runs(F.flatten("lines"))).where(F.size(F.array_intersect("all", "grams")) >= F.col("least"))
    fits = lambda g: 2 * F.least(F.size(g), F.size("grams")) >= threshold * (F.size(g) + F.size("grams"))
    found = lambda i, g: F.struct(i.cast("int").alias("line_no"), F.when(fits(g), _dice(g)).alias("dice"))
    reached = lambda m: m["dice"] >= threshold
    rows = _once(rows, "own", F.filter(F.transform(F.transform("lines", bigrams), lambda g, i: found(i, g)), reached))
    rows = _once(rows, "whole", F.filter(F.when(F.size("lines") > 1, F.array(found(F.lit(-1), F.array_distinct("all")))).otherwise(F.array().cast("array<struct<line_no:int,dice:double>>")), reached))
    rows = _windows(rows, threshold)
    return rows.select("doc_id", "license", F.explode(F.concat("own", "whole", "windows")).alias("m")).select("doc_id", "m.line_no", "license", "m.dice")


def _windows(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` with ``windows``: best stretches of words, apart from each other and from lines and texts that match as such.

    A stretch that starts on a bigram of the template right behind another is
    never better than the one from there, so only the first of each are tried,
    and every end of each, up to ``most`` bigrams on.
    """
    none = F.array().cast("array<struct<line_no:int,dice:double>>")
    before = lambda i: F.slice("all", F.greatest(F.lit(1), i - F.col("most") + 2), F.least(i, F.col("most") - 1))
    rows = _once(rows, "met", F.array_intersect("all", "grams"))
    items = F.transform("all", lambda x, i: F.struct(F.array_contains("met", x).alias("hit"), F.array_position(F.reverse(before(i)), x).alias("gap")))
    rows = _once(rows, "items", F.when(F.size("whole") == 0, items).otherwise(F.array().cast("array<struct<hit:boolean,gap:bigint>>")))
    item = lambda p: F.get("items", p)
    starts = F.filter(F.sequence(F.lit(0), F.size("items")), lambda p: F.coalesce(item(p)["hit"], F.lit(False)) & ~F.coalesce(item(p - 1)["hit"], F.lit(False)))
    best = F.transform(starts, lambda p: F.struct(p.alias("p"), _best_run(F.slice("items", p + 1, F.col("most"))).alias("b")))
    best = F.filter(best, lambda m: m["b"]["dice"] >= threshold)
    rows = _once(rows, "best", F.transform(best, lambda m: F.struct((-m["b"]["dice"]).alias("worse"), m["p"].alias("first"), (m["p"] + m["b"]["length"]).alias("last"))))
    rows = _once(rows, "at", F.flatten(F.transform("lines", lambda w, i: F.array_repeat(i, F.size(w)))))
    apart = F.filter("best", lambda m: ~F.exists("own", lambda o: o["line_no"].between(F.get("at", m["first"]), F.get("at", m["last"]))))
    kept = F.aggregate(F.array_sort(apart), F.array().cast("array<struct<worse:double,first:int,last:int>>"), lambda s, m: F.when(F.exists(s, lambda o: (o["first"] <= m["last"]) & (m["first"] <= o["last"])), s).otherwise(F.concat(s, F.array(m))))
    return rows.withColumn("windows", F.when(F.size("best") > 0, F.transform(kept, lambda m: F.struct(F.get("at", m["first"]).alias("line_no"), (-m["worse"]).alias("dice")))).otherwise(none))


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The matches of lines and whole texts with all templates in DuckDB's SQL; it has no windows."""
    templates = all_templates() if templates is None else templates
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(templates.items()))
    return f"""
WITH texts AS (
    SELECT doc_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS unit, NULL::VARCHAR AS license
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    UNION ALL SELECT doc_id, -1, text, NULL FROM documents WHERE contains(text, chr(10))
    UNION ALL SELECT NULL, NULL, t, k FROM (VALUES {values}) v(k, t)
), worded AS (
    SELECT doc_id, line_no, license, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM texts
), grammed AS (
    SELECT doc_id, line_no, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1
)
SELECT u.doc_id, u.line_no, t.license, 2.0::DOUBLE * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) AS dice
FROM (FROM grammed WHERE license IS NULL) u JOIN (FROM grammed WHERE license IS NOT NULL) t
  ON 2 * least(len(u.g), len(t.g)) >= {threshold} * (len(u.g) + len(t.g))
WHERE dice >= {threshold}"""
