"""License scans by diagonal voting.

Every run of GRAM words of a text is hashed and looked up among the positions of the same runs in license templates. A hit votes for the
diagonal (place in the text less place in the template) on which text and template would run side by side. Votes are aggregated by
diagonal; neighbouring diagonals, as words put in or left out make them, are merged to spans; a span is verified word by word.
The phrases of the base scan are short templates: a diagonal on which all their runs voted is a place.

Texts are read once and never shuffled: each row keeps only the runs that pass a Bloom filter of all template runs, with the words around
them, and the exact join follows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import packed, saved
from .resample import plain_words

GRAM = 3
#: Words on both sides of a run that are held against the template.
REACH = 6
#: Diagonals at most so far apart are one span.
DRIFT = 4
#: Share of a template's words that a span must hold for its label.
SHARE = 0.7
#: Bits of the Bloom filter: more than 50 for each run of the templates.
BLOOM_BITS = 1 << 16


class Template(NamedTuple):
    """Words of a license text or notice, those that a span must hold, and those that it may not have around it."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


#: Phrases of the base scan.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Notices and first sentences of well-known licenses, in plain words.
TEMPLATES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache", "2")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu", "general", "2"), ("lesser", "affero")),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu", "general", "3"), ("lesser", "affero")),
    Template("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("2",), ("lesser", "affero")),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("3",), ("lesser", "affero")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser",)),
    Template("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla",)),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("attribution",), ("sharealike", "noncommercial", "noderivatives")),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("sharealike",), ("noncommercial",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("noncommercial",), ("sharealike", "noderivatives")),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
]


def template_words(templates: list[Template] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> list[tuple]:
    """template, base, label, words, must (positions) and without of all phrases and templates."""
    rows = [(True, label, text.split(), [], []) for label, text in phrases]
    rows += [(False, t.label, words := t.text.split(), [p for p, w in enumerate(words) if w in t.must], list(t.without)) for t in templates]
    assert all(len(words) >= GRAM for _, _, words, _, _ in rows), "a template has fewer words than a run"
    return [(k, *row) for k, row in enumerate(rows)]


def run_hash(words: Column, at: Column) -> Column:
    """Hash of the run of words that begins at ``at``."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(GRAM)])


def template_runs(spark: SparkSession, templates: list[tuple]) -> DataFrame:
    """A row for each run of each template, with its hash; as many rows as the templates have words, at most."""
    table = spark.createDataFrame(templates, "template int, base boolean, label string, t_words array<string>, must array<int>, without array<string>")
    runs = table.withColumn("t_pos", F.explode(F.sequence(F.lit(0), F.size("t_words") - GRAM)))
    return runs.withColumn("hash", run_hash(F.col("t_words"), F.col("t_pos")))


def bloom(hashes: list[int]) -> Column:
    """A literal array of 64-bit words in which the bit of each hash is set."""
    bits = [0] * (BLOOM_BITS // 64)
    for h in hashes:
        bits[(h % BLOOM_BITS) >> 6] |= 1 << (h & 63)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")


def passing_runs(docs: DataFrame, hashes: list[int]) -> DataFrame:
    """row, doc_id, n_words and runs (place, hash, and the words around with the place of their first) of each row; runs that no template has mostly go."""
    bits = bloom(hashes)

    def may_hold(h: Column) -> Column:
        word = F.element_at(bits, F.shiftright(h.bitwiseAND(F.lit(BLOOM_BITS - 1)), 6).cast("int") + 1)
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    words = F.col("words")
    listed = docs.select(docs["doc_id"].alias("doc_id"), plain_words(docs["text"]).alias("words"))
    places = F.when(F.size(words) >= GRAM, F.sequence(F.lit(0), F.size(words) - GRAM)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(places, lambda at: may_hold(run_hash(words, at)))

    def told(at: Column) -> Column:
        first = F.greatest(at - REACH, F.lit(0))
        around = F.slice(words, first + 1, at - first + GRAM + REACH)
        return F.struct(at.alias("pos"), run_hash(words, at).alias("hash"), first.alias("first"), around.alias("around"))

    return listed.select("doc_id", F.size(words).cast("long").alias("n_words"), F.transform(kept, told).alias("runs")).withColumn("row", F.monotonically_increasing_id())


def votes(runs: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each run of a text and each equal run of a template: its diagonal, and the template's words that stand around it."""
    hits = runs.select("row", F.explode("runs").alias("run")).select("row", "run.*").join(F.broadcast(known), "hash")
    same = F.slice("around", F.col("pos") - F.col("first") + 1, GRAM) == F.slice("t_words", F.col("t_pos") + 1, GRAM)
    near = F.sequence(F.greatest(F.col("t_pos") - REACH, F.lit(0)), F.least(F.col("t_pos") + GRAM + REACH, F.size("t_words")) - 1)
    at = F.col("pos") - F.col("first") - F.col("t_pos")
    equal = F.filter(near, lambda t: F.coalesce(F.get("around", t + at) == F.get("t_words", t), F.lit(False)))
    spoiled = F.arrays_overlap("around", "without")
    return hits.filter(same).select("row", "template", "base", "label", (F.col("pos") - F.col("t_pos")).alias("diagonal"), "pos", equal.alias("equal"), spoiled.alias("spoiled"), F.size("t_words").alias("size"), "must")


def diagonals(voted: DataFrame) -> DataFrame:
    """Votes of each diagonal: their number, words verified, and the span in the text."""
    return voted.groupBy("row", "template", "diagonal").agg(
        F.count("*").alias("n"),
        F.array_distinct(F.flatten(F.collect_set("equal"))).alias("equal"),
        F.min("pos").alias("from"),
        (F.max("pos") + GRAM).alias("to"),
        F.max("spoiled").alias("spoiled"),
        *[F.any_value(c).alias(c) for c in ("base", "label", "size", "must")],
    )


def spans(lines: DataFrame, drift: int = DRIFT) -> DataFrame:
    """Neighbouring diagonals of one row and template as one span, with the share of the template's words that it holds, and its places.

    A phrase has a place on each diagonal on which all its runs voted: ``places``, ``first`` and ``last``; its share is null.
    """
    over = W.partitionBy("row", "template").orderBy("diagonal")
    far = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(over) > drift).cast("int"), F.lit(0))
    numbered = lines.withColumn("far", far).withColumn("span", F.sum("far").over(over.rowsBetween(W.unboundedPreceding, 0)))
    place = F.when(F.col("base") & (F.col("n") == F.col("size") - GRAM + 1), F.col("diagonal"))
    merged = numbered.groupBy("row", "template", "span").agg(
        F.array_distinct(F.flatten(F.collect_set("equal"))).alias("equal"),
        F.min("from").alias("from"),
        F.max("to").alias("to"),
        F.max("spoiled").alias("spoiled"),
        F.count(place).alias("places"),
        F.min(place).alias("first"),
        F.max(place).alias("last"),
        *[F.any_value(c).alias(c) for c in ("base", "label", "size", "must")],
    )
    return merged.withColumn("share", F.when(~F.col("base"), F.size("equal") / F.col("size")))


def holds(share: float = SHARE) -> Column:
    """Does a span verify: enough of the template's words, all it must hold, nothing that tells another license, and not stretched?"""
    return (F.col("share") >= share) & (F.size(F.array_except("must", "equal")) == 0) & ~F.col("spoiled") & (F.col("to") - F.col("from") <= 2 * F.col("size"))


def joined(labels: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row of ``docs``.

    ``spans`` lists label, from, to (words) and share of each verified span of a template. The score is 1 where a phrase
    stands, else the greatest share of a template's words in any of its spans, verified or not; 0 without any. Null and empty texts
    have no words, empty labels and score 0. Texts are read whole; repeated rows are scanned each for itself; an empty table gives no
    rows; columns of other names are not read.
    """
    spark = docs.sparkSession
    known = template_runs(spark, template_words(templates, phrases))
    hashes = [r[0] for r in known.select("hash").distinct().collect()]  # as many as the templates have words, at most
    runs = saved(passing_runs(docs, hashes), "license-runs")
    listed = F.when(holds(share), F.struct("label", "from", "to", "share"))
    found_spans = F.array_sort(F.collect_list(listed))
    by_row = spans(diagonals(votes(runs, known))).groupBy("row").agg(
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("places") > 0, F.col("label"))).alias("phrases"),
        F.when(F.max("share").isNotNull(), found_spans).alias("spans"),
        F.max("share").alias("best"),
    )
    nothing = F.array().cast("array<string>")
    told = packed(runs.select("row", "doc_id", "n_words").join(by_row, "row", "left"), runs.count())
    found = F.coalesce(F.col("phrases"), nothing)
    return told.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        joined(found).alias("base_labels"),
        joined(F.concat(found, F.coalesce(F.col("spans.label"), nothing))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "spans",
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _sql() -> str:
    """The same in SQL over one row for each word."""
    rows = template_words()
    listed = lambda values: "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"
    values = ", ".join(f"({k}, {base}, '{label}', {listed(words)}, {listed(must)}::INT[], {listed(without)}::VARCHAR[])" for k, base, label, words, must, without in rows)
    return f"""WITH tp(template, base, label, ws, must, without) AS (VALUES {values}), tw AS MATERIALIZED (SELECT template, unnest(ws) AS w, unnest(range(len(ws))) AS t FROM tp),
tg AS (SELECT template, t, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM tw WINDOW o AS (PARTITION BY template ORDER BY t)),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
w AS MATERIALIZED (SELECT row, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d), wg AS (SELECT row, p, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY row ORDER BY p)),
v AS MATERIALIZED (SELECT row, template, p, t, p - t AS diagonal FROM wg JOIN tg USING (g)),
l AS (SELECT row, template, diagonal, count(*) AS n, min(p) AS f, max(p) + 3 AS l FROM v GROUP BY 1, 2, 3),
eq AS (SELECT DISTINCT row, template, diagonal, tw.t FROM v JOIN tw USING (template) JOIN w USING (row, w) WHERE tw.t BETWEEN v.t - {REACH} AND v.t + {GRAM + REACH - 1} AND w.p = tw.t + diagonal),
bad AS (SELECT DISTINCT row, template, diagonal FROM v JOIN tp USING (template) JOIN w USING (row) WHERE w.p BETWEEN v.p - {REACH} AND v.p + {GRAM + REACH - 1} AND list_contains(without, w.w)),
pl AS (SELECT row, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS names FROM l JOIN tp USING (template) WHERE base AND n = len(ws) - 2 GROUP BY 1),
gap AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > {DRIFT})::INT, 0) AS far FROM l JOIN tp USING (template) WHERE NOT base),
num AS (SELECT *, sum(far) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM gap),
held AS (SELECT row, template, span, list(DISTINCT t) AS ts FROM num JOIN eq USING (row, template, diagonal) GROUP BY 1, 2, 3),
sp AS (SELECT row, template, span, any_value(label) AS label, any_value(must) AS must, any_value(len(ws)) AS size, min(f) AS f, max(l) AS l, count(bad.row) > 0 AS spoiled FROM num LEFT JOIN bad USING (row, template, diagonal) GROUP BY 1, 2, 3),
ok AS (SELECT row, max(len(ts) / size) AS best, list(DISTINCT label) FILTER (len(ts) / size >= {SHARE} AND len(list_filter(must, lambda m: NOT list_contains(ts, m))) = 0 AND NOT spoiled AND l - f <= 2 * size) AS names FROM sp JOIN held USING (row, template, span) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(pl.names), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(pl.names, ok.names))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score FROM d LEFT JOIN pl USING (row) LEFT JOIN ok USING (row)"""


OP13_SQL = _sql()
