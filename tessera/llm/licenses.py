"""License scans by diagonal voting.

Every rolling word 3-gram of every text is joined to the places where the license templates
have it. A match of text place i and template place p votes for the diagonal i - p; votes are
summed by text, template and diagonal before anything is shuffled, so what is exchanged is a
few rows a text. A base phrase stands wherever a diagonal has all its votes. For the
method's own labels, neighbouring diagonals (words put in or left out) are merged, and a span
is accepted if enough of the template's places, each counted once however often the text has
it, are covered within a stretch of text not much longer.

DataFrame functions only; templates are a fixed, small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.text import load_documents

#: Phrases that are found word by word, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices and whole short texts of common licenses, and the labels that a close likeness gives.
NOTICES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
        " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to"
        " the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
K = 3
#: Places of a template whose marks one long holds, and longs: templates have 186 3-grams at most.
MARKS, LONGS = 62, 3
#: Diagonals this close are merged; a span may be this many words (or an eighth) longer than its template, and has to have this share of its 3-grams.
SLACK, STRETCH, COVER = 3, 12, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(base=BASE, notices=NOTICES) -> list[tuple]:
    """(template, label, base, grams, at, w1, w2, w3) of each 3-gram of each template."""
    rows = []
    for number, (text, label) in enumerate((*base, *notices)):
        words = text.split()
        assert len(words) - K + 1 <= MARKS * LONGS
        for p in range(len(words) - K + 1):
            rows.append((number, label, number < len(base), len(words) - K + 1, p, *words[p : p + K]))
    return rows


def template_table(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    t = spark.createDataFrame(template_grams(base, notices), "template int, label string, base boolean, grams int, at int, t1 string, t2 string, t3 string")
    return F.broadcast(t.withColumn("gram", F.xxhash64("t1", "t2", "t3")))


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, text) -> (row, doc_id, template, label, base, grams, diagonal, n, low, high, last, m0, m1, m2).

    A row for each text, template and diagonal with its votes, the first and last template
    place, the last word's number and marks (bits) of the template places met; one row a text without a template for its other words.
    """
    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    three = F.arrays_zip(F.col("w").alias("w1"), F.expr("slice(w, 2, size(w))").alias("w2"), F.expr("slice(w, 3, size(w))").alias("w3"))
    each = cut.select("row", "doc_id", F.posexplode_outer(three).alias("i", "g")).select("row", "doc_id", "i", F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"), F.col("g.w3").alias("w3"))
    each = each.withColumn("gram", F.when(F.col("w3").isNotNull(), F.xxhash64("w1", "w2", "w3")))
    t = templates.withColumnRenamed("gram", "tgram")
    met = each.join(t, (F.col("gram") == F.col("tgram")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3")), "left")
    return met.groupBy("row", "doc_id", "template", "label", "base", "grams", (F.col("i") - F.col("at")).alias("diagonal")).agg(
        F.count("i").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("i").alias("last"),
        *(F.bit_or(_mark(k)).alias(f"m{k}") for k in range(LONGS)),
    )


def _mark(k: int) -> Column:
    """The bit of the place in the k-th long, 0 if it lies in another."""
    return F.expr(f"if(at >= {MARKS * k} and at < {MARKS * (k + 1)}, shiftleft(1L, at - {MARKS * k}), 0L)")


def scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, template, first word, word after and share covered of each accepted span.
    Null, empty and wordless texts have no words and no labels (empty strings); repeated rows
    are scanned one by one; extra columns are ignored. score: the largest share covered by an accepted span, else 0.
    """
    templates = template_table(docs.sparkSession, base, notices)
    v = votes(docs, templates)
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(near)
    v = v.withColumn("group", F.when(F.col("template").isNotNull(), F.sum(F.when(step <= SLACK, 0).otherwise(1)).over(near)))
    spans = v.groupBy("row", "doc_id", "template", "label", "base", "grams", "group").agg(
        *(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(LONGS)), F.sum(F.when(F.col("n") == F.col("grams"), 1).otherwise(0)).alias("whole"),
        F.min(F.when(F.col("n") == F.col("grams"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("n") == F.col("grams"), F.col("diagonal"))).alias("final"),
        F.min(F.col("diagonal") + F.col("low")).alias("start"), F.max(F.col("diagonal") + F.col("high") + K).alias("stop"), F.max("last").alias("last"),
    )
    cover = sum((F.bit_count(f"m{k}") for k in range(LONGS)), F.lit(0)) / F.col("grams")
    close = F.col("stop") - F.col("start") <= F.col("grams") + K - 1 + F.greatest(F.lit(STRETCH), F.expr("grams div 8"))
    good = F.when(F.col("base"), F.col("whole") > 0).otherwise((cover >= COVER) & (close | (F.col("whole") > 0)))
    labels = lambda wanted: F.array_join(F.array_sort(F.collect_set(F.when(wanted, F.col("label")))), ",")
    spans = spans.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("cover", cover)
    # Of the notices' spans that overlap in the text, those with the largest cover stay.
    by_text = Window.partitionBy("row", "base", "good").orderBy("start", "stop", "template")
    reached = F.max("stop").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("cluster", F.when(F.col("start") < reached, 0).otherwise(1)).withColumn("cluster", F.sum("cluster").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max("cover").over(Window.partitionBy("row", "base", "good", "cluster"))
    found = apart.withColumn("best", best).withColumn("good", F.col("good") & (F.col("base") | (F.col("cover") == F.col("best"))))
    places = F.when(F.col("base"), F.col("whole")).otherwise(0)
    return found.groupBy("row", "doc_id").agg(
        F.coalesce(F.max("last") + 1, F.lit(0)).cast("long").alias("n_words"), F.coalesce(F.sum(places), F.lit(0)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("final"))).cast("long").alias("last_word"),
        labels(F.col("base") & (F.col("whole") > 0)).alias("base_labels"), labels(F.col("good")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(F.col("good"), F.struct("label", "template", "start", "stop", "cover"))).alias("spans"),
    ).drop("row")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(load_documents(spark, sf_dir)).drop("spans")


def _oracle() -> str:
    values = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in template_grams())
    each = range(LONGS)
    marks = ", ".join(f"bit_or(CASE WHEN place >= {MARKS * k} AND place < {MARKS * (k + 1)} THEN 1::BIGINT << (place - {MARKS * k}) ELSE 0 END) AS m{k}" for k in each)
    merged = ", ".join(f"bit_or(m{k}) AS m{k}" for k in each)
    counted = " + ".join(f"bit_count(m{k})" for k in each)
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) AS t(template, label, base, grams, place, t1, t2, t3)),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT row, i - 1 AS i, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
v AS (SELECT row, template, label, base, grams, i - place AS diagonal, count(*) AS n, min(place) AS low, max(place) AS high, {marks}
  FROM e JOIN t ON w1 = t1 AND w2 = t2 AND w3 = t3 GROUP BY ALL),
g AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) AS step FROM v),
h AS (SELECT *, sum(CASE WHEN step <= {SLACK} THEN 0 ELSE 1 END) OVER (PARTITION BY row, template ORDER BY diagonal) AS grp FROM g),
s AS (SELECT row, template, label, base, grams, grp, {merged}, count(*) FILTER (n = grams) AS whole, min(diagonal) FILTER (n = grams) AS first, max(diagonal) FILTER (n = grams) AS final,
    min(diagonal + low) AS start, max(diagonal + high + {K}) AS stop FROM h GROUP BY ALL),
c AS (SELECT *, ({counted}) / grams AS cover FROM s),
k AS (SELECT *, CASE WHEN base THEN whole > 0 ELSE cover >= {COVER} AND (stop - start <= grams + {K - 1} + greatest({STRETCH}, grams // 8) OR whole > 0) END AS good FROM c),
m AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY row, base, good ORDER BY start, stop, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM k),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY row, base, good ORDER BY start, stop, template ROWS UNBOUNDED PRECEDING) AS cluster FROM m),
b AS (SELECT * REPLACE (good AND (base OR cover = max(cover) OVER (PARTITION BY row, base, good, cluster)) AS good) FROM n),
a AS (SELECT row, sum(CASE WHEN base THEN whole ELSE 0 END) AS n_base, min(first) FILTER (base) AS first_word, max(final) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good) AS labels, max(cover) FILTER (good) AS score FROM b GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (row)"""


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {"op4_license_scan": _oracle()}
