"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are lines, and blocks of lines between blank ones, for notices that
are wrapped. A multinomial logistic regression over word bigrams and trigrams,
made sparse by an L1 penalty, gives each paragraph a probability for every
licence family and for "unknown". It is trained on the templates below, their
parts, and on ordinary paragraphs of the corpus (a bounded sample). The
probability from which a family is believed is set on all ordinary lines of the
corpus, so that no more than a set share of them would be taken for a licence.
A believed family is then compared with its templates, word bigram by word
bigram, and confirmed if one is mostly there.

Every weighted gram holds one of a few words, so a text or line without any of
these has the score of "unknown" and is passed over by plain substring tests;
n-grams are made of the other lines only. Everything runs as DataFrame
operations in the JVM.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, word_runs, words

#: Short notices by which texts name their licence, per family: fixed values.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache License 2.0."),
    "MIT": ("Released under the MIT License.", "This software is licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "BSD": ("Released under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
UNKNOWN = "unknown"
#: Documents whose paragraphs are the sample of ordinary ones (those with the smallest MD5 of their id), and paragraphs taken of all of these.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 400, 4000
#: Share of ordinary lines that may be taken for a licence; share of a template's bigrams that confirm it.
FALSE_SHARE, CONFIRM = 0.001, 0.6
#: A gram is a feature if it has a word of so many letters.
LONG_WORD = 6


def plain_words(paragraph: Column) -> Column:
    """Words of a paragraph in lower case without punctuation."""
    return words(F.regexp_replace(F.lower(paragraph), r"[^\p{L}\p{N}]+", " "))


def grams(paragraph: Column, low: int = 2, high: int = 3) -> Column:
    """Word n-grams of a paragraph in lower case without punctuation."""

    def of(ws: Column) -> Column:
        return F.array_distinct(F.concat(*[word_runs(ws, n) for n in range(low, high + 1)]))

    return let(plain_words(paragraph), of)


def features(paragraph: Column) -> Column:
    """The bigrams and trigrams that have a long word."""
    return F.filter(grams(paragraph), lambda g: g.rlike(f"[^ ]{{{LONG_WORD},}}"))


def _templates(docs: DataFrame) -> DataFrame:
    """``family, template, paragraph``: one row for each template."""
    rows = [{"family": k, "template": i, "paragraph": t} for k, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    spark = docs.sparkSession
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<family:string,template:int,paragraph:string>>")).alias("t")).select("t.*")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _holds_any(text: Column, stems: list[str]) -> Column:
    """Whether one of the words is part of the text in lower case."""
    if not stems:
        return F.lit(False)
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: reduce(or_, [low.contains(x) for x in stems]))


def needed_words(grams_: list[str], frequency: dict[str, int]) -> list[str]:
    """A few words of which every gram holds one: by turns the long word that is in
    most of the grams that are left for its frequency in ordinary text."""
    left, out = [set(w for w in g.split(" ") if len(w) >= LONG_WORD) for g in grams_], []
    while left:
        gain = Counter(w for g in left for w in g)
        out.append(max(sorted(gain), key=lambda w: gain[w] / (1 + frequency.get(w, 0))))
        left = [g for g in left if out[-1] not in g]
    return [w for w in out if not any(v != w and v in w for v in out)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_paragraphs: int = SAMPLE_PARAGRAPHS) -> tuple[DataFrame, list[float], list[str]]:
    """``weights(gram, by_family)`` of the grams that some family has a weight for,
    the biases, and words of which any gram with a weight holds one.
    ``by_family`` and the biases follow the order of ``families()``. What is
    gathered is bounded by the templates and the sample."""
    known = _templates(docs)
    # parts of templates are examples too: the first and second half, and two thirds
    ws = words(F.col("paragraph"))
    cuts = [(0.0, 1.0), (0.0, 0.5), (0.5, 1.0), (0.0, 0.67), (0.33, 1.0)]
    piece = lambda a, b: let(ws, lambda w: F.array_join(F.slice(w, (F.size(w) * a).cast("int") + 1, F.greatest(F.lit(2), F.ceil(F.size(w) * (b - a)).cast("int"))), " "))
    positive = known.select("family", F.explode(F.array(*[piece(a, b) for a, b in cuts])).alias("paragraph"))
    chosen = docs.where("doc_id is not null and text is not null").select("doc_id", "text").orderBy(F.md5(F.col("doc_id").cast("string")), "text").limit(sample_docs)
    ordinary = chosen.select("doc_id", F.posexplode(_lines(F.col("text"))).alias("paragraph_no", "paragraph")).where(F.col("paragraph").rlike(r"\p{L}"))
    ordinary = ordinary.orderBy(F.md5("paragraph"), "doc_id", "paragraph_no").limit(sample_paragraphs)
    ordinary = materialize(ordinary.where(~_telling(F.col("paragraph"), docs)).select("paragraph", features(F.col("paragraph")).alias("grams")))
    names = families()
    number = F.element_at(F.create_map(*[x for i, f in enumerate(names) for x in (F.lit(f), F.lit(float(i)))]), F.col("family"))
    examples = positive.select("family", features(F.col("paragraph")).alias("grams")).union(ordinary.select(F.lit(UNKNOWN), "grams")).withColumn("label", number)
    examples = materialize(examples.where(F.size("grams") > 0))
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=20000).fit(positive.select(features(F.col("paragraph")).alias("grams")))
    model = LogisticRegression(regParam=0.002, elasticNetParam=0.3, family="multinomial", maxIter=60).fit(vectors.transform(examples))
    coefficients = model.coefficientMatrix.toArray()
    rows = [{"gram": g, "by_family": coefficients[:, i].tolist()} for i, g in enumerate(vectors.vocabulary) if coefficients[:, i].any()]
    spark = docs.sparkSession
    weights = materialize(spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<gram:string,by_family:array<double>>>")).alias("w")).select("w.*"))
    bias = model.interceptVector.toArray().tolist()
    template_words = sorted({w for r in rows for w in r["gram"].split(" ")})
    seen = ordinary.select(F.explode(F.array_distinct(plain_words(F.col("paragraph")))).alias("w")).where(F.col("w").isin(template_words)).groupBy("w").count()
    return weights, bias, needed_words([r["gram"] for r in rows], {r["w"]: r["count"] for r in seen.collect()})  # the templates' words at most


def families() -> list[str]:
    return [UNKNOWN, *TEMPLATES]


def _telling(paragraph: Column, docs: DataFrame) -> Column:
    """Whether a paragraph has a trigram of a template, and so is not ordinary."""
    telling = _templates(docs).select(F.explode(grams(F.col("paragraph"), 3, 3)).alias("gram")).distinct().collect()  # fixed: the templates
    return F.arrays_overlap(grams(paragraph, 3, 3), F.array(*[F.lit(r["gram"]) for r in telling]))


def _scored(paragraphs: DataFrame, weights: DataFrame, bias: list[float]) -> DataFrame:
    """``id, family, probability`` of paragraphs ``(id, grams)`` that have a weighted
    gram. The others have the bias alone, which is "unknown"."""
    k = len(bias)
    hits = paragraphs.select("id", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")  # grams of the templates: fixed
    sums = hits.groupBy("id").agg(*[F.sum(F.get("by_family", F.lit(i))).alias(f"s{i}") for i in range(k)])
    logits = F.array(*[F.col(f"s{i}") + F.lit(bias[i]) for i in range(k)])
    top = F.array_max(F.array(*[F.struct((F.col(f"s{i}") + F.lit(bias[i])).alias("z"), F.lit(i).alias("i")) for i in range(k)]))
    total = F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top.z")))
    return sums.withColumn("top", top).withColumn("total", total).select("id", F.get(F.array(*map(F.lit, families())), F.col("top.i")).alias("family"), (1 / F.col("total")).alias("probability"))


def believed_from(ordinary: DataFrame, lines: int, false_share: float) -> float:
    """The smallest probability, in steps of 1/10,000 and 0.5 at least, that no more
    than ``false_share`` of ``lines`` reach, from ``ordinary(probability)``, the
    ordinary ones of them that are not "unknown"."""
    steps = ordinary.groupBy(F.floor(F.col("probability") * 10_000).alias("step")).count().orderBy(F.desc("step")).collect()  # 10,001 rows at most
    over = 0
    for r in steps:
        over += r["count"]
        if over > false_share * lines:
            return max(0.5, (r["step"] + 1) / 10_000)
    return 0.5


def scan_licenses(docs: DataFrame, false_share: float = FALSE_SHARE, confirm: float = CONFIRM, sample_docs: int = SAMPLE_DOCS, sample_paragraphs: int = SAMPLE_PARAGRAPHS) -> DataFrame:
    """``doc_id, unit, paragraph_no, family, probability, template_share, confirmed``
    for each paragraph of ``docs(doc_id, text)`` that is believed to name a licence.

    ``unit`` is "line", or "block" for lines between blank ones taken together,
    which count where no line of the text is confirmed to name that family;
    ``paragraph_no`` numbers the lines, or the blocks, of the text from 0. Null
    and empty texts and lines without a letter have no paragraphs. Rows are
    scanned one by one, so repeated rows give repeated findings, and rows with a
    null id are scanned like others. With an empty table nothing is trained on
    ordinary paragraphs and nothing is found. Other columns are not read.
    """
    weights, bias, stems = train(docs, sample_docs, sample_paragraphs)
    texts = docs.select("doc_id", "text").where(_holds_any(F.col("text"), stems)).withColumn("row", F.monotonically_increasing_id())
    blocks = F.filter(F.split(F.col("text"), r"\n(?:[ \t\r\f\x0B]*\n)+"), lambda b: b.contains("\n") & _holds_any(b, stems))
    numbered = F.transform(F.split(F.col("text"), r"\n(?:[ \t\r\f\x0B]*\n)+"), lambda b, i: F.struct(F.lit("block").alias("unit"), i.alias("no"), b.alias("paragraph")))
    lines = F.transform(_lines(F.col("text")), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("no"), x.alias("paragraph")))
    of_text = F.concat(lines, F.when(F.size(blocks) > 0, F.filter(numbered, lambda b: b["paragraph"].contains("\n"))).otherwise(F.array().cast("array<struct<unit:string,no:int,paragraph:string>>")))
    units = texts.select("doc_id", "row", F.explode(of_text).alias("u")).where(_holds_any(F.col("u.paragraph"), stems))
    units = materialize(units.select(F.struct("row", "u.unit", "u.no").alias("id"), "doc_id", "u.paragraph"))
    scored = _scored(units.select("id", features(F.col("paragraph")).alias("grams")), weights, bias).where(F.col("family") != UNKNOWN)
    found = materialize(scored.join(units, "id"))
    ordinary = found.where(F.col("id.unit") == "line").where(~_telling(F.col("paragraph"), docs))
    total = docs.agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "\n+"), "")).cast("long"))).first()[0] or 0
    found = found.where(F.col("probability") >= believed_from(ordinary.select("probability"), total, false_share))
    templates = _templates(docs).select("family", "template", grams(F.col("paragraph"), 2, 2).alias("t"))
    share = F.size(F.array_intersect("g", "t")).cast("double") / F.size("t")
    compared = found.select("doc_id", "id", "family", "probability", grams(F.col("paragraph"), 2, 2).alias("g")).join(F.broadcast(templates), "family")  # fixed
    out = compared.groupBy("doc_id", "id", "family", "probability").agg(F.max(share).alias("template_share")).withColumn("confirmed", F.col("template_share") >= confirm)
    out = materialize(out.withColumn("row", F.col("id.row")))
    # a block says nothing new where one of the text's lines is confirmed
    by_line = out.where("id.unit = 'line' and confirmed").select("row", "family").distinct()
    out = out.where("id.unit = 'line'").unionByName(out.where("id.unit = 'block'").join(by_line, ["row", "family"], "left_anti"))
    return out.select("doc_id", "id.unit", F.col("id.no").alias("paragraph_no"), "family", F.round("probability", 6).alias("probability"), F.round("template_share", 6).alias("template_share"), "confirmed")
