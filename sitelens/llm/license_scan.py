"""Licence paragraphs: a trained classifier, an unknown class, and confirmation by templates.

Learning: notices of each family (TEMPLATES), in full and in parts, against
paragraphs of NEGATIVE_DOCS documents (the ones with the smallest id hashes: a
bounded sample). The features are word pairs that occur in some template; a
multinomial logistic regression with an L1 share gives sparse weights.

Scanning: every line of every whole text, and lines that follow each other without
a blank one. Known word pairs, also those of a line's last word and the next one's
first, are found in one pass over the texts. What is known is summed per line; lines
without a known pair cannot be notices by themselves. The limit for a family's
probability is calibrated on the ordinary lines of all texts. A prediction stands if
the line also contains CONFIRM_SHARE of the word pairs of one of the family's
templates; one that is likely a notice but of no confirmed family is ``unknown``.
A notice that is wrapped stands if a window of REACH template lengths, over the ends
of lines, contains CONFIRM_SHARE of a template; its lines are not ``unknown`` then.

Defined results: a null or empty text has no paragraphs; rows alike in ``doc_id``
and text get the same answer, others are apart; ties between families go to the
first in alphabetical order; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.arrays import pairs_with_next, running_sum
from sitelens.session import written

#: Public notices by which works are licensed.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Copyright, all rights reserved. No part of this publication may be reproduced without permission"),
)
NONE, UNKNOWN = "none", "unknown"
NEGATIVE_DOCS = 300
CONFIRM_SHARE = 0.7
REACH = 1.5  # words over which a template may be spread, as a multiple of its length
APART = 100_000  # words that a blank line counts for: no window goes over one
LEAST_LIMIT, NEGATIVE_QUANTILE = 0.5, 0.999
BETWEEN = r"[^\p{L}\p{N}.]+|\.(?!\p{N})"
KEY = ["doc_id", "text_hash"]


def words_in(text: Column) -> Column:
    """Words of a text; what marks a comment is no word."""
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def all_pairs(words: Column) -> Column:
    """Pairs of neighbouring words, with marks for the ends of the paragraph."""
    marked = F.concat(F.array(F.lit("^")), words, F.array(F.lit("$")))
    return pairs_with_next(marked, lambda a, b: F.concat(a, F.lit(" "), b))


def word_pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring words, with marks for the ends of the paragraph."""
    return F.array_distinct(all_pairs(words_in(text)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, pairs) of every line with a word."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    lines = rows.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select(*KEY, "line_no", word_pairs(F.col("line")).alias("pairs")).filter(F.size("pairs") > 1)


def examples(spark: SparkSession) -> DataFrame:
    """(family, pairs): templates, their openings, and templates inside other words."""
    rows = []
    for family, text in TEMPLATES:
        words = text.split()
        rows += [(family, text)] * 3 + [(family, f"x {text} y"), (family, " ".join(words[:max(3, len(words) * 3 // 4)])),
                                        (family, f"copyright 2020 {text}")]
    return spark.createDataFrame(rows, "family string, text string").select("family", word_pairs(F.col("text")).alias("pairs"))


def inner(pairs: Column) -> Column:
    """The pairs without the marks of the ends."""
    return F.filter(pairs, lambda p: ~p.startswith("^ ") & ~p.endswith(" $"))


def template_pairs(spark: SparkSession) -> DataFrame:
    """(pair, family, template, size): as many rows as the templates have pairs."""
    rows = spark.createDataFrame([(f, i, t) for i, (f, t) in enumerate(TEMPLATES)], "family string, template int, text string")
    split = rows.select("family", "template", inner(word_pairs(F.col("text"))).alias("pairs"))
    return split.select("family", "template", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))


def may_be_notice(known: Column, size: Column) -> Column:
    """Whether a paragraph of the sample shares too much with the templates to stand for ordinary text."""
    return (F.size(inner(known)) >= 3) | ((F.size(inner(known)) > 0) & (2 * F.size(inner(known)) >= size))


class Model:
    """Families, and for each known pair its weight in every family."""

    def __init__(self, families: list[str], bias: list[float], weights: DataFrame):
        self.families, self.bias, self.weights = families, bias, weights


def fit(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    positive = examples(spark)
    vocabulary = [r.pair for r in positive.select(F.explode("pairs").alias("pair")).distinct().orderBy("pair").collect()]
    some = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(NEGATIVE_DOCS)
    known = F.array_intersect("pairs", F.array(*map(F.lit, vocabulary)))
    negative = paragraphs(some).filter(~may_be_notice(known, F.size(inner(F.col("pairs"))))).select(
        F.lit(NONE).alias("family"), "pairs")
    families = sorted({f for f, _ in TEMPLATES} | {NONE})
    rows = positive.unionByName(negative).withColumn(
        "label", (F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1).cast("double"))
    vector = CountVectorizerModel.from_vocabulary(vocabulary, "pairs", "features").setBinary(True)
    found = LogisticRegression(family="multinomial", maxIter=60, regParam=0.002, elasticNetParam=0.3).fit(vector.transform(rows))
    table = found.coefficientMatrix.toArray().T
    weights = spark.createDataFrame([(p, [float(x) for x in w]) for p, w in zip(vocabulary, table, strict=True)],
                                    "pair string, w array<double>")
    return Model(families, [float(x) for x in found.interceptVector], weights)


def known_pairs(docs: DataFrame, model: Model) -> DataFrame:
    """(key, line_no, size, at, pair, cross) of every pair of the model's table in any text, once for each line.

    ``at`` counts words from the start of the text, blank lines as APART. ``cross``
    pairs are made of the last word of a line and the first one of the next line.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.transform(F.split(text, "\n"), words_in).alias("words"))
    ends = rows.select(*KEY, "words", running_sum(F.transform("words", lambda w: F.when(
        F.size(w) == 0, APART).otherwise(F.size(w)).cast("bigint"))).alias("ends"))
    lines = ends.select(*KEY, F.posexplode(F.transform("words", lambda w, i: F.struct(
        w.alias("words"), F.get("ends", i).alias("end"), F.get(F.get("words", i + 1), F.lit(0)).alias("next")))).alias("line_no", "line"))
    full = lines.filter(F.size("line.words") > 0).select(
        *KEY, "line_no", (F.col("line.end") - F.size("line.words")).alias("start"), all_pairs(F.col("line.words")).alias("pairs"),
        F.concat(F.try_element_at("line.words", F.lit(-1)), F.lit(" "), F.col("line.next")).alias("bridge"))
    named = full.select(*KEY, "line_no", "start", F.size(inner(F.array_distinct("pairs"))).alias("size"),
                        F.concat("pairs", F.array("bridge")).alias("every"))
    each = named.select(*KEY, "line_no", "start", "size", F.size("every").alias("n"), F.posexplode("every").alias("place", "pair"))
    # as many rows as the templates have pairs
    met = each.join(F.broadcast(model.weights.select("pair")), "pair")
    return met.groupBy(*KEY, "line_no", "size", "pair", (F.col("place") == F.col("n") - 1).alias("cross")).agg(
        F.min(F.col("start") + F.col("place")).alias("at"))


def rated(known: DataFrame, model: Model) -> DataFrame:
    """Probabilities of the families of each line that has a known pair."""
    span, keys = range(len(model.families)), [*KEY, "line_no"]
    met = known.filter(~F.col("cross")).join(F.broadcast(model.weights), "pair")
    sums = met.groupBy(*keys).agg(*[F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in span], F.first("size").alias("size"),
                                  F.collect_set("pair").alias("known"))
    power = [F.exp(F.col(f"w{i}") + F.lit(model.bias[i])) for i in span]
    total = sum(power[1:], power[0])
    none = model.families.index(NONE)
    return sums.select(*keys, "known", "size", F.array(*[x / total for x in power]).alias("p")).withColumn(
        "notice", 1 - F.get("p", F.lit(none)))


def limit_of(ratings: DataFrame) -> float:
    """What a family's probability must reach: beyond nearly all ordinary paragraphs of all texts (a mergeable sketch)."""
    ordinary = ratings.filter(~may_be_notice(F.col("known"), F.col("size")))
    top = ordinary.agg(F.percentile_approx("notice", NEGATIVE_QUANTILE)).first()[0]
    return max(LEAST_LIMIT, min(float(top or 0.0), 0.95))


def same_text(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def wrapped(known: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, first, last, family, template, size, share) of notices that go over the ends of lines.

    Windows of REACH template lengths over the words of lines that follow each
    other; of windows on the same lines the one with the largest share stands.
    """
    text, reach = [*KEY, "template"], 1000
    met = known.join(F.broadcast(templates.withColumnRenamed("size", "of")), "pair")
    order = Window.partitionBy(*text).orderBy((F.col("at") * reach / F.col("of")).cast("bigint")).rangeBetween(0, int(REACH * reach))
    spans = met.select(*text, "family", "of", F.col("line_no").alias("first"), F.size(F.collect_set("pair").over(order)).alias("n"),
                       F.max(F.col("line_no") + F.col("cross").cast("int")).over(order).alias("last"),
                       F.max("cross").over(order).alias("bridged"), "at")
    good = spans.withColumn("share", F.col("n") / F.col("of")).filter(F.col("bridged") & (F.col("share") >= CONFIRM_SHARE))
    before = Window.partitionBy(*text).orderBy("first", "at").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("first") > F.max("last").over(before), F.lit(True)).cast("int")
    upto = Window.partitionBy(*text).orderBy("first", "at").rowsBetween(Window.unboundedPreceding, 0)
    islands = good.withColumn("new", new).withColumn("island", F.sum("new").over(upto))
    best = F.max_by(F.struct("first", "last", "share"), F.struct("share", F.col("first") - F.col("last")))
    found = written(islands.groupBy(*text, "family", "of", "island").agg(best.alias("w")).select(*text, "family", "of", "w.*"), "wrapped")
    x, y = found.alias("x"), found.alias("y")
    common = F.least("x.last", "y.last") - F.greatest("x.first", "y.first") + 1
    shorter = F.least(F.col("x.last") - F.col("x.first"), F.col("y.last") - F.col("y.first")) + 1
    rank = lambda t: F.struct(f"{t}.share", f"{t}.of", -F.col(f"{t}.template"))
    return x.join(y, same_text("x", "y") & (F.col("x.template") != F.col("y.template")) & (2 * common >= shorter) & (rank("x") < rank("y")),
                  "left_anti")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, family, probability and template share of every licence paragraph.

    A notice that goes over several lines stands at its first line, with the share as its probability.
    """
    model = fit(docs)
    known, none = written(known_pairs(docs, model), "known_pairs"), model.families.index(NONE)
    keys = [*KEY, "line_no"]
    ratings = rated(known, model)
    limit = limit_of(ratings)
    likely = ratings.filter(F.col("notice") >= limit)
    without = F.transform("p", lambda x, i: F.when(i == none, -1.0).otherwise(x))
    best = F.array_max("without")
    named = likely.withColumn("without", without).select(
        *keys, "known", "notice", best.alias("probability"),
        F.element_at(F.array(*map(F.lit, model.families)), F.array_position("without", best).cast("int")).alias("family"))
    named = written(named, "notices")
    templates = template_pairs(docs.sparkSession)
    shares = named.select(*keys, "family", F.explode("known").alias("pair")).join(
        F.broadcast(templates), ["family", "pair"]).groupBy(*keys, "template", "size").agg(F.count("*").alias("n")).groupBy(
        *keys).agg(F.max(F.col("n") / F.col("size")).alias("share")).select(
        *[F.col(k).alias(f"s_{k}") for k in keys], "share")
    out = named.join(shares, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys], "left")
    sure = (F.col("probability") >= limit) & (F.coalesce("share", F.lit(0.0)) >= CONFIRM_SHARE)
    single = written(out.select(*keys, F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
                                F.col("probability"), F.coalesce("share", F.lit(0.0)).alias("share")), "single_lines")
    over = written(wrapped(known, templates), "over_lines")
    within = same_text("s", "o") & F.col("s.line_no").between(F.col("o.first"), F.col("o.last"))
    # lines of a notice that goes on are not unknown ones; a family is told once for its lines
    alone = single.alias("s").join(over.alias("o"), within & (F.col("s.family") == UNKNOWN), "left_anti")
    more = over.alias("o").join(single.alias("s"), within & (F.col("s.family") == F.col("o.family")), "left_anti")
    return alone.unionByName(more.select(*KEY, F.col("first").alias("line_no"), "family", F.col("share").alias("probability"), "share"))


def per_document(docs: DataFrame) -> DataFrame:
    """doc_id, number of licence paragraphs, number of unknown ones, and the families of every row."""
    found = scan(docs).groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count_if(F.col("family") == UNKNOWN).alias("u"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ",").alias("f"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n", "u", "f")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    return rows.join(found, same, "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce("u", F.lit(0)).cast("bigint").alias("n_unknown"), F.coalesce("f", F.lit("")).alias("families"))
