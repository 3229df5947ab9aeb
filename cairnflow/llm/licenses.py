"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by template comparison; DataFrame functions only.

A paragraph is a line; where no line alone is identified, a line joined with the next two is judged too, since notices are wrapped,
and counts for its first line. "Licence" is read as "license". Features are the words, word pairs and triples of the templates: the
canonical texts below, and phrases made of a licence's names and what stands before them. A paragraph without any of gates()
can't hold CONFIRM of a template's features, so it is passed over early and nothing is lost. A sparse (L1) multinomial logistic regression
is trained on the templates, parts of the canonical texts, sentences that name a licence's words without granting one, and all different
lines that aren't empty, labelled unknown unless they pass the gate and hold most of a template. Lines with equal features are one row with their
number. Those that pass the gate and those that don't weigh as much as BACKGROUND / 2 lines at most, each line of a half the same: the few that pass aren't
drowned. The cut on the best family's probability is at least 0.5, and at most 1 - CALIBRATED of the unknown lines' weight lies above it. A prediction counts if the paragraph holds at least CONFIRM of a template's features, and the template that it holds most of
(then the one with the most features) is of the predicted family: so versions are told apart.

Null and empty texts have no paragraphs. Very long texts and lines are judged whole. Rows are told apart by (doc_id, row key), so a
row's findings are its own even if its id is null or shared; repeated rows each get a row with equal findings. Ties between families
that hold equal shares and numbers of features go to the later name. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import durable, row_key

BACKGROUND, CALIBRATED, CONFIRM, JOINED, BINS = 4000, 0.999, 0.8, 3, 1024
#: Canonical texts by family.
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
]
#: A family's names; {v} stands for a version in VERSIONS.
NAMES = {
    "MIT": ["MIT License", "SPDX-License-Identifier: MIT"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
}
for _k, _n, _versions in (("GPL", "General", "23"), ("LGPL", "Lesser General", "3"), ("AGPL", "Affero General", "3")):
    for _v in _versions:
        NAMES[f"{_k}-{_v}.0"] = [form for x in (_v, f"{_v}.0") for form in (f"GNU {_n} Public License, version {x}", f"GNU {_n} Public License v{x}", f"{_k} version {x}", f"{_k} v{x}", f"{_k}v{x}", f"{_k}-{x}")]
#: What stands before a name in a notice, and sentences about licences that grant none.
LEADS = ("Licensed under the", "Released under the", "This work is licensed under the", "This program is licensed under the", "under the terms of the", "distributed under the", "SPDX-License-Identifier:", "License:")
OTHERS = ("Drivers must renew their license every year", "the license fee is due", "a fishing license is required", "a general public meeting about the license", "the public license office is closed", "his version of the story", "Permission is required to enter", "you may not use the pool except on Sundays", "copyright is a matter of law", "version 2 of the software is out", "released under the new name", "use in source and binary form is discussed", "the creative commons is a place", "the terms of the license are not known", "MIT is a university", "the Apache people")
#: A line with one of these counts as unknown if no family is found.
STEMS = ("license", "licence", "permission", "redistribut", "unencumbered", "copyright")
_ANCHOR = "licen[cs]e|permission|redistribut|unencumbered|copyright"
UNKNOWN = "unknown"


def _plain(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower().replace("licence", "license"))


def _grams(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def templates() -> list[tuple[str, str]]:
    """(family, text): the canonical texts, and every name as it is. Names are short, so what stands before them is left to the classifier."""
    return TEMPLATES + sorted({(family, name) for family, names in NAMES.items() for name in names})


def phrases() -> list[tuple[str, str]]:
    """(family, text) to train on: templates, parts of the canonical texts, names after each lead, and what grants nothing."""
    out = [*templates(), *((UNKNOWN, t) for t in OTHERS)]
    for family, text in TEMPLATES:
        words = text.split(" ")
        half = len(words) // 2
        out += [(family, " ".join(words[: half + 2])), (family, " ".join(words[half:]))]
    out += [(family, f"{lead} {name}") for family, names in NAMES.items() for name in names for lead in LEADS]
    return sorted(set(out))


@cache
def _template_grams() -> list[tuple[str, list[str]]]:
    return sorted({(family, tuple(_grams(_plain(text)))) for family, text in templates()})


@cache
def _vocabulary() -> list[str]:
    return sorted({g for _, text in templates() + [("", x) for x in LEADS] for g in _grams(_plain(text))})


@cache
def gates() -> list[str]:
    """STEMS, pairs of words, and the fewest (greedy, longest first) words such that the features of a template without any of them are less than CONFIRM of it."""
    out = [*STEMS, "cc by", "by nc", "by sa"]
    free = lambda own: [g for g in own if not any(f" {x}" in f" {g}" for x in out)]
    for _, own in sorted(_template_grams(), key=lambda x: (len(x[1]), x)):
        while len(left := free(own)) >= CONFIRM * len(own):
            out.append(max(sorted({w for g in left for w in g.split()}), key=lambda w: (not w.isdigit(), len(w) > 3 or len(own) < 12, min(len(w), 9), sum(w in g.split() for g in left))))
    return out


def _let(value: Column, of) -> Column:
    """of(value), the value computed once: a lambda's own argument, unlike an expression named in it, isn't computed for every element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def grams(text: Column) -> Column:
    """Distinct words, word pairs and triples of a text that the vocabulary has; linear in the text's length."""
    words = F.regexp_extract_all(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), F.lit("[a-z0-9]+"), F.lit(0))
    single = sorted({w for g in _vocabulary() for w in g.split()})

    def of(w: Column) -> Column:  # words that no template has are null, so that nothing is joined with them
        two = lambda x, i: x.isNotNull() & F.get(w, i + 1).isNotNull()
        pairs = F.transform(w, lambda x, i: F.when(two(x, i), F.concat_ws(" ", x, F.get(w, i + 1))))
        triples = F.transform(w, lambda x, i: F.when(two(x, i) & F.get(w, i + 2).isNotNull(), F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))))
        return F.array_distinct(F.filter(F.concat(w, pairs, triples), lambda x: x.isin(_vocabulary())))

    return _let(F.transform(words, lambda x: F.when(x.isin(single), x)), of)


def _passes(text: Column) -> Column:
    """Whether a word of the text begins with a gate."""
    return text.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(gates()).replace(" ", "[^a-z0-9]+") + ")")


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded table as one literal; no Python code runs in it."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("t")).select("t.*")


def confirmed(rows: DataFrame) -> DataFrame:
    """rows (key, grams) -> (key, share, family) of the template that a paragraph holds the largest share of, then the largest."""
    own = [{"template": i, "family": f, "n": float(len(g)), "own": g} for i, (f, g) in enumerate(_template_grams())]
    table = _table(rows.sparkSession, own, "template: int, family: string, n: double, own: array<string>").select("template", "family", "n", F.explode("own").alias("gram"))
    held = rows.select("key", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram").groupBy("key", "template", "family", "n").agg((F.count(F.lit(1)) / F.col("n")).alias("share"))
    return held.groupBy("key").agg(F.max(F.struct("share", "n", "family")).alias("x")).select("key", "x.share", F.col("x.family").alias("nearest"))


def background(docs: DataFrame) -> DataFrame:
    """(gated, grams, n): every different line of docs that isn't empty, those with equal features counted together. Lines with equal
    features are told apart by 128 bits of a hash, so texts aren't shuffled."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("text")).where("text <> ''")
    lines = lines.select(_passes(F.col("text")).alias("gated"), F.sort_array(grams(F.col("text"))).alias("grams"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))
    return lines.distinct().groupBy("gated", "grams").agg(F.count(F.lit(1)).alias("n"))


def weight_cut(rows: DataFrame, share: float, least: float) -> float:
    """The smallest p of rows (p, weight), p up to 1, such that at most 1 - share of all weight lies above it; at least `least`. Exact: a histogram
    tells the bin that holds it, the next one is of that bin, until a bin holds one value."""
    allowed, above, low, high = (1 - share) * (rows.agg(F.sum("weight")).first()[0] or 0.0), 0.0, least, 1.0
    rows = durable(rows.where(F.col("p") > least).select("p", "weight"))
    while True:
        place = F.least(F.floor((F.col("p") - low) / ((high - low) / BINS)), F.lit(BINS - 1)).alias("bin")
        for x in rows.where(F.col("p").between(low, high)).groupBy(place).agg(F.sum("weight").alias("w"), F.min("p").alias("low"), F.max("p").alias("high")).orderBy(F.desc("bin")).collect():
            if above + x.w > allowed:
                break
            above += x.w
        else:
            return low
        if x.low == x.high:
            return x.low
        low, high = x.low, x.high


class Classifier:
    def __init__(self, docs: DataFrame) -> None:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import CountVectorizerModel
        from pyspark.ml.functions import vector_to_array

        self.families = [UNKNOWN, *sorted({f for f, _ in templates()})]
        self.vectorizer = CountVectorizerModel.from_vocabulary(_vocabulary(), inputCol="grams", outputCol="features", minTF=1.0)
        number = F.array_position(F.array(*map(F.lit, self.families)), F.col("family")) - 1
        known = durable(_table(docs.sparkSession, [{"family": f, "text": t} for f, t in phrases()], "family: string, text: string").select("family", grams(F.col("text")).alias("grams"), F.lit(1.0).alias("weight")))
        lines = durable(background(docs).withColumn("key", F.monotonically_increasing_id()))
        number_of = {r.gated: r.n for r in lines.groupBy("gated").agg(F.sum("n").alias("n")).collect()}
        each = F.when(F.col("gated"), min(1.0, BACKGROUND / 2 / number_of.get(True, 1))).otherwise(min(1.0, BACKGROUND / 2 / number_of.get(False, 1)))
        lines = lines.join(confirmed(lines.where("gated")), "key", "left").select("grams", F.when(F.col("share") >= CONFIRM, F.col("nearest")).otherwise(UNKNOWN).alias("family"), (0.05 * each * F.col("n")).alias("weight"))
        lines = durable(lines.repartition(max(lines.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)))
        rows = known.unionByName(lines).withColumn("label", number.cast("double"))
        self.model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.0003, maxIter=60, weightCol="weight", standardization=False).fit(self.vectorizer.transform(rows))
        self.probability = vector_to_array
        self.cut = weight_cut(self.scored(lines.where(F.col("family") == UNKNOWN)), CALIBRATED, 0.5)

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (grams, ...) with the best family other than unknown and its probability."""
        out = self.model.transform(self.vectorizer.transform(rows))
        p = self.probability("probability")
        best = F.array_max(F.transform(F.slice(p, 2, len(self.families) - 1), lambda x, i: F.struct(x.alias("p"), i.alias("i"))))
        return out.withColumn("_best", best).withColumn("p", F.col("_best.p")).withColumn("predicted", F.element_at(F.array(*map(F.lit, self.families)), F.col("_best.i") + 2)).drop("features", "rawPrediction", "probability", "prediction", "_best")


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, row, line, family) of the paragraphs that are identified or hold an anchor word, once for rows that agree."""
    classifier = Classifier(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), text.alias("text")).where(_passes(F.col("text")))
    joined = lambda w: F.transform(w, lambda x, i: F.struct(i.alias("line"), x.alias("one"), F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, JOINED))).alias("three")))
    near = F.filter(_let(F.split("text", "\n"), joined), lambda x: _passes(x["three"]))
    lines = rows.select("doc_id", "row", F.explode(near).alias("x")).distinct()
    lines = lines.select("doc_id", "row", "x.line", F.lower("x.one").rlike(_ANCHOR).alias("anchored"), F.explode(F.array(F.struct(F.lit(1).alias("size"), F.col("x.one").alias("text")), F.struct(F.lit(JOINED).alias("size"), F.col("x.three").alias("text")))).alias("y"))
    lines = durable(lines.select("doc_id", "row", "line", "anchored", "y.size", grams(F.col("y.text")).alias("grams"), F.xxhash64("doc_id", F.lit("|"), "row", "line", "y.size").alias("key")))
    scored = classifier.scored(lines.where(F.size("grams") > 0)).join(confirmed(lines), "key")
    sure = scored.where((F.col("p") >= classifier.cut) & (F.col("share") >= CONFIRM) & (F.col("nearest") == F.col("predicted"))).select("key", F.col("predicted").alias("family"))
    judged = lines.drop("grams").join(sure, "key", "left")
    judged = judged.groupBy("doc_id", "row", "line").agg(F.max(F.when(F.col("size") == 1, F.col("family"))).alias("one"), F.max(F.when(F.col("size") == JOINED, F.col("family"))).alias("three"), F.max("anchored").alias("anchored"))

    # a wrapped notice counts at its last line that can begin it, if none of its lines is identified alone; windows of a few lines within a row
    ordered = W.partitionBy("doc_id", "row").orderBy("line")
    after, before = ordered.rangeBetween(1, JOINED - 1), ordered.rangeBetween(1 - JOINED, 0)
    may = F.col("one").isNull() & F.col("three").isNotNull()
    judged = judged.withColumn("alone_after", F.max(F.col("one").isNotNull()).over(after)).withColumn("same_after", F.array_contains(F.collect_set(F.when(may, F.col("three"))).over(after), F.col("three")))
    judged = judged.withColumn("wrapped", may & ~F.coalesce("alone_after", F.lit(False)) & ~F.coalesce("same_after", F.lit(False)))
    judged = judged.withColumn("inside", F.max("wrapped").over(before))
    family = F.when(F.col("one").isNotNull(), F.col("one")).when(F.col("wrapped"), F.col("three")).when(F.col("anchored") & ~F.col("inside"), UNKNOWN)
    return judged.select("doc_id", "row", "line", family.alias("family")).where(F.col("family").isNotNull())


def license_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_licenses (paragraphs identified), n_unknown (with an anchor word but none identified), families, found (line:family)."""
    found = license_paragraphs(docs).groupBy(F.col("doc_id").alias("id"), "row").agg(F.array_sort(F.collect_list(F.struct("line", "family"))).alias("all"))
    sure = F.filter("all", lambda x: x["family"] != UNKNOWN)
    found = found.select("id", "row", F.size(sure).cast("long").alias("n"), (F.size("all") - F.size(sure)).cast("long").alias("m"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("f"), F.array_join(F.transform(sure, lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["family"])), ",").alias("at"))
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("r"))
    out = rows.join(found, (F.col("r") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_licenses"), F.coalesce("m", F.lit(0)).alias("n_unknown"), F.coalesce("f", F.lit("")).alias("families"), F.coalesce("at", F.lit("")).alias("found"))
