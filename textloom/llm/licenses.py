"""Licence scans by a trained paragraph classifier (DataFrame functions and the DataFrame machine-learning API only).

A paragraph (line) becomes its sparse word n-grams (one to three words) that hold at least one licence word, and a
multinomial logistic regression gives each licence family and the class "unknown" a probability. The model is
trained on the template sentences below, on shortened variants of them, and on the corpus's own paragraphs that name
licence words without resembling a template, each distinct one once. A family is predicted only above a level that is
calibrated on the fourth of these paragraphs that is kept out of training, and each prediction is confirmed by
comparing the paragraph with the templates of the predicted family.

A paragraph without a licence word has no features, so its class is unknown by construction; such paragraphs are
passed over by one pattern match, which changes no result.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents, materialise

# Usual statements of the licence families.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation; version 2 of the License.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
                "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal",
            "Released into the public domain under CC0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
#: Words of which a feature has to hold one.
LICENCE_WORDS = (
    "license", "licensed", "licence", "licenced", "copyright", "copyrighted", "apache", "mit", "gnu", "gpl", "lgpl", "agpl", "affero", "lesser",
    "bsd", "clause", "mozilla", "mpl", "cc", "cc0", "creative", "commons", "noncommercial", "sharealike", "attribution", "spdx", "redistribute",
    "redistribution", "permission", "granted", "rights", "reserved", "waived", "unauthorized", "prohibited", "public", "domain", "permitted", "released",
)
UNKNOWN = "unknown"
FEATURES = 1 << 12
#: Corpus paragraphs that weigh one template sentence each at most, together; one in KEPT_OUT is kept out for calibration.
BACKGROUND, KEPT_OUT = 4000, 4
#: Least agreement with a template, and training rows per task.
CONFIRMED, PER_TASK = 0.6, 1 << 14
#: Longest stretch of words that one prediction looks at; longer paragraphs are looked at in overlapping stretches.
STRETCH = 60


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _pattern() -> str:
    return r"(?i)(?<![a-z0-9])(" + "|".join(LICENCE_WORDS) + r")(?![a-z0-9])"


def grams(w: Column) -> Column:
    """Words, word pairs and triples that hold a licence word."""
    known = F.array(*[F.lit(x) for x in LICENCE_WORDS])
    n = F.size(w)
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array(
        *[F.when(i + k <= n, F.slice(w, i + 1, k)) for k in (1, 2, 3)]))
    held = F.filter(F.flatten(stretches), lambda g: g.isNotNull() & F.arrays_overlap(g, known))
    return F.transform(held, lambda g: F.array_join(g, " "))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, stretch, words)`` of the paragraphs with a licence word.

    Documents without one are filtered before their text is split. A long paragraph gives stretches of ``STRETCH``
    words that overlap by half, so no statement is cut in all of them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(_pattern()))
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).filter(F.col("line").rlike(_pattern()))
    lines = lines.withColumn("w", words(F.col("line")))
    half = STRETCH // 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - half) / F.lit(half)) - 1, F.lit(0)).cast("int"))
    return (lines.select("doc_id", "paragraph", "w", F.explode(starts).alias("stretch"))
            .select("doc_id", "paragraph", "stretch", F.slice("w", F.col("stretch") * half + 1, STRETCH).alias("words")))


def found_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``paragraphs`` with their ``likeness`` to the templates and ``features``, written once: training and prediction read it."""
    rows = materialise(paragraphs(docs, id_col, text_col).withColumn("bag", _bag(F.col("words"))), "licence-paragraphs")
    return materialise(_vectors(resemblance(rows)).drop("grams"), "licence-likeness")


def template_words() -> list[tuple[str, list[str]]]:
    """``(family, words)`` of each template: a fixed, short list."""
    return [(f, [w for w in re.split("[^a-z0-9]+", t.lower()) if w]) for f, texts in TEMPLATES.items() for t in texts]


def _bag(w: Column) -> Column:
    """Distinct words and word pairs."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.array_union(w, pairs)


def resemblance(stretches: DataFrame) -> DataFrame:
    """``stretches`` with ``likeness``: per family the best share of a template's words and word pairs that a stretch holds."""
    best: dict[str, list[Column]] = {}
    for family, w in template_words():
        bag = list(dict.fromkeys([*w, *map(" ".join, zip(w, w[1:]))]))
        held = F.size(F.array_intersect(F.col("bag"), F.split(F.lit("|".join(bag)), "[|]")))
        best.setdefault(family, [F.lit(0.0)]).append(held / F.lit(float(len(bag))))
    out = [F.struct(F.lit(f).alias("family"), F.greatest(*c).alias("agreement")) for f, c in best.items()]
    return stretches.withColumn("likeness", F.array(*out)).drop("bag")


def _best(likeness: Column) -> Column:
    return F.array_max(F.transform(likeness, lambda x: x["agreement"]))


class LicenceModel:
    """Fitted classifier with its calibrated level."""

    def __init__(self, model: LogisticRegressionModel, names: list[str], level: float):
        self.model, self.names, self.level = model, names, level


def _vectors(df: DataFrame) -> DataFrame:
    tf = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    return tf.transform(df.withColumn("grams", grams(F.col("words"))))


def _probabilities(df: DataFrame, model: LogisticRegressionModel, names: list[str]) -> DataFrame:
    p = vector_to_array("probability")
    scored = model.transform(df).withColumn("p", p)
    best = F.array_max(F.transform("p", lambda x, i: F.struct(x.alias("p"), i.alias("i"))))
    return (scored.withColumn("best", best).withColumn("predicted", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("best.i") + 1))
            .withColumn("p_best", F.col("best.p")).drop("features", "rawPrediction", "probability", "prediction", "p", "best"))


def train(spark: SparkSession, found: DataFrame) -> LicenceModel:
    """Fit on templates, variants of them, and the distinct stretches of ``found`` that resemble no template.

    All of these stretches count; where they are more than ``BACKGROUND`` they share its weight, so that the few
    sentences of the families keep theirs.
    """
    names = [UNKNOWN, *TEMPLATES]
    shape = spark.createDataFrame(template_words(), "family string, words array<string>")
    label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")) - 1
    # variants: the whole sentence, without its first or last quarter, and each with a common lead
    quarter = F.floor(F.size("words") / 4).cast("int")
    cut = F.array(F.col("words"), F.slice("words", quarter + 1, F.size("words") - quarter), F.slice("words", F.lit(1), F.size("words") - quarter))
    variants = shape.select(label.cast("double").alias("label"), F.explode(cut).alias("words"))
    lead = F.array(F.lit("this"), F.lit("file"), F.lit("is"))
    variants = variants.unionByName(variants.select("label", F.concat(lead, F.col("words")).alias("words"))).withColumn("weight", F.lit(1.0))
    # what resembles no template is unknown
    mark = F.xxhash64(F.array_join("words", " "))
    other = found.filter(_best(F.col("likeness")) < 0.5).select(mark.alias("mark"), "features").dropDuplicates(["mark"])
    other = materialise(other.repartition("mark").sortWithinPartitions("mark"), "licence-background")
    n = other.count()
    plain = other.filter(F.pmod("mark", F.lit(KEPT_OUT)) != 0).select(
        F.lit(0.0).alias("label"), F.lit(min(1.0, BACKGROUND / max(1, n))).alias("weight"), "features")
    # single words of the templates, and no features at all, are unknown as well
    single = shape.select(F.explode("words").alias("w")).distinct().select(F.lit(0.0).alias("label"), F.array("w").alias("words"), F.lit(1.0).alias("weight"))
    empty = spark.range(1).select(F.lit(0.0).alias("label"), F.array(F.lit("")).alias("words"), F.lit(20.0).alias("weight"))
    families, rest = (_vectors(x).select("label", "weight", "features").coalesce(1) for x in (variants, single.unionByName(empty)))
    data = families.unionByName(plain).unionByName(rest).coalesce(1 + n // PER_TASK)
    model = LogisticRegression(family="multinomial", regParam=1e-5, elasticNetParam=0.1, maxIter=50, weightCol="weight").fit(data)
    # level: what no kept-out stretch of the background reaches, halfway to certainty, and 0.5 at least
    kept_out = _probabilities(other.filter(F.pmod("mark", F.lit(KEPT_OUT)) == 0), model, names)
    top = kept_out.filter(F.col("predicted") != UNKNOWN).agg(F.max("p_best").alias("p")).first().p
    level = 0.5 if top is None else max(0.5, min(0.95, (1 + top) / 2))
    return LicenceModel(model, names, level)


def predict(found: DataFrame, model: LicenceModel) -> DataFrame:
    """``doc_id, paragraph, family, probability, agreement, confirmed``: the best stretch of each paragraph with a known family."""
    scored = _probabilities(found, model.model, model.names)
    known = scored.filter((F.col("predicted") != UNKNOWN) & (F.col("p_best") >= model.level))
    own = F.element_at(F.transform(F.filter("likeness", lambda x: x["family"] == F.col("predicted")), lambda x: x["agreement"]), 1)
    known = known.select("doc_id", "paragraph", F.col("predicted").alias("family"), F.col("p_best").alias("probability"), own.alias("agreement"))
    best = known.groupBy("doc_id", "paragraph").agg(F.max(F.struct("agreement", "probability", "family")).alias("b"))
    return best.select("doc_id", "paragraph", "b.family", "b.probability", "b.agreement", (F.col("b.agreement") >= CONFIRMED).alias("confirmed"))


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence statements of ``docs``: one row per paragraph that the classifier gives to a known family.

    Columns ``doc_id, paragraph (from 0), family, probability, agreement, confirmed``. Paragraphs are lines; null
    and empty texts have none. Rows with a null id are scanned like others; the statements of rows that repeat an id
    are reported under that id, per paragraph the one that agrees best. Other columns are ignored. An empty table
    gives an empty result.
    """
    found = found_paragraphs(docs, id_col, text_col)
    return predict(found, train(docs.sparkSession, found))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of the whole ``documents`` table: one row per document."""
    docs = documents(spark, sf_dir)
    found = licence_paragraphs(docs).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licences"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("confirmed"), F.col("family")))), ",").alias("unconfirmed"),
        F.count("*").alias("n_statements"), F.max("probability").alias("probability"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_statements", F.lit(0)).alias("n_statements"), F.coalesce("licences", F.lit("")).alias("licences"),
                      F.coalesce("unconfirmed", F.lit("")).alias("unconfirmed"), "probability")
