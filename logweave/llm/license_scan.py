"""Licence scan: a trained paragraph classifier over sparse word n-grams.

Trained here, with Spark ML's multinomial logistic regression. Its labelled rows are the names of the families' licences in
common phrases, sentences of their long forms, names and talk of no listed family (``unknown``), and ordinary uses of such
words (``none``): some fixed sentences and all paragraphs and lines of the corpus, of distinct texts, that hold
words of the notices without being licence talk; the fixed ones under seeded changes (words other than
names dropped, words around them). Features are n-grams of one to three lower-case words with a telling word in them. Telling
words come from the data: words of the notices that at most a share RARE of the corpus's distinct lines without TALK has (of a
long form the LONG_WORDS rarest), and of every notice its rarest, so that each notice can be found. A paragraph without a
telling word has no feature and is ``none`` without being scored. The corpus's rows with the same
n-grams are one weighted row, and together they weigh no more than NEGATIVES fixed ones, so that a large corpus does not
outweigh the notices. The model is a table of weights of the n-grams that the fixed rows or a share COMMON of the corpus's
rows have, so its size is bounded, whatever the corpus.

``unknown`` is calibrated by cross-validation: in each of FOLDS folds a third of the phrases (with all names in them), of the
changes to long forms and of the unlisted licences' names, and all notices of some families are left out of training. A name
or a long form that training has never seen cannot be told, so these are left out only in other phrases and changes. The
limit is the probability at which the share of left-out notices of known families that are accepted as their family, and the
share of families and names not seen in training that fall below it, are largest together; a prediction below it counts as
unknown. A predicted family is confirmed if the paragraph has at least CONFIRM of the two-word sequences of one of the
family's names or long forms (of a name of one word, the word).

Paragraphs are what lies between lines without a letter or number, so that wrapped notices and comments are whole; as many
texts have no blank lines, each line of a paragraph is scanned by itself as well.

Defined results: null, empty or blank text has no paragraph and finds ``none``; repeated rows give a row each; ties of
paragraphs go to the earlier one; an empty table trains on the fixed rows alone and gives an empty result; further columns
are ignored. Only DataFrame functions and Spark ML (JVM) are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Names of the families' licences, SPDX identifiers last.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License, Version 2.0 (the License)", "Apache 2.0 license", "Apache Software License 2.0", "Apache-2.0"),
    "mit": ("MIT License", "MIT License (MIT)", "MIT/X11 license", "MIT-style license", "Expat License", "MIT"),
    "gpl-3.0": (
        "GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License version 3 (GPLv3)", "GNU GPL v3", "GNU GPL version 3 or later", "GPLv3",
        "GPL-3.0-only", "GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License version 2 (GPLv2)", "GNU GPL v2", "GNU GPL version 2 or later", "GPLv2",
        "GPL-2.0-only", "GPL-2.0-or-later",
    ),
    "lgpl": (
        "GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3.0", "GNU LGPL version 3", "GNU Library General Public License", "LGPL",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    ),
    "agpl-3.0": (
        "GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0 (AGPL)", "GNU AGPL version 3", "AGPLv3",
        "AGPL-3.0-only", "AGPL-3.0-or-later",
    ),
    "bsd": (
        "BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-style license", "New BSD License", "Simplified BSD License", "modified BSD license",
        "BSD-3-Clause", "BSD-2-Clause",
    ),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0 (MPL)", "MPL 2.0", "MPL-2.0"),
    "cc-by-4.0": (
        "CC BY 4.0", "CC BY 4.0 license", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 license (CC BY 4.0)", "Creative Commons Attribution License",
        "CC-BY-4.0",
    ),
    "cc-by-sa-4.0": (
        "CC BY-SA 4.0", "CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 license (CC BY-SA 4.0)",
        "Creative Commons Attribution-ShareAlike License", "CC-BY-SA-4.0",
    ),
    "cc-by-nc-4.0": (
        "CC BY-NC 4.0", "CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 license (CC BY-NC 4.0)",
        "Creative Commons Attribution-NonCommercial License", "CC-BY-NC-4.0",
    ),
    "cc0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero", "CC0-1.0"),
}
#: Names of licences of no listed family.
OTHER_NAMES = (
    "Example Source License", "Sample Community License 1.1", "ISC License", "zlib License", "Boost Software License, Version 1.0", "Eclipse Public License 2.0", "EPL-2.0",
    "Artistic License 2.0", "European Union Public Licence 1.2", "Microsoft Public License", "Python Software Foundation License", "Academic Free License v3.0",
    "SIL Open Font License, Version 1.1", "Open Database License", "Common Development and Distribution License 1.0", "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC BY-ND 4.0", "Do What The Fuck You Want To Public License", "Server Side Public License v1", "Business Source License 1.1", "PostgreSQL License", "license of its publisher, version 7",
    "PHP License, version 3.01", "Apache Software License, Version 1.1", "Unlicense", "own terms of its author", "proprietary license of the company",
)
#: Sentences that name a licence.
PHRASES = (
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "This work is licensed under a {}.",
    "This project is released under the terms of the {}.",
    "This software is licensed under the {}, see the LICENSE file.",
    "The {}, see the file COPYING for the full text.",
    "The code is available under the {}; see LICENSE for details.",
    "You can redistribute it and/or modify it under the terms of the {}.",
    "Text available under the {}.",
    "License: {}",
    "SPDX-License-Identifier: {}",
)
#: Sentences of the licences' long forms and headers.
LONG: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed to the Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "either version 2 of the GNU General Public License, or (at your option) any later version.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library; see the file COPYING.LESSER.",
    ),
    "agpl-3.0": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org.",
    ),
    "cc-by-4.0": ("This article is published under CC BY 4.0, a Creative Commons Attribution license, which permits use with credit to the author.",),
    "cc-by-sa-4.0": ("This article is published under CC BY-SA 4.0, a Creative Commons Attribution-ShareAlike license, which permits use with credit under the same license.",),
    "cc-by-nc-4.0": ("This article is published under CC BY-NC 4.0, a Creative Commons Attribution-NonCommercial license, which permits noncommercial use with credit.",),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights (CC0).",
    ),
}
#: Licence talk of no listed family.
UNLISTED = (
    "This work is licensed under its own terms; all rights reserved.",
    "Released under a proprietary license, see the file LICENSE.",
    "Copyright reserved, no permission is granted to copy this software.",
    "All rights reserved.",
    "Copyright by the publisher. All rights reserved.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This software is provided as is, without any express or implied warranty; permission is granted to anyone to use it for any purpose, including commercial applications",
    "Permission is granted to make and distribute verbatim copies of this manual provided the copyright notice is preserved on all copies",
    "This is free and unencumbered software released into the public domain.",
    "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty",
    "No part of this publication may be reproduced without prior written permission of the publisher.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed",
)
#: Ordinary sentences with words that notices have.
ORDINARY = (
    "The film was released in May and distributed free of charge in all public cinemas of the country.",
    "Permission to enter the building was granted to any person with a copy of the letter.",
    "You may use the room under the following conditions, and children are permitted with or without their parents.",
    "The public work on the general plan is subject to change, and the source of the river is not known.",
    "A copy of the file was sent to the author, who has all the rights to the software of the first version.",
    "The international community met in public under the terms of the treaty, version 2 of which is open.",
    "He waived his rights and the law of the state was met to the extent possible.",
    "The library is open to the public and free software courses are given in binary and source code.",
    "The foundation sells licenses for fishing; the license costs 4.0 euros for each person.",
    "Redistribution of income and the forms of its use are associated with modification of the general law.",
    "The car license was released late, and the commons are used under the common law by attribution of land.",
    "The affero and lesser roads of the project see general traffic, and documentation is provided in later versions.",
)
NONE, UNKNOWN = "none", "unknown"
#: What the corpus's ordinary texts weigh together at most, in fixed rows; all of them count.
NEGATIVES = 2_000
#: N-grams of the corpus that are features besides those of the fixed rows: what this share of its ordinary texts has.
COMMON = 0.001
#: Labelled rows that a task takes in training.
FIT_ROWS = 50_000
#: Variants of a sentence that names a licence, and of any other text.
VARIANTS = (3, 18)
FOLDS = 3
RARE = 0.0005
#: Telling words of a long form at most; one is always taken.
LONG_WORDS = 4
CONFIRM = 0.6
#: A paragraph of licence words without TALK that shares less than this with every notice is an ordinary one.
APART = 0.2
TALK = r"(?i)licen[cs]|copyright|rights\s+reserved"
GRAMS = (1, 2, 3)
ROUNDS = 60
SEED = 17


def _words(text: Column) -> Column:
    """Lower-case words and numbers of a paragraph; version numbers and hyphenated names stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _grams(words: Column, n: int) -> Column:
    def spans(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<string>"))

    return _bound(words, spans)


def _overlap(text: Column, notices: Column) -> Column:
    """The largest share of a notice's sequences that the text has."""
    return _bound(_bound(_words(text), lambda w: F.concat(w, _grams(w, 2))), lambda own: F.array_max(F.transform(notices, lambda t: F.size(F.array_intersect(t, own)) / F.size(t))))


def _rows(spark: SparkSession) -> DataFrame:
    """Fixed labelled texts ``family, template, nth, name, text``: each name in each phrase ({} in the text; nth of the
    phrases, for unlisted licences of the names), long forms, unlisted talk and ordinary uses (nth null: by variant)."""
    spdx = PHRASES[-1]
    rows: list[tuple] = []
    for family, names in {**NAMES, UNKNOWN: OTHER_NAMES}.items():
        for k, name in enumerate(names):
            rows += [(family, k if family == UNKNOWN else n, name, p) for n, p in enumerate(PHRASES) if p != spdx or " " not in name]
    for family, texts in {**LONG, UNKNOWN: UNLISTED, NONE: ORDINARY}.items():
        rows += [(family, n if family == UNKNOWN else None, "", t) for n, t in enumerate(texts)]
    return spark.createDataFrame([(f, i, *x) for i, (f, *x) in enumerate(rows)], "family string, template int, nth int, name string, text string")


def _notices(spark: SparkSession, family: str = "family") -> DataFrame:
    """What a text is compared with: ``family, notices``, the two-word sequences of the family's names (the word itself where
    it is one) and long forms."""
    texts = [(f, t) for f in NAMES for t in (*NAMES[f], *LONG[f])]
    rows = spark.createDataFrame(texts, "family string, text string").withColumn("w", _words(F.col("text")))
    grams = F.when(F.size("w") > 1, _grams(F.col("w"), 2)).otherwise(F.col("w"))
    return rows.groupBy(F.col("family").alias(family)).agg(F.collect_list(F.array_distinct(grams)).alias("notices"))


def _blocks(text: Column) -> Column:
    """Texts between lines without a letter or number, which is what separates paragraphs in comments too."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?im)^[^\S\n]*(?:dnl|rem)\b", ""), r"\n[^\p{L}\p{N}\n]*\n")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs, and each line of those of several lines: ``doc_id, paragraph, whole, line, text``."""
    blocks = docs.select("doc_id", _blocks(F.col("text")).alias("b"))
    n_lines = F.transform("b", lambda x: F.size(F.split(x, "\n")) + 1)
    starts = F.aggregate(n_lines, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = blocks.select("doc_id", F.posexplode(F.arrays_zip(F.col("b").alias("text"), F.slice(starts, 1, F.size("b")).alias("start"))).alias("paragraph", "p"))
    rows = rows.select("doc_id", "paragraph", F.col("p.text").alias("text"), F.col("p.start").alias("start"), F.split("p.text", "\n").alias("lines"))
    blank = F.size(F.split(F.regexp_extract("text", r"^[^\p{L}\p{N}]*", 0), "\n")) - 1
    whole = F.struct(F.lit(True).alias("whole"), (F.col("start") + blank).alias("line"), F.col("text").alias("text"))
    single = F.transform("lines", lambda x, i: F.struct(F.lit(False).alias("whole"), (F.col("start") + i).alias("line"), x.alias("text")))
    pieces = F.when(F.size("lines") > 1, F.concat(F.array(whole), single)).otherwise(F.array(whole))
    return rows.select("doc_id", "paragraph", F.inline(pieces)).filter(F.col("text").rlike(common.WORD))


def ordinary_use(docs: DataFrame, words: list[str]) -> DataFrame:
    """``word, n``: the distinct lines of the corpus without TALK that have each of the words; of '' all these lines."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("text")).filter(F.col("text").rlike(common.WORD) & ~F.col("text").rlike(TALK))
    held = F.array_sort(F.array_distinct(F.filter(_words(F.col("text")), lambda w: w.isin(words))))
    distinct = lines.select(F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(SEED), "text").alias("d2"), held.alias("held")).distinct()
    return distinct.select(F.explode(F.concat(F.array(F.lit("")), F.col("held"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def telling_words(docs: DataFrame) -> list[str]:
    """Words of the notices that few of the corpus's ordinary lines have, and of each notice its rarest."""
    spark = docs.sparkSession
    words = _rows(spark).filter(F.col("family") != NONE).select("template", "name", F.explode(F.array_distinct(_words(F.replace("text", F.lit("{}"), F.col("name"))))).alias("word"))
    words = words.filter(F.length("word") > 1)
    used = common.stage(ordinary_use(docs, [r["word"] for r in words.select("word").distinct().collect()]), "ordinary")  # bounded by the fixed rows
    total = max(sum(r["n"] for r in used.filter("word = ''").collect()), 1)
    words = words.join(F.broadcast(used), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("template").orderBy("n", F.desc(F.length("word")), "word"))
    few = (F.col("n") <= RARE * total) & ((F.col("name") != "") | (F.col("rank") <= LONG_WORDS))
    found = words.withColumn("rank", rank).filter((F.col("rank") == 1) | few)
    return sorted(r["word"] for r in found.select("word").distinct().collect())


def _listed(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _tells(words: list[str]) -> Column:
    return F.exists(_words(F.col("text")), lambda w: w.isin(words))


def _named(docs: DataFrame, words: list[str]) -> DataFrame:
    """Paragraphs and lines with telling words, with their n-grams."""
    return common.stage(_features(paragraphs(docs).filter(_tells(words)), words), "named")


def _negatives(named: DataFrame, fixed: DataFrame) -> DataFrame:
    """``grams, texts``: the n-grams that the fixed rows or enough of the corpus have, of all distinct texts that use telling
    words without being licence talk, and the number of texts that have the same ones."""
    texts = named.filter(~F.col("text").rlike(TALK)).groupBy("text").agg(F.first("grams").alias("grams"))  # of the text alone
    notices = _notices(named.sparkSession).select(F.explode("notices").alias("pairs")).filter(F.get("pairs", F.lit(0)).contains(" ")).agg(F.collect_list("pairs").alias("notices"))
    texts = texts.crossJoin(F.broadcast(notices)).filter(_overlap(F.col("text"), F.col("notices")) < APART)  # one row of notices
    texts = common.stage(texts.select(F.monotonically_increasing_id().alias("id"), "grams"), "ordinary-texts")
    grams = common.stage(texts.select("id", F.explode("grams").alias("gram")), "ordinary-grams")
    few = math.ceil(COMMON * texts.count())
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= few).select("gram")
    kept = common.stage(often.unionByName(fixed.select(F.explode("grams").alias("gram"))).distinct(), "features")
    sets = grams.join(F.broadcast(kept), "gram").groupBy("id").agg(F.array_sort(F.collect_list("gram")).alias("grams"))  # bounded by the share
    return sets.groupBy("grams").agg(F.count(F.lit(1)).alias("texts"))


def _features(rows: DataFrame, words: list[str]) -> DataFrame:
    """``rows`` with ``grams``: their n-grams that hold a telling word, made around the places of these words."""

    def around(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(words), i)), lambda i: i.isNotNull())

        def grams(i: Column) -> Column:
            made = []
            for n in GRAMS:
                low, high = F.greatest(i - (n - 1), F.lit(0)), F.least(i, F.size(w) - n)
                found = F.transform(F.sequence(low, F.greatest(low, high)), lambda k: F.array_join(F.slice(w, k + 1, n), " "))  # noqa: B023  called at once
                made.append(F.when(low <= high, found).otherwise(F.array().cast("array<string>")))
            return F.concat(*made)

        return F.array_distinct(F.flatten(F.transform(places, grams)))

    return rows.withColumn("grams", _bound(_words(F.col("text")), around))


def labelled(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows to learn from, ``family, template, nth, grams, texts, weight``, and the telling words."""
    words = telling_words(docs)
    return _labelled(_named(docs, words), words), words


def _labelled(named: DataFrame, words: list[str]) -> DataFrame:
    spark = named.sparkSession
    # variants: a text with words dropped by a seeded hash, between scraps of ordinary sentences
    last = F.when(F.col("name") != "", VARIANTS[0]).otherwise(VARIANTS[1]) - 1
    varied = _rows(spark).withColumn("v", F.explode(F.sequence(F.lit(0), last)))
    kept = F.filter(F.split("text", " "), lambda w, i: (F.col("v") == 0) | w.contains("{}") | (F.pmod(F.xxhash64("template", "v", i, F.lit(SEED)), F.lit(100)) >= 12))
    fill = _listed(" ".join(ORDINARY).lower().split())
    scrap = F.transform(F.sequence(F.lit(1), F.pmod(F.col("v"), F.lit(7)) + 1), lambda i: F.element_at(fill, (F.pmod(F.xxhash64("template", "v", i), F.size(fill)) + 1).cast("int")))
    text = F.concat_ws(" ", F.when(F.col("v") % 2 == 1, F.array_join(scrap, " ")), F.replace(F.array_join(kept, " "), F.lit("{}"), F.col("name")), F.when(F.col("v") % 3 == 2, F.array_join(scrap, " ")))
    varied = varied.select("family", "template", F.coalesce("nth", "v").alias("nth"), text.alias("text"))
    fixed = common.stage(_features(varied, words).select("family", "template", "nth", "grams", F.lit(1).cast("long").alias("texts"), F.lit(1.0).alias("weight")), "fixed")
    negatives = common.stage(_negatives(named, fixed), "negatives")
    weight = F.lit(min(1.0, NEGATIVES / max(negatives.agg(F.sum("texts")).first()[0] or 0, 1)))
    fold = F.pmod(F.xxhash64("grams"), F.lit(FOLDS)).cast("int")
    negatives = negatives.select(F.lit(NONE).alias("family"), F.lit(-1).alias("template"), fold.alias("nth"), "grams", "texts", (F.col("texts") * weight).alias("weight"))
    return common.stage(fixed.unionByName(negatives), "labelled")


def _fit(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The model of labelled rows: ``gram, weights`` (one for each of the classes named), that of no gram the intercepts."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    grams = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2, vocabSize=(1 << 31) - 1).fit(rows)
    ready = common.stage(grams.transform(index.transform(rows)).select("features", "label", "weight"), "features")
    ready = ready.coalesce(1 + ready.count() // FIT_ROWS)
    lr = LogisticRegression(maxIter=ROUNDS, regParam=2e-3, family="multinomial", weightCol="weight").fit(ready)
    matrix = lr.coefficientMatrix.toArray().T.tolist()
    weights = [("", lr.interceptVector.toArray().tolist()), *zip(grams.vocabulary, matrix, strict=True)]
    return common.stage(rows.sparkSession.createDataFrame(weights, "gram string, weights array<double>"), "weights"), list(index.labels)


def left_out(rows: DataFrame) -> DataFrame:
    """Predictions of texts left out of training: ``family, weight, known`` (to that fold's model), ``predicted, probability``."""
    order = {f: k for k, f in enumerate(NAMES)}
    family = F.element_at(F.create_map(*[F.lit(x) for f in order.items() for x in f]), F.col("family"))
    rows = rows.withColumn("hidden", F.coalesce(family % (2 * FOLDS), F.lit(-1))).withColumn("id", F.monotonically_increasing_id())
    rows = common.stage(rows, "folds")
    found = []
    for k in range(FOLDS):
        hidden, out = F.col("hidden") == k, F.col("nth") % FOLDS == k
        model, names = _fit(rows.filter(~hidden & ~out))
        known = ~hidden & F.col("family").isin(*names)
        tested = rows.filter(hidden | out).select("id", "family", "weight", known.alias("known"), "grams")
        found.append(_scored(tested, model, names, ["id", "family", "weight", "known"]))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return common.stage(every.drop("id"), "left-out")


def calibrated(predictions: DataFrame) -> tuple[float, float, float]:
    """The limit; at it, the share of left-out notices accepted as their family, and of unseen families not accepted."""
    limits = F.explode(F.transform(F.sequence(F.lit(30), F.lit(99)), lambda x: x / 100)).alias("limit")
    rows = predictions.filter(F.col("family") != NONE).select("*", limits)
    accepted = ~F.col("predicted").isin(NONE, UNKNOWN) & (F.col("probability") >= F.col("limit"))
    of_known = F.col("known") & (F.col("family") != UNKNOWN)
    right = F.avg(F.when(of_known, (accepted & (F.col("predicted") == F.col("family"))).cast("double")))
    apart = F.avg(F.when(~of_known, (~accepted).cast("double")))
    best = rows.groupBy("limit").agg(F.coalesce(right, F.lit(0.0)).alias("right"), F.coalesce(apart, F.lit(0.0)).alias("apart"))
    row = best.orderBy(F.desc(F.col("right") + F.col("apart")), "limit").first()
    return row["limit"], row["right"], row["apart"]


def by_family(predictions: DataFrame, limit: float) -> DataFrame:
    """Of texts left out: ``family, texts, recall, precision`` of the predictions that the limit accepts."""
    accepted = F.when(~F.col("predicted").isin(NONE, UNKNOWN) & (F.col("probability") >= limit), F.col("predicted"))
    rows = predictions.select("family", "weight", "known", accepted.alias("named"))
    given = rows.filter("known").groupBy("family").agg(F.count(F.lit(1)).alias("texts"), F.avg((F.coalesce("named", F.lit("")) == F.col("family")).cast("double")).alias("recall"))
    named = rows.filter("named IS NOT NULL").groupBy("named").agg((F.sum(F.when(F.col("family") == F.col("named"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("precision"))
    return given.join(named, given["family"] == named["named"]).drop("named")


def train(rows: DataFrame) -> tuple[DataFrame, list[str], float]:
    """The model of labelled rows, its classes, and the limit below which a prediction is unknown."""
    limit = calibrated(left_out(rows))[0]
    model, names = _fit(rows)
    return model, names, limit


def _scored(rows: DataFrame, model: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """``keys, predicted, probability`` of rows with ``grams``: softmax of the summed weights."""
    table = model.select("gram", "weights")  # bounded by the notices and the share COMMON, whatever the corpus
    used = rows.select(*keys, F.explode(F.concat(F.array(F.lit("")), F.col("grams"))).alias("gram"))
    used = used.join(F.broadcast(table), "gram")
    sums = [F.sum(F.get("weights", F.lit(i))).alias(f"s{i}") for i in range(len(names))]
    scored = used.groupBy(*keys).agg(*sums)
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(names))])
    total = sum((F.exp(F.col(f"s{i}") - F.col("top")) for i in range(1, len(names))), F.exp(F.col("s0") - F.col("top")))
    best = F.coalesce(*[F.when(F.col(f"s{i}") == F.col("top"), F.lit(n)) for i, n in enumerate(names)])
    return scored.withColumn("top", top).select(*keys, best.alias("predicted"), (1 / total).alias("probability"))


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs with licence words: ``doc_id, paragraph, whole, line, text, family, probability,
    overlap, confirmed``; of a paragraph of several lines the whole and its lines."""
    spark = docs.sparkSession
    words = telling_words(docs)
    named = _named(docs, words)
    model, names, limit = train(_labelled(named, words))
    scored = _scored(named, model, names, ["doc_id", "paragraph", "whole", "line", "text"])
    family = F.when(F.col("predicted").isin(NONE, UNKNOWN), F.col("predicted")).when(F.col("probability") < limit, F.lit(UNKNOWN)).otherwise(F.col("predicted"))
    scored = scored.withColumn("family", family)
    # comparison with the family's names and long forms: the share of their sequences that the paragraph has
    joined = scored.join(F.broadcast(_notices(spark, "f")), F.col("family") == F.col("f"), "left")  # one row per family
    joined = joined.withColumn("overlap", F.coalesce(_overlap(F.col("text"), F.col("notices")), F.lit(0.0)))
    known = ~F.col("family").isin(NONE, UNKNOWN)
    return joined.select("doc_id", "paragraph", "whole", "line", "text", "family", "probability", F.when(known, F.col("overlap")).otherwise(0.0).alias("overlap"), (known & (F.col("overlap") >= CONFIRM)).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its licence by the best confirmed paragraph, else unknown licence talk, else none.

    ``doc_id, family, probability, overlap, confirmed, line, n_paragraphs`` (lines of licence talk, or
    paragraphs where only the whole is). Rows that
    repeat a ``doc_id`` share what was found under it.
    """
    found = licence_paragraphs(docs).filter(F.col("family") != NONE)
    rank = F.struct("confirmed", "overlap", "probability", (-F.col("line")).alias("l"), "family")
    best = found.groupBy("doc_id", "paragraph").agg(F.max(rank).alias("best"), F.greatest(F.count_if(~F.col("whole")), F.lit(1)).alias("n"))
    best = best.groupBy("doc_id").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    best = best.withColumnRenamed("doc_id", "__id")
    ids = docs.select("doc_id")
    joined = ids.join(best, ids["doc_id"].eqNullSafe(best["__id"]), "left")
    family = F.when(F.col("best").isNull(), NONE).when(F.col("best.confirmed"), F.col("best.family")).otherwise(UNKNOWN)
    return joined.select(
        "doc_id",
        family.alias("family"),
        F.round(F.coalesce("best.probability", F.lit(0.0)), 6).alias("probability"),
        F.round(F.coalesce("best.overlap", F.lit(0.0)), 6).alias("overlap"),
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
        (-F.col("best.l")).alias("line"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"),
    )
