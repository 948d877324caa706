"""License scans: a trained paragraph classifier whose findings templates confirm.

Every paragraph of every text is classified by multinomial logistic regression over sparse word
n-grams. A paragraph is a line; lines of up to WRAP characters that follow each other are also read
together, in windows of WINDOW lines, as notices are often wrapped.

The classifier is trained on notices that are made from the families' names, identifiers and
wordings, alone and amid words of the corpus, against paragraphs drawn from the corpus and against
near misses: licence words out of order, and parts of notices too short to tell a family. An unknown
class takes what fits no family, and a family must pass the probability that held-out paragraphs of
the corpus, drawn like those that are scored, stay below but for a small share. What the classifier
names is confirmed if the paragraph has enough of the word pairs of a wording of that family.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Each family's names as notices give them.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache-2.0", "Apache License 2.0", "Apache 2.0 license"],
    "mit": ["MIT License", "MIT license terms", "The MIT License (MIT)", "Expat license"],
    "isc": ["ISC License", "ISC license terms"],
    "bsd-2-clause": ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License"],
    "gpl-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2", "GNU GPL v2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GPLv3", "GNU GPL v3 or later"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "LGPL-3.0", "LGPLv3"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "epl-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"],
    "unlicense": ["The Unlicense", "Unlicense"],
    "cc0-1.0": ["Creative Commons CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "cc-by-nc-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "cc-by-nd-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND-4.0"],
    "all-rights-reserved": ["All rights reserved", "No part of this publication may be reproduced without permission"],
}
#: Passages of the licences' own texts and standard headers.
WORDINGS = [
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-4.0", "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit."),
    ("all-rights-reserved", "No part of this work may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher."),
]
#: What notices put before a name. {} is the name.
FRAMES = ["{}", "Licensed under the {}", "Licensed under {}", "Released under the {}", "This work is licensed under the {}", "Distributed under the terms of the {}", "This project is available under the {}", "SPDX-License-Identifier: {}", "Copyright the authors. {}"]
#: Parts of notices that don't tell a family.
_VAGUE = ["see the license file for details", "this file is part of the project", "you should have received a copy of the license", "the license of the driver was renewed", "copyright stays with the author", "permission was granted by the council", "version 2.0 of the plan", "a new version 3 of the public library", "no license is needed", "licensed professionals only", "the general public is free to enter", "a copy of this book", "as it is", "all rights and duties"]
UNKNOWN = "unknown"
FAMILIES = [*NAMES]
WRAP, WINDOW = 120, 12


def notices() -> list[tuple[str, str]]:
    """(family, wording) of all notices that the frames make, and the passages."""
    return [(k, frame.format(name)) for k, names in NAMES.items() for name in names for frame in (FRAMES if k != "all-rights-reserved" else FRAMES[:1])] + WORDINGS


def words(text: Column) -> Column:
    """Runs of letters, digits, dots and hyphens inside a word, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[.-][a-z0-9]+)*)"), 1)


def pairs(tokens: Column) -> Column:
    """The distinct pairs of neighbours; a single word stands for itself."""
    n = F.size(tokens)
    two = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.get(tokens, i - 1), F.get(tokens, i)))
    return F.array_distinct(F.when(n >= 2, two).otherwise(tokens))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, line, lines, _text): each line that has a letter or digit, and windows over runs of short lines.

    line counts from 0. Windows of WINDOW lines begin at every WINDOW / 2 th line of the text.
    """
    half = WINDOW // 2
    rows = docs.select(F.col(id_col), F.split(F.col(text_col).cast("string"), "\r?\n", -1).alias("_lines"))
    # Long lines and blank ones end a run: they are left empty in windows, which are split there.
    short = F.transform("_lines", lambda x: F.when((F.length(x) <= WRAP) & (F.length(F.trim(x)) > 0), x).otherwise("\n"))
    rows = rows.withColumn("_short", short).withColumn("_n", F.size("_lines"))
    one = F.transform("_lines", lambda x, i: F.struct(i.alias("line"), F.lit(1).alias("lines"), x.alias("text")))
    starts = F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(half))

    def runs(s: Column) -> Column:
        """The window's runs of short lines, two lines or more."""
        joined = F.array_join(F.slice("_short", s + 1, WINDOW), "\r")
        parts = F.filter(F.split(joined, "\r?\n\r?", -1), lambda x: F.instr(x, "\r") > 0)
        return F.transform(parts, lambda x: F.struct(s.alias("line"), F.lit(WINDOW).alias("lines"), F.replace(x, F.lit("\r"), F.lit(" ")).alias("text")))

    some = F.exists("_lines", lambda x: (F.length(x) <= WRAP) & (F.length(F.trim(x)) > 0))
    wrapped = F.when(some & (F.col("_n") > 1), F.flatten(F.transform(starts, runs))).otherwise(F.array().cast("array<struct<line:int,lines:int,text:string>>"))
    told = rows.select(id_col, F.explode(F.concat(one, wrapped)).alias("p")).select(id_col, "p.line", "p.lines", F.col("p.text").alias("_text"))
    return told.where(F.col("_text").rlike("[a-zA-Z0-9]"))


def _wordings(docs: DataFrame) -> DataFrame:
    """(family, tokens, want): all notices and their word pairs; a small fixed table."""
    rows = docs.sparkSession.createDataFrame(notices(), "family string, _text string").withColumn("tokens", words(F.col("_text")))
    return rows.select("family", "tokens", pairs(F.col("tokens")).alias("want"))


def _training(docs: DataFrame, id_col: str, text_col: str, wordings: DataFrame, most: int) -> DataFrame:
    """(family, tokens, held, own): notices, plain and amid other words; near misses; the corpus's paragraphs (own).

    About `most` paragraphs of the corpus, taken by their hashes at the rate that their count gives:
    the documented bound of the sample. Paragraphs with over half of a notice's word pairs are left out.
    """
    every = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "\r?\n", -1)).alias("_text")).where(F.length("_text") > 0)
    count = every.count()
    rate = min(1.0, most / max(1, count))
    # Copies of a paragraph have one hash, so distinct ones are what the rate draws from.
    plain = every.withColumn("_h", F.xxhash64("_text")).where(F.pmod("_h", F.lit(1 << 40)) < int(rate * (1 << 40))).dropDuplicates(["_h"])
    plain = plain.select(words(F.col("_text")).alias("tokens"), (F.pmod(F.shiftright("_h", 41), F.lit(2)) == 0).alias("held")).where("size(tokens) > 0")
    plain = cut(plain.withColumn("_row", F.monotonically_increasing_id()))
    grams = plain.select("_row", F.explode(pairs(F.col("tokens"))).alias("g")).join(F.broadcast(wordings.withColumn("_w", F.monotonically_increasing_id()).select("_w", F.size("want").alias("n"), F.explode("want").alias("g"))), "g")
    licensed = grams.groupBy("_row", "_w").agg((F.count("*") / F.first("n")).alias("share")).where("share > 0.5").select("_row").distinct()
    plain = cut(plain.join(licensed, "_row", "left_anti").select("tokens", "held", F.pmod(F.xxhash64("tokens"), F.lit(97)).alias("slot")))
    fill = plain.select("held", "tokens", "slot").withColumnRenamed("tokens", "fill").where("slot < 24").dropDuplicates(["slot", "held"])
    # Each notice beside paragraphs of the corpus, whole and in part: notices run on with other text.
    amid = wordings.select("family", "tokens", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("slot")).where(F.pmod(F.xxhash64("tokens", "slot"), F.lit(12)) == 0)
    amid = amid.join(F.broadcast(fill), "slot").select("family", "tokens", F.concat("tokens", F.slice("fill", 1, 2 + 3 * F.col("slot"))).alias("mixed"), "held")
    bare = wordings.select("family", "tokens", F.lit(False).alias("held"))
    by_hash = lambda a, b: F.when(F.xxhash64(a) < F.xxhash64(b), -1).when(F.xxhash64(a) > F.xxhash64(b), 1).otherwise(0)
    vague = docs.sparkSession.createDataFrame([(x,) for x in _VAGUE], "_text string").select(words(F.col("_text")).alias("tokens"))
    vague = vague.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(23)))).join(F.broadcast(fill.where("not held")), "slot").select(F.concat("tokens", F.slice("fill", 1, F.col("slot"))).alias("tokens"))
    row = lambda family, tokens, held, own=False: [F.lit(family).alias("family") if family else F.col("family"), tokens.alias("tokens"), held.alias("held"), F.lit(own).alias("own")]
    rows = bare.select(*row(None, F.col("tokens"), F.col("held")))
    rows = rows.union(amid.select(*row(None, F.col("mixed"), F.col("held"))))
    rows = rows.union(amid.select(*row(UNKNOWN, F.array_sort("tokens", by_hash), F.col("held"))))
    rows = rows.union(vague.select(*row(UNKNOWN, F.col("tokens"), F.lit(False))))
    return rows.union(plain.select(*row(UNKNOWN, F.col("tokens"), F.col("held"), True))).repartition(4)  # a bounded sample


def _label(family: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in [*FAMILIES, UNKNOWN]]), family) - 1).cast("double")


def _top() -> Column:
    return F.array_max(F.slice("p", 1, len(FAMILIES)))


def fit(rows: DataFrame, false_share: float = 0.001) -> tuple[PipelineModel, float]:
    """The classifier of (family, tokens, held, own), and the probability that a family must pass."""
    stages = [
        NGram(n=2, inputCol="tokens", outputCol="two"),
        CountVectorizer(inputCol="tokens", outputCol="v1", minDF=2, vocabSize=1 << 18, binary=True),
        CountVectorizer(inputCol="two", outputCol="v2", minDF=2, vocabSize=1 << 18, binary=True),
        VectorAssembler(inputCols=["v1", "v2"], outputCol="features"),
        LogisticRegression(family="multinomial", regParam=1e-4, maxIter=30, probabilityCol="p", predictionCol="best", rawPredictionCol="raw"),
    ]
    model = Pipeline(stages=stages).fit(rows.withColumn("label", _label(F.col("family"))).where("not held"))
    held = model.transform(rows.where("held and own")).withColumn("p", vector_to_array("p"))
    bound = held.agg(F.percentile(_top(), 1 - false_share)).first()[0]  # of the bounded sample
    return model, max(0.5, bound or 0.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_unlicensed: int = 3000, least_similarity: float = 0.6, false_share: float = 0.001) -> DataFrame:
    """One row for each paragraph of a licence family: id_col, line, lines, family, probability, similarity, confirmed.

    Paragraphs of the unknown class are told nowhere else. line counts from 0; lines is 1, or WINDOW
    for lines read together. similarity is the largest share of a wording's word pairs that the
    paragraph has, of the family's wordings; confirmed asks for least_similarity of it. Lines read
    together are not told where one of them is confirmed as that family by itself. Null and empty texts have no paragraphs; repeated rows give repeated rows; an empty table gives none; of
    other columns none is read.
    """
    wordings = _wordings(docs)
    model, bound = fit(cut(_training(docs, id_col, text_col, wordings, most_unlicensed)), false_share)
    found = paragraphs(docs, id_col, text_col).withColumn("tokens", words(F.col("_text"))).drop("_text")  # each has a letter or digit
    scored = model.transform(found).select(id_col, "line", "lines", "tokens", vector_to_array("p").alias("p")).withColumn("top", _top())
    place = F.array_position(F.slice("p", 1, len(FAMILIES)), F.col("top")).cast("int")
    named = scored.where((F.col("top") >= bound) & (F.col("top") > F.get("p", F.lit(len(FAMILIES)))))
    named = named.withColumn("family", F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), place)).withColumn("_own", pairs(F.col("tokens")))
    by_family = F.broadcast(wordings.groupBy("family").agg(F.collect_list("want").alias("_want")))  # a row per family
    share = F.array_max(F.transform("_want", lambda w: F.size(F.array_intersect(F.col("_own"), w)) / F.size(w)))
    named = named.join(by_family, "family").withColumn("similarity", F.round(share, 6))
    told = cut(named.select(id_col, "line", "lines", "family", F.round("top", 6).alias("probability"), "similarity", (F.col("similarity") >= least_similarity).alias("confirmed")))
    single = told.where("lines = 1")
    inside = single.where("confirmed").select(F.col(id_col).alias("_id"), F.col("family").alias("_family"), F.col("line").alias("_line")).distinct()
    within = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("family") == F.col("_family")) & F.col("_line").between(F.col("line"), F.col("line") + F.col("lines") - 1)
    return single.union(told.where("lines > 1").join(inside, within, "left_anti"))
