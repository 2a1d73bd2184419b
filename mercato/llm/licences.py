"""Licence scan: statements and licence files by TF-IDF cosine, inheritance
by directory.

A unit is a line of a file, a paragraph of several lines (a header or a
clause that is wrapped) or, for the licence of a whole file, all its text.
The templates are short statements, SPDX tags, the usual headers and the
opening clauses of licence texts.  A unit's vector has one entry for each
distinct word, weighted by the inverse frequency of the word among the
templates; a word that no template has weighs most.  A unit bears a
template's licence if their cosine is ``LEAST_COSINE`` or more, the best
template first, then the smallest licence name.  Units too far from any
template by their word counts alone are left before any join: with ``d`` of
their distinct words in templates and ``o`` others the cosine is at most
sqrt(d / (d + o)).

A file with a statement of its own has that licence.  One whose whole text
is a licence, or that has a statement and is named as licence files are
(LICENSE, LICENCE, COPYING, UNLICENSE, whatever the ending), is a licence file as
well and gives its licence to its directory and everything below that has
none of its own; the nearest such ancestor counts, the best cosine and then the smallest path among files of
one directory.  Inheritance is resolved for each directory by joins on the
paths of its ancestors, then joined to the files.

Files with null or empty texts have no statement and may inherit; a null
path has no directory; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.text import free_name, plain_words, whole
from mercato.operators._util import null_safe_join
from mercato.session import materialize

LEAST_COSINE = 0.6
BROADCAST_FILES = 200_000

# Short statements of common licences, written for this scan.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
]
# Tags of the form that SPDX prescribes.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name, _ in TEMPLATES] + [
    (name, f"SPDX-License-Identifier: {name}") for name in ("LGPL-2.1", "Zlib")]
# What licences ask to put into files, and their opening clauses.
TEMPLATES += [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU Affero General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
     "this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be "
     "used to endorse or promote products derived from this software without specific prior written "
     "permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms "
     "of the GNU General Public License as published by the Free Software Foundation; either version 2 "
     "of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms "
     "of the GNU General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
     "copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will "
     "the authors be held liable for any damages arising from the use of this software."),
]
LICENCE_FILES = "(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def _template_words(spark: SparkSession) -> DataFrame:
    """(template, licence, word, weight, norm): squared weights of the
    distinct words of each template, and their sum."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(k).alias("licence"),
                              F.lit(t).alias("text")) for i, (k, t) in enumerate(TEMPLATES)])
    words = (spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
             .select("template", "licence",
                     F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word")))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    weighed = words.join(df, "word").select("template", "licence", "word",
                                            weight(F.col("df")).alias("weight"))
    norm = weighed.groupBy("template").agg(F.sum("weight").alias("norm"))
    return weighed.join(norm, "template")


def weight(df: Column) -> Column:
    """Squared inverse document frequency among the templates."""
    idf = F.log((F.lit(1.0) + len(TEMPLATES)) / (1 + df)) + 1
    return idf * idf


def matched(units: DataFrame, words: str, keys: list[str], templates: DataFrame) -> DataFrame:
    """(keys, licence, cosine) of the units that bear a licence; ``words``
    holds their distinct words."""
    known = F.array(*[F.lit(w) for w in sorted(
        r.word for r in templates.select("word").distinct().collect())])
    few = units.withColumns({"__in": F.array_intersect(words, known), "__n": F.size(words)})
    # repeated rows give the same units: few are left here, so those are made
    # distinct and not the texts
    few = few.where((F.size("__in") > 0)
                    & (F.size("__in") >= LEAST_COSINE ** 2 * F.col("__n"))
                    ).select(*keys, "__n", "__in").distinct()
    alone = weight(F.lit(0))
    posted = (few.select(*keys, "__n", F.size("__in").alias("__d"), F.explode("__in").alias("word"))
              .join(F.broadcast(templates), "word"))
    own = (few.select(*keys, "__n", F.explode("__in").alias("word"))
           .join(F.broadcast(templates.select("word", "weight").distinct()), "word")
           .groupBy(*keys).agg(F.sum("weight").alias("__own"),
                               F.max(F.col("__n")).alias("__all"), F.count("*").alias("__d2")))
    dots = posted.groupBy(*keys, "template", "licence", "norm").agg(F.sum("weight").alias("__dot"))
    both = null_safe_join(dots, own, keys)
    size = F.col("__own") + (F.col("__all") - F.col("__d2")) * alone
    cosine = F.round(F.col("__dot") / F.sqrt(size * F.col("norm")), 6)
    return (both.withColumn("cosine", cosine).where(F.col("cosine") >= LEAST_COSINE)
            .groupBy(*keys).agg(F.min(F.struct(-F.col("cosine"), F.col("licence"))).alias("best"))
            .select(*keys, "best.licence", (-F.col("best.col1")).alias("cosine")))


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty path."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scanned(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` with the new columns licence, cosine, found ("statement",
    "inherited" or null) and from_path (whose licence it is)."""
    spark = files.sparkSession
    templates = materialize(_template_words(spark))
    key, line = free_name(files, "__file"), free_name(files, "__line")
    named = files.withColumn(key, F.struct(F.col(path).alias("path"),
                                           F.md5(whole(text).cast("binary")).alias("text")))
    texts = named.select(key, whole(text).alias("text"))
    # lines, and below zero the paragraphs of more than one
    parts = F.concat(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("text"))),
        F.filter(F.transform(F.split("text", "\n[ \t\r]*\n"), lambda x, i: F.struct(
            (-1 - i).alias("i"), F.trim(x).alias("text"))), lambda p: F.contains(p["text"], F.lit("\n"))))
    lines = (texts.select(key, F.inline(parts).alias(line, "text"))
             .select(key, line, F.array_distinct(plain_words(F.col("text"))).alias("words"))
             .where(F.size("words") > 0))
    stated = matched(lines, "words", [key, line], templates)
    statement = materialize(stated.groupBy(key).agg(
        F.min(F.struct(-F.col("cosine"), F.col("licence"))).alias("best"))
        .select(key, F.col("best.licence").alias("licence"), (-F.col("best.col1")).alias("cosine")))
    bearers = statement.select(key)
    if statement.count() <= BROADCAST_FILES:    # or else the texts are shuffled once
        bearers = F.broadcast(bearers)
    whole_words = (texts.join(bearers, key, "left_semi")
                   .select(key, F.array_distinct(plain_words(F.col("text"))).alias("words")))
    at = F.col(f"{key}.path")
    notices = matched(whole_words, "words", [key], templates)
    titled = statement.where(at.rlike(LICENCE_FILES)).join(notices.select(key), key, "left_anti")
    notices = notices.union(titled.select(key, "licence", "cosine"))
    offers = (notices.where(at.isNotNull()).select(parent(at).alias("dir"), "licence", "cosine",
                                                   at.alias("from_path"))
              .groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), F.col("from_path"),
                                                 F.col("licence"))).alias("offer")))
    dirs = files.where(F.col(path).isNotNull()).select(parent(F.col(path)).alias("dir")).distinct()
    names = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(
        F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(names))),
        lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))).alias("ancestor"))
    given = (above.join(offers.withColumnRenamed("dir", "ancestor"), "ancestor")
             .groupBy("dir").agg(F.max_by("offer", F.length("ancestor")).alias("offer")))
    own = null_safe_join(named, statement.withColumnRenamed("licence", "__licence")
                         .withColumnRenamed("cosine", "__cosine"), [key], "left")
    own = own.withColumn("dir", parent(F.col(path)))
    joined = own.join(given, "dir", "left")
    has, heir = F.col("__licence").isNotNull(), F.col("offer").isNotNull()
    return joined.select(
        *files.columns,
        F.coalesce("__licence", "offer.licence").alias("licence"),
        F.coalesce("__cosine", -F.col("offer.col1")).alias("cosine"),
        F.when(has, "statement").when(heir, "inherited").alias("found"),
        F.when(has, F.col(path)).otherwise(F.col("offer.from_path")).alias("from_path"))
