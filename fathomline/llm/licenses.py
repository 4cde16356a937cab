"""Operator 4, licence scan: TF-IDF cosine of statements to templates, then inheritance from the nearest directory.

Every whole text is cut into lines and, after wrapped lines of a paragraph are joined and comment signs taken off, into
sentences and windows of two and three adjoining ones. Statements with a word of licensing are compared to the template
statements by the cosine of their sparse TF-IDF vectors. Document frequencies of the templates' terms come from all such
statements of the corpus; a term that no template has weighs as one that occurs once. All matches of a file from
``MIN_COSINE`` on are weighed: it takes the licence with the largest sum of cosines over its statements, so a line that
several versions share does not decide. SPDX identifiers of the templates' licences match exactly, with cosine 1.
A licence file (by its name, or because over ``FILE_SHARE`` of
its words stand in licence statements) also licenses its directory: the best cosine, then the smallest id, wins. Files
without a licence of their own inherit that of their nearest licensed ancestor directory, by joins on path prefixes
that are made once per directory, not per file. Leading and repeated slashes of a path do not count.

Everything is DataFrame expressions. Nulls: a null text has no statement; a null path is a file in the root
directory; rows with a null id are kept, and share what is found for them. Repeated rows are kept, the scan runs on
distinct rows. Equal sums go to the licence that sorts first. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import materialize, table, text_or_empty

MIN_COSINE, FILE_SHARE = 0.6, 0.5

#: Licence notices and statements of licence files by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, ISC License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    # of licence files; the conditions that BSD-2-Clause and BSD-3-Clause share stand under both
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
]
#: Only statements with one of these words are compared; every template has one.
TELLING = r"(?i)licen[cs]|copyright|spdx|redistribut|permission (is|to)|public domain|mozilla"
#: Comment signs at the start of a line; lines without anything else; identifiers after an SPDX tag.
SIGN = r"[ \t]*(?:#+|//+|/?\*+/?|;+|--+|%+)?[ \t]*"
BLANK = rf"\r?\n(?:{SIGN}\r?\n)++"  # possessive: a repeated group of Java's is matched by recursion else
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"
NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.\w+)?$"


def terms(text: Column) -> Column:
    """Lower-case terms: letters and digits, with inner dots and hyphens (2.0, BY-NC)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*+"), F.lit(0))


def _weights(rows: DataFrame, key: str, idf: Column) -> DataFrame:
    """``key, term, w`` of rows that have ``key, term, tf, df``, scaled to length one."""
    raw = rows.withColumn("w", F.col("tf") * idf)
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def statement_licenses(statements: DataFrame) -> DataFrame:
    """Licences of ``statements (s, text)``, each by its best template: ``s, license, cosine`` from ``MIN_COSINE`` on."""
    spark = statements.sparkSession
    counted = statements.select("s", F.explode(terms(F.col("text"))).alias("term")).groupBy("s", "term").agg(F.count("*").alias("tf"))
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(rows, "t int, license string, text string")
    tf = templates.select("t", F.explode(terms(F.col("text"))).alias("term")).groupBy("t", "term").agg(F.count("*").alias("tf"))
    vocabulary = tf.select("term").distinct()  # a fixed number of terms
    total = statements.count() + len(rows)
    df = counted.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    df = materialize(vocabulary.join(df, "term", "left").select("term", (F.coalesce("n", F.lit(0)) + 1).alias("df")), "document_frequency")
    idf = F.log(F.lit(float(total) + 1) / (F.coalesce("df", F.lit(1)) + 1)) + 1
    tw = _weights(tf.join(df, "term"), "t", idf).withColumnRenamed("w", "tw")
    sw = _weights(counted.join(F.broadcast(df), "term", "left"), "s", idf)
    names = templates.select("t", "license")
    cosine = sw.join(F.broadcast(tw), "term").groupBy("s", "t").agg(F.round(F.sum(F.col("w") * F.col("tw")), 9).alias("cosine")).where(F.col("cosine") >= MIN_COSINE)
    return cosine.join(F.broadcast(names), "t").groupBy("s", "license").agg(F.max("cosine").alias("cosine"))


def _statements(text: Column) -> Column:
    """``kind, statement`` of a text: its lines (0), and of joined paragraphs the sentences (1) and windows of adjoining ones (2)."""
    lines = F.split(text, r"\n+|(?<=[.!?;:])\s+")
    joined = F.transform(F.split(text, BLANK), lambda p: F.split(F.regexp_replace(p, rf"\s*\r?\n{SIGN}", " "), r"(?<=[.!?;])\s+"))

    def windows(said: Column) -> Column:  # a lambda's variable, so that it is split once, not for every window
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(said) - n + 1, F.lit(1))), lambda i: F.struct(F.lit(min(n, 2)).alias("kind"), F.array_join(F.slice(said, i, n), " ").alias("statement")))
        return F.concat(of(1), of(2), of(3))

    every = F.concat(F.transform(lines, lambda s: F.struct(F.lit(0).alias("kind"), s.alias("statement"))), F.flatten(F.transform(joined, windows)))
    return F.filter(every, lambda s: s["statement"].rlike(TELLING))


def scan(files: DataFrame) -> DataFrame:
    """``file_id, path, license, cosine, how`` of every row of ``files (file_id, path, text)``; ``how``: own, inherited or none."""
    base = files.select("file_id", F.coalesce("path", F.lit("")).alias("path"), text_or_empty(F.col("text")).alias("text"))
    telling = base.where(F.col("text").rlike(TELLING)).select("file_id", "path", F.size(F.split(F.trim("text"), r"\s+")).alias("words"), "text")
    hits = telling.select("file_id", "path", "words", F.explode(_statements(F.col("text"))).alias("h")).select("file_id", "path", "words", "h.*")
    hits = materialize(hits, "statements")
    distinct = hits.select(F.col("statement").alias("text")).distinct().withColumn("s", F.col("text"))
    found = materialize(statement_licenses(distinct), "statement_licenses")
    matched = hits.join(found, hits["statement"] == found["s"]).select("file_id", "path", "words", "kind", "statement", "license", "cosine", F.size(F.split(F.trim("statement"), r"\s+")).alias("said"))
    spdx = telling.select("file_id", "path", "words", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("tag"))
    spdx = spdx.select("file_id", "path", "words", F.explode(F.array_distinct(F.transform(F.split(F.lower("tag"), r"[\s()]+"), lambda t: F.regexp_replace(t, r"(\+|-only|-or-later)?\.?$", "")))).alias("tag"))
    tags = base.sparkSession.createDataFrame([(name.lower(), name) for name in sorted({name for name, _ in TEMPLATES})], "tag string, license string")
    spdx = spdx.join(F.broadcast(tags), "tag").select("file_id", "path", "words", F.lit(0).alias("kind"), F.concat(F.lit("SPDX-License-Identifier: "), "tag").alias("statement"), "license", F.lit(1.0).alias("cosine"), F.lit(2).alias("said"))
    # a repeated row repeats its statements; each counts once
    matched = matched.unionByName(spdx).distinct()
    licensed = matched.groupBy("file_id", "path", "words", "license").agg(F.sum("cosine").alias("sum"), F.max("cosine").alias("cosine"))
    best = licensed.groupBy("file_id", "path", "words").agg(F.min(F.struct((-F.round("sum", 9)).alias("m"), "license", "cosine")).alias("b"))
    # words in licence statements: lines overlap with sentences, so the larger of both sums counts
    spoken = matched.where("kind < 2").select("file_id", "path", "words", "kind", "statement", "said").distinct()
    spoken = spoken.groupBy("file_id", "path", "words").agg(F.greatest(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("said"))), F.lit(0)) for k in (0, 1)]).alias("said"))
    same = [F.col("x.file_id").eqNullSafe(F.col("y.file_id")), F.col("x.path") == F.col("y.path"), F.col("x.words") == F.col("y.words")]
    both = best.alias("x").join(spoken.alias("y"), same, "left").select("x.*", F.coalesce("y.said", F.lit(0)).alias("said"))
    own = materialize(
        both.groupBy("file_id", "path").agg(F.min("b").alias("b"), F.max((F.col("said") > FILE_SHARE * F.col("words")).cast("int")).alias("mostly"))
        .select("file_id", "path", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"), "mostly"),
        "own_licenses",
    )
    folder = lambda c: F.array_join(F.filter(F.split(F.regexp_replace(c, "/?[^/]*$", ""), "/"), lambda p: p != ""), "/")
    licensing = own.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(NAME) | (F.col("mostly") == 1))
    folders = materialize(licensing.groupBy(folder(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "file_id", "license")).alias("b")).select("dir", "b.license", (-F.col("b.c")).alias("cosine")), "licensed_folders")

    dirs = base.select(folder(F.col("path")).alias("dir")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")  # the root has none
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("ancestor")))).alias("a")).select("dir", "a.*")
    near = up.join(folders.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "license", "cosine")).alias("n"))
    near = near.select("dir", F.col("n.license").alias("near_license"), F.col("n.cosine").alias("near_cosine"))
    joined = base.select("file_id", "path", folder(F.col("path")).alias("dir")).join(near, "dir", "left").join(own.withColumnRenamed("file_id", "oid").withColumnRenamed("path", "opath"), F.col("file_id").eqNullSafe(F.col("oid")) & (F.col("path") == F.col("opath")), "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("near_license").isNotNull(), "inherited").otherwise("none")
    return joined.select("file_id", "path", F.coalesce("license", "near_license").alias("license"), F.round(F.coalesce("cosine", "near_cosine"), 6).alias("cosine"), how.alias("how"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / a folder of 64 documents / document."""
    part = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("unknown")), "/", "_")
    shelf = F.coalesce((F.col("doc_id") / 64).cast("long"), F.lit(0)).cast("string")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", part("source"), part("lang"), shelf, F.coalesce(F.col("doc_id").cast("string"), F.lit("unnamed"))).alias("path"), "text")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_files(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")
