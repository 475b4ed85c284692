"""Licence scans by MinHash bands over overlapping windows, in DataFrame operations only.

Templates are grouped by length: class m holds those of m / 2 to m distinct shingles of K words.  For each class a
text is cut into windows of 2 m shingles that start every m, so an occurrence lies whole in some
window.  Only shingles that some template has are kept of a window, which takes nothing from
what it shares with a template and raises their similarity.

A window that holds ``threshold`` of a template's t shingles has with it a similarity of at least
threshold t / (2 m + (1 - threshold) t) in any case.  Each class has as many bands of one MinHash
each as make the chance that none collides at most MISS for the least such similarity.
Windows and templates that share a band meet, and the window's exact share of the
template's shingles decides.  A template of fewer than K words is one shingle of that many words,
its windows are single shingles, and one band finds it always.
"""

from __future__ import annotations

import re
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.line_dedup import LOWER, UPPER
from lamina.llm.shared import stage

_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"gpl": "General", "lgpl": "Lesser General", "agpl": "Affero General"}

#: Widely used licence notices, as their licences or Creative Commons and SPDX word them.
NOTICES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "all-rights-reserved-bare": "All rights reserved",
    "lgpl-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-2.0-notice": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "agpl-notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gpl-family-warranty": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU",
    "gfdl-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "apache-2.0-asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "apache-1.1-clause": "This product includes software developed by the Apache Software Foundation",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-terms": "This project is licensed under the MIT License",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-licensed": "Licensed under the BSD License.",
    "bsd-3-clause-endorsement": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-4-clause-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mpl-1.1-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "epl-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cddl-notice": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "cpl-notice": "are made available under the terms of the Common Public License",
    "eupl-1.2-notice": "Licensed under the EUPL, Version 1.2",
    "artistic-2.0-notice": "under the terms of the Artistic License 2.0",
    "boost-line": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib-grant": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-clause": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "ncsa-line": "University of Illinois/NCSA Open Source License",
    "ofl-1.1-line": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "wtfpl-line": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "public-domain-line": "This work is in the public domain.",
    "public-domain-dedication": "This file has been dedicated to the public domain.",
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-1.0-waiver": "has waived all copyright and related or neighboring rights to this work",
    "cc0-1.0-line": "Licensed under CC0 1.0 Universal.",
} | {
    f"cc-{k}-{v}-notice": f"This work is licensed under a Creative Commons {name} {v} {port} License." for k, name in _CC.items() for v, port in (("3.0", "Unported"), ("4.0", "International"))
} | {
    f"cc-{k}-{v}-line": f"Licensed under CC {k.upper()} {v}." for k in _CC for v in ("2.0", "2.5", "3.0", "4.0")
} | {
    f"{k}-{v}-line": f"This work is licensed under the GNU {name} Public License, version {v.removesuffix('.0')}." for k, name in _GNU.items() for v in (("2.1", "3.0") if k == "lgpl" else ("3.0",) if k == "agpl" else ("2.0", "3.0"))
} | {
    f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}"
    for x in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")
}
K = 5
#: The most likely miss of a window that reaches the threshold.
MISS = 1e-3


def _words(text: Column) -> Column:
    bare = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(bare, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))


def _runs(n: int) -> Column:
    """``n, pos, of, h`` of all runs of n of the word hashes ``w``; ``of`` is the number of runs."""
    of = F.size("w") - (n - 1)
    at = lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"), of.alias("of"), F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(n)]).alias("h"))
    return F.transform(F.when(of > 0, F.sequence(F.lit(0), of - 1)).otherwise(F.array().cast("array<int>")), at)


def _shingles(df: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """``keep`` and ``n, pos, of, h`` of all runs of n of ``words``, for each n of ``lengths``."""
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    return hashed.select(*keep, F.explode(F.concat(*[_runs(n) for n in lengths])).alias("s")).select(*keep, "s.*")


def bands(least: float) -> int:
    """Single MinHashes of which all differ with a chance of at most MISS at a similarity of ``least``."""
    return 1 if least >= 1 else ceil(log(MISS) / log(1 - least))


def _minhashes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys, band, low``: for each group the least hash of its ``h`` in each of its ``bands`` bands."""
    lows = [F.min(F.xxhash64(F.lit(i), "h")).alias(f"b{i}") for i in range(most)]
    sketch = rows.groupBy(*keys).agg(F.first("bands").alias("bands"), *lows)
    return sketch.select(*keys, "bands", F.posexplode(F.array(*[f"b{i}" for i in range(most)])).alias("band", "low")).where("band < bands").drop("bands")


def anchors(texts: list[str], threshold: float) -> list[str]:
    """Words of which any ``threshold`` of a template's shingles contain at least one.

    Picked greedily, long words first as they are rare, so that fewer than ``threshold`` of each template's shingles go
    without; a text without an anchor can't contain the template.
    """
    picked: set[str] = set()
    for text in texts:
        w = re.findall("[^\x20\x09-\x0d]+", text.translate(str.maketrans(UPPER, LOWER)))
        grams = [set(w[i : i + K]) for i in range(max(1, len(w) - K + 1))]
        total = len(grams)
        grams = [g for g in grams if not g & picked]
        while grams and len(grams) >= threshold * total:
            best = max(sorted(set().union(*grams)), key=lambda x: (len(x) > 6, sum(x in g for g in grams), len(x)))
            picked.add(best)
            grams = [g for g in grams if best not in g]
    return sorted(picked)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Find licence templates whose shingles a window of a text contains.

    Args: ``docs`` with ``doc_id`` and ``text``; other columns are ignored.  ``templates``:
    name to text, a list that a person keeps (up to some thousands), ``NOTICES`` if None.
    Returns ``doc_id, license, containment`` double: the largest share of the template's
    distinct 5-word shingles in one window, if at least ``threshold``; and ``windows`` long:
    the windows that reach it.  A template of fewer than five words is one shingle of that many
    words, and its windows are its occurrences.

    Null and blank texts match nothing, as do blank templates.  Null doc_ids are kept, and
    rows that repeat a doc_id count together.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = {k: re.findall("[^\x20\x09-\x0d]+", v) for k, v in (NOTICES if templates is None else templates).items()}
    named = {k: w for k, w in named.items() if w}
    if not named:
        return docs.select("doc_id").limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("windows"))
    lengths = sorted({min(len(w), K) for w in named.values()})
    rows = spark.createDataFrame([(k, " ".join(w), min(len(w), K)) for k, w in named.items()], "license string, text string, own int")
    grams = _shingles(rows.withColumn("words", _words(F.col("text"))), ["license", "own"], lengths).where("n = own").select("license", "n", "h").distinct()
    sizes = grams.groupBy("license").agg(F.count("*").alias("total")).withColumn("m", F.pow(F.lit(2), F.ceil(F.log2("total"))).cast("int"))
    # The least similarity that a class must find, and its bands.
    worst: dict[int, float] = {}
    for r in sizes.select("total", "m").distinct().collect():
        at_least = 1.0 if r["m"] == 1 else ceil(threshold * r["total"] - 1e-9) / (2 * r["m"] + r["total"] - ceil(threshold * r["total"] - 1e-9))
        worst[r["m"]] = min(worst.get(r["m"], 1.0), at_least)
    many = {m: bands(j) for m, j in worst.items()}
    of_class = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    grams = stage(grams.join(sizes, "license").withColumn("bands", of_class[F.col("m")]), "templates")
    most = max(many.values())

    # A lossless first cut: texts without any anchor word contain no template.
    words = anchors([" ".join(w) for w in named.values()], threshold)
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("words")).where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in words])))
    known = grams.select("n", "h").distinct()
    hits = stage(_shingles(texts, ["doc_id", "row"], lengths).join(F.broadcast(known), ["n", "h"]), "hits")

    # The windows of a shingle in each class: the one it starts in and the one before; the last m of a text start none.
    classes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n in lengths for m in (sorted(many) if n == K else [1])])
    placed = hits.withColumn("c", F.explode(F.filter(classes, lambda x: x["n"] == F.col("n")))).withColumn("m", F.col("c.m"))
    own = F.col("pos") - F.col("pos") % F.col("m")
    starts = F.when(F.col("m") == 1, F.array("pos")).otherwise(F.filter(F.array(own, own - F.col("m")), lambda i: (i >= 0) & ((i == 0) | (i + F.col("m") < F.col("of")))))
    window = ["doc_id", "row", "n", "m", "at"]
    inside = placed.select("doc_id", "row", "n", "m", F.explode(starts).alias("at"), "h").withColumn("bands", of_class[F.col("m")])
    sketched = _minhashes(inside, window, most)
    keys = _minhashes(grams, ["license", "n", "m", "total"], most)
    candidates = sketched.join(F.broadcast(keys), ["n", "m", "band", "low"]).select(*window, "license", "total").distinct()

    # Exactly the shingles that window and template share.
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    c = candidates.withColumnsRenamed({"doc_id": "c_doc", "row": "c_row", "n": "c_n", "m": "c_m", "at": "c_at"})
    met = inside.join(c, (F.col("row") == F.col("c_row")) & (F.col("n") == F.col("c_n")) & (F.col("m") == F.col("c_m")) & (F.col("at") == F.col("c_at")) & same("doc_id", "c_doc"))
    met = met.join(F.broadcast(grams.select(F.col("license").alias("g_license"), F.col("n").alias("g_n"), F.col("h").alias("g_h"))), (F.col("license") == F.col("g_license")) & (F.col("n") == F.col("g_n")) & (F.col("h") == F.col("g_h")))
    share = met.groupBy("doc_id", "row", "license", "total", "at").agg((F.count_distinct("h") / F.col("total")).alias("c"))
    return share.where(F.col("c") >= threshold).groupBy("doc_id", "license").agg(F.max("c").alias("containment"), F.count("*").alias("windows"))
