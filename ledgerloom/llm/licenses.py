"""License scan in DataFrame functions alone: MinHash bands over text windows, then exact shingle containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public license notices, as authors put them into files and pages.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

WIDTH = 5
BANDS = 20


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(of: Column) -> Column:
    """A 64-bit hash of each WIDTH consecutive words; none of fewer words. `of` must be a column that a projection below has made: it is read at each place."""
    count = F.size(of) - WIDTH + 1
    each = lambda i: F.xxhash64(*(F.get(of, i + k) for k in range(WIDTH)))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), each)).otherwise(F.array().cast("array<bigint>"))


def _least(of: Column, band: int) -> Column:
    return F.array_min(F.transform(of, lambda h: F.xxhash64(h, F.lit(band))))


def _anchor(of: Column, band: int) -> Column:
    """The shingle that has the least hash."""
    return F.array_min(F.transform(of, lambda h: F.struct(F.xxhash64(h, F.lit(band)), h.alias("h"))))["h"]


def signature(of: Column, bands: int) -> Column:
    """The least hash of a set of shingles under each of `bands` hash functions: bands of one row."""
    return F.array(*[_least(of, j) for j in range(bands)])


def size_class(shingle_count: int) -> int:
    return shingle_count.bit_length() - 1


def templates(spark, notices: dict[str, str], bands: int) -> list[dict]:
    """Notices with their distinct shingles, signature and size class; their number is the caller's, not the data's."""
    frame = spark.createDataFrame(list(notices.items()), "license string, text string")
    made = frame.withColumn("w", words(F.col("text"))).withColumn("shingles", F.array_distinct(shingles(F.col("w")))).withColumn("signature", signature(F.col("shingles"), bands))
    # For each band, the shingle that gives the least hash: a window can collide in that band only if it holds this shingle.
    anchors = F.array(*[_anchor(F.col("shingles"), j) for j in range(bands)])
    rows = made.select("license", "text", "shingles", "signature", F.array_distinct(anchors).alias("anchors")).collect()
    for r in rows:
        if not r["shingles"]:
            raise ValueError(f"notice {r['license']!r} has fewer than {WIDTH} words")
    return [r.asDict() for r in rows]


def _windows(c: int, of: list[dict]) -> Column:
    """The windows of a size class that hold an anchor of its notices, from the columns h (shingles) and hits (places of anchors)."""
    stride = max(1, 1 << c >> 1)
    width = max(len(t["shingles"]) for t in of) + stride - 1
    own = sorted({a for t in of for a in t["anchors"]})
    mine = F.filter("hits", lambda i: F.get(F.col("h"), i).isin(own))
    first = lambda i: F.greatest(F.lit(0), F.floor((i - width + stride) / stride).cast("int"))
    covering = F.array_distinct(F.flatten(F.transform(mine, lambda i: F.sequence(first(i), F.floor(i / stride).cast("int")))))
    return F.transform(covering, lambda k: F.struct(F.lit(c).alias("class"), (k * stride).alias("start"), F.lit(width).alias("width")))


def scan(docs: DataFrame, text: str = "text", id_: str = "doc_id", notices: dict[str, str] = NOTICES, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(id, license, containment, start_word, windows) for every row of docs and notice that a window of it holds.

    containment: the share of the notice's distinct five-word shingles that the best window holds, at least threshold.
    start_word: where the first of these stands in the text (of the best window, the first of equals); windows: how
    many windows hold the notice. A notice of n shingles, 2^c <= n < 2^(c+1), is looked for in windows that overlap so
    that one always covers it; a window that holds 0.8 of it is at least 0.29 similar to it, so one of 20 one-row
    bands agrees with probability over 0.998 (of an exact notice, over 0.9999). A band can agree only in windows with the shingle that is
    least for the notice in that band: only those get a signature. No text is shuffled, no row compared with another.

    Null, empty and short texts hold nothing. Repeated rows and ids give a result each. Other columns are ignored.
    """
    known = templates(docs.sparkSession, notices, bands)
    classes: dict[int, list[dict]] = {}
    for t in known:
        classes.setdefault(size_class(len(t["shingles"])), []).append(t)
    anchors = sorted({a for t in known for a in t["anchors"]})
    # The row number is not deterministic, which keeps Catalyst from moving the filter below and hashing every text twice.
    rows = docs.select(F.col(id_).alias("id"), words(F.col(text)).alias("w")).select("id", F.monotonically_increasing_id().alias("row"), shingles(F.col("w")).alias("h"))
    rows = rows.where(F.exists("h", lambda x: x.isin(anchors)))
    hits = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get(F.col("h"), i).isin(anchors))
    starts = [_windows(c, of) for c, of in classes.items()]
    # Each window takes its own slice along, not the whole text's shingles.
    sliced = F.transform(F.concat(*starts), lambda w: F.struct(w["class"].alias("class"), w["start"].alias("start"), F.slice("h", w["start"] + 1, w["width"]).alias("win")))
    windows = rows.withColumn("hits", hits).select("id", "row", F.explode(sliced).alias("w")).select("id", "row", "w.class", "w.start", "w.win").withColumn("signature", signature(F.col("win"), bands))

    def literal(t: dict) -> Column:
        return F.struct(F.lit(t["license"]).alias("license"), F.array(*map(F.lit, t["shingles"])).alias("s"), F.array(*map(F.lit, t["signature"])).alias("m"))

    in_class = reduce(lambda e, c: e.when(F.col("class") == c, F.array(*map(literal, classes[c]))), list(classes)[1:], F.when(F.col("class") == list(classes)[0], F.array(*map(literal, classes[list(classes)[0]]))))
    retrieved = F.filter(in_class, lambda t: F.exists(F.zip_with("signature", t["m"], lambda a, b: a == b), lambda x: x))
    verified = windows.select("id", "row", "start", "win", F.explode(retrieved).alias("t")).withColumn("containment", F.size(F.array_intersect("win", "t.s")) / F.size("t.s")).where(F.col("containment") >= threshold)
    at = F.array_min(F.filter(F.sequence(F.lit(0), F.size("win") - 1), lambda i: F.array_contains(F.col("t.s"), F.get(F.col("win"), i))))
    best = F.max(F.struct("containment", (-(F.col("start") + at)).alias("neg")))
    found = verified.groupBy("row", "id", F.col("t.license").alias("license")).agg(best.alias("b"), F.count("*").alias("windows"))
    return found.select(F.col("id").alias(id_), "license", F.col("b.containment").alias("containment"), (-F.col("b.neg")).cast("long").alias("start_word"), "windows")
