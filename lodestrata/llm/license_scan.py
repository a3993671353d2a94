"""License texts and notices found by MinHash bands over text windows, in DataFrame functions only.

For each template length, overlapping windows of that length lie on a grid over every text. The bands
of a window's MinHash signature retrieve templates of the same length, and a retrieved template is
verified by the exact share of its shingles around the window.

A band of a window equals a template's only if the window's least shingle, under the band's first hash,
is the template's. So bands are worked out for the windows that hold one of these deciding shingles, of
which a template has one for each band: the other windows of the grid can meet no band of it. The rows
are those of banding every window (tested); a text that shares only other shingles is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS

#: Words of a shingle, and the percentage of a template's distinct shingles that must be there.
WORDS, PERCENT = 5, 75
#: A window of similarity j to a template meets it in one of 64 bands of two rows with probability
#: 1 - (1 - j ** 2) ** 64. A whole copy, at most a stride from a window, has j >= 7 / 9 and is lost with
#: probability 1e-25 at most; three quarters of a template, spread evenly over all that is searched around a window,
#: have j = 0.43 (0.6 of the shingles in the window), and are lost with probability 2e-6.
BANDS, ROWS = 64, 2
#: Windows start at every STRIDE-th of their shingles, and one shingle apart at least.
STRIDE = 8
#: Band keys, or shingles if there are more, that are broadcast; more templates are scanned for in slices.
BROADCAST_SHINGLES = 200_000

#: Notices that licenses ask to be put into works.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


TEMPLATES |= TEXTS


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, text) of the given templates, or of the notices above and the texts of license_texts."""
    return spark.createDataFrame(sorted((texts or TEMPLATES).items()), "license string, text string")


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) of a folder of license files, each named as its license is."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("license"), F.col("value").alias("text"))


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, so that comment marks and punctuation do not matter."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _shingle(words_col: str, pos: str | Column) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.xxhash64(*(F.get(words_col, pos + i) for i in range(WORDS)))


def _least(shingles: str, k: int) -> Column:
    """The least hash of a set under the k-th hash function, and the shingle that has it."""
    return F.array_min(F.transform(F.col(shingles), lambda g: F.struct(F.xxhash64(g, F.lit(k)).alias("value"), g.alias("shingle"))))


def _bands(shingles: str) -> Column:
    """Hashes of the bands of a set's MinHash signature."""
    least = lambda k: F.array_min(F.transform(F.col(shingles), lambda g: F.xxhash64(g, F.lit(k))))
    return F.array(*(F.xxhash64(F.lit(b), *(least(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))


def _deciding(shingles: str) -> Column:
    """The shingles without which no band of a window can equal one of this set's."""
    return F.array_distinct(F.array(*(_least(shingles, b * ROWS)["shingle"] for b in range(BANDS))))


def prepared(licenses: DataFrame) -> DataFrame:
    """(license, len, t, entry): words, distinct shingles and a key of each template of five words or more."""
    known = licenses.select("license", _hashes(F.col("text")).alias("g")).where(F.size("g") >= WORDS).distinct()
    spots = F.sequence(F.lit(0), F.size("g") - WORDS)
    known = known.select("license", F.size("g").alias("len"), F.transform(spots, lambda p: _shingle("g", p)).alias("all"))
    return known.select("license", "len", F.array_distinct("all").alias("t"), F.xxhash64("license", "all").alias("entry"))


def texts_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, h): hashes of each text's words."""
    return docs.select(F.col(id_col).alias("doc"), _hashes(F.col(text)).alias("h"))


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, license, n_shingles, n_matched): the templates that each text holds.

    n_matched is the most distinct shingles of the template that lie in one window of its length and
    a stride around it; PERCENT of n_shingles or more make a match. Templates of fewer than five
    words are ignored. Null, empty and shorter texts match nothing. Rows that repeat an id are taken
    together; rows with a null id keep it, as one. Templates with the same name are all tried. Empty
    tables give no rows; other columns are ignored.
    """
    known = prepared(licenses)
    slices = max(1, -(-(known.agg(F.sum(F.greatest(F.size("t"), F.lit(BANDS)))).first()[0] or 0) // BROADCAST_SHINGLES))
    texts = texts_of(docs, id_col, text)
    found = None
    for part in range(slices):
        own = known.where(F.pmod(F.col("entry"), F.lit(slices)) == part)
        each = _retrieved(_windows(_places(texts, own)), own)
        found = each if found is None else found.unionByName(each)
    best = found.groupBy("doc", "license", "n_shingles").agg(F.max("n_matched").alias("n_matched"))
    return best.select(F.col("doc").alias(id_col), "license", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_matched").cast("long").alias("n_matched"))


def _places(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, h, p, len): where a text holds a deciding shingle of a template of len words."""
    shared = known.select(F.explode(_deciding("t")).alias("s"), "len").groupBy("s").agg(F.collect_set("len").alias("lens"))
    last = F.size("h") - WORDS
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hits = texts.withColumn("p", F.explode_outer(places)).where("p is not null").withColumn("s", _shingle("h", "p"))
    return hits.join(F.broadcast(shared), "s").select("doc", "h", "p", F.explode("lens").alias("len"))


def _windows(hits: DataFrame) -> DataFrame:
    """(doc, len, w, i, o): the grid's windows around the places, with shingles inside and around them."""
    stride = F.greatest(F.lit(1), F.floor((F.col("len") - WORDS + 1) / STRIDE).cast("int"))
    # the windows of the grid that hold the shingle at p
    final = F.floor(F.col("p") / F.col("stride")).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - (F.col("len") - WORDS)) / F.col("stride")).cast("int"))
    grid = F.explode(F.sequence(first, F.greatest(first, final)))
    laid = hits.withColumn("stride", stride).withColumn("w", grid)
    laid = laid.withColumn("from", F.greatest(F.lit(0), (F.col("w") - 1) * F.col("stride")))
    upto = F.least(F.size("h"), (F.col("w") + 1) * F.col("stride") + F.col("len"))
    laid = laid.select("doc", "len", "w", "stride", "from", F.slice("h", F.col("from") + 1, upto - F.col("from")).alias("around"))
    laid = laid.dropDuplicates(["doc", "len", "w", "around"])
    start = F.col("w") * F.col("stride") - F.col("from")
    lastest = F.least(F.size("around") - WORDS, start + F.col("len") - WORDS)
    inside = F.when(lastest >= start, F.transform(F.sequence(start, lastest), lambda p: _shingle("around", p)))
    outside = F.transform(F.sequence(F.lit(0), F.size("around") - WORDS), lambda p: _shingle("around", p))
    laid = laid.where(F.size("around") >= WORDS).select("doc", "len", "w", inside.alias("i"), F.array_distinct(outside).alias("o"))
    return laid.where("i is not null")


def _retrieved(windows: DataFrame, known: DataFrame) -> DataFrame:
    """The templates whose bands windows meet, and that are verified around them."""
    banded = windows.select("doc", "len", "w", "o", F.explode(F.array_distinct(_bands("i"))).alias("band"))
    keyed = known.select("entry", "len", F.explode(_bands("t")).alias("band"))
    met = banded.join(F.broadcast(keyed), ["len", "band"]).join(F.broadcast(known.select("entry", "license", "t")), "entry")
    matched = F.size(F.array_intersect("t", "o"))
    met = met.select("doc", "license", F.size("t").alias("n_shingles"), matched.alias("n_matched"))
    return met.where(100 * F.col("n_matched") >= PERCENT * F.col("n_shingles"))
