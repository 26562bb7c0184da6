"""License texts inside documents. DataFrame functions only.

Words are runs of letters and digits, lower-cased. Templates are grouped by their length; for each group a document is cut
into overlapping windows, long enough and close enough together that any place where a template stands lies whole in one.

1. *Retrieve.* Each window and each template gets the smallest value of its shingles under each of ``bands`` hash functions,
   one a band. A window of ``w`` shingles that holds a share ``c`` of a template shares ``J = c * t / (w + (1 - c) * t)`` of their
   union at least, so ``bands`` is set for each group to let a match at the threshold slip with probability ``miss`` at most.
2. *Verify.* A window that shares a band with a template must hold ``similarity`` of the template's distinct shingles.

Only windows that can match are made. A document that holds ``similarity`` of a template's ``t`` shingles holds at least one of
any ``t - ceil(similarity * t) + 1`` of them, and looking for those as plain text is exact and cheap; of what is left, windows
without any shingle of a template are passed over.

Shingles have five words (a template of fewer words is one shingle). Defined results: null and empty texts match nothing; a
null ``doc_id`` is kept; repeated rows, of one id or of none, each have rows of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import literal_table, settle

SHINGLE = 5
#: How many times longer than its template a copy may have become by words put in.
STRETCH = 1.5
SPLIT = r"[^\p{L}\p{N}]+"
# Notices as their authors ask for them, common short forms, and short licenses in full.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: str) -> list[str]:
    """Words of a template; the same rule as SPLIT for the letters that templates have."""
    return re.findall(r"[^\W_]+", text.lower())


def groups(templates: Mapping[str, str], similarity: float, miss: float, stretch: float = STRETCH) -> dict[int, dict]:
    """Per template length in words: shingle length, window length, stride and number of bands.

    A window has room for ``stretch`` times the template, so a copy with words put in still lies whole in one.
    """
    out = {}
    for name, text in templates.items():
        w = words(text)
        if not w:
            raise ValueError(f"template {name} has no words")
        k = min(SHINGLE, len(w))
        t = len(w) - k + 1
        stride = max(1, t // 4)
        room = len(w) if t == 1 else math.ceil(stretch * len(w))
        window = room + stride - 1
        jaccard = similarity * t / (window - k + 1 + (1 - similarity) * t)
        bands = 1 if t == 1 else math.ceil(math.log(miss) / math.log(1 - jaccard))
        out.setdefault(len(w), {"k": k, "window": window, "stride": stride, "bands": bands})
    return out


def anchors(templates: Mapping[str, str], similarity: float) -> list[str]:
    """Word sequences of which every document with a match holds at least one."""
    out = []
    for text in templates.values():
        w = words(text)
        k = min(SHINGLE, len(w))
        shingles = list(dict.fromkeys(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)))
        spare = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
        step = len(shingles) / spare
        out += [shingles[int(i * step)] for i in range(spare)]
    return sorted(set(out))


def _shingled(words, k: int):
    """Hashes of the runs of ``k`` words of an array column."""
    at = lambda i: F.get(words, i)
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(at(i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _keys(shingles, bands: int):
    """One key a band: the smallest value of the shingles under the band's hash function."""

    def key(b: int):
        return F.xxhash64(F.lit(b), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(b)))))

    return F.array(*map(key, range(bands)))


def library(spark: SparkSession, templates: Mapping[str, str], similarity: float, miss: float) -> DataFrame:
    """``(license, length, items, keys)``: the templates' distinct shingles and band keys, made by the same functions."""
    parts = []
    for length, g in groups(templates, similarity, miss).items():
        rows = [{"license": n, "length": length, "words": words(t)} for n, t in templates.items() if len(words(t)) == length]
        d = literal_table(spark, rows, T._parse_datatype_string("license string, length int, words array<string>"))
        d = d.withColumn("items", F.array_distinct(_shingled(F.col("words"), g["k"])))
        parts.append(d.select("license", "length", "items", _keys(F.col("items"), g["bands"]).alias("keys")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _places(shingles, wanted: list[int]) -> Column:
    """Positions of the wanted shingles."""
    return F.filter(F.transform(shingles, lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row: filters on them stay above, where they would else repeat them inside themselves."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_made")
    return df.select("*", made).select(*df.columns, "_made.*")


def scan(docs: DataFrame, *, templates: Mapping[str, str] = TEMPLATES, similarity: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """``(doc_id, license, first_word, last_word, containment)``: each license a row holds, and its best place.

    ``first_word`` and ``last_word`` (exclusive) bound what the earliest of the windows that hold most of the template has of it.
    """
    spark = docs.sparkSession
    made = library(spark, templates, similarity, miss)
    rows = made.collect()  # the templates given, nothing of the corpus
    known = literal_table(spark, rows, made.schema)
    plain = _barrier(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _w=F.split(F.lower(F.coalesce("text", F.lit(""))), SPLIT)).select("doc_id", "_w")
    plain = _barrier(plain, _t=F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))
    may = F.lit(False)
    for a in anchors(templates, similarity):
        may = may | F.col("_t").contains(f" {a} ")
    # rows of a checkpoint are the same at each reading, so their numbers are too
    able = settle(plain.where(may).select("doc_id", F.array_remove("_w", "").alias("_w"))).withColumn("row", F.monotonically_increasing_id())
    per = groups(templates, similarity, miss)
    lengths = {k: [n for n, g in per.items() if g["k"] == k] for k in sorted({g["k"] for g in per.values()})}
    items = {n: sorted({x for r in rows if r["length"] == n for x in r["items"]}) for n in per}
    able = _barrier(able, **{f"_s{k}": _shingled(F.col("_w"), k) for k in lengths})
    able = _barrier(able, **{f"_h{k}": _places(F.col(f"_s{k}"), sorted({x for n in own for x in items[n]})) for k, own in lengths.items()})

    def windows(length: int, g: dict) -> Column:
        """The windows that hold any shingle of the templates of one length, each with its band keys: no other can match."""
        s, width, stride = F.col(f"_s{g['k']}"), g["window"] - g["k"] + 1, g["stride"]
        hits = F.filter(f"_h{g['k']}", lambda i: F.get(s, i).isin(items[length]))
        around = lambda i: F.sequence(F.greatest(F.lit(0), F.ceil((i - (width - 1)) / stride)).cast("int"), F.floor(i / stride).cast("int"))
        starts = F.transform(F.array_distinct(F.flatten(F.transform(hits, around))), lambda m: m * stride)
        cut = F.transform(starts, lambda i: F.struct(F.lit(length).alias("length"), i.alias("at"), F.slice(s, i + 1, F.lit(width)).alias("items"), F.lit(g["k"]).alias("k")))
        return F.transform(cut, lambda x: x.withField("keys", F.array_distinct(_keys(x["items"], g["bands"]))))

    cut = able.select("doc_id", "row", F.explode(F.concat(*(windows(n, g) for n, g in per.items()))).alias("_x")).select("doc_id", "row", "_x.*")
    keyed = cut.withColumn("key", F.explode("keys")).where(F.col("key").isin(sorted({k for r in rows for k in r["keys"]})))
    of = known.select("license", F.col("length").alias("_length"), F.col("items").alias("want"), F.explode(F.array_distinct("keys")).alias("_key"))
    met = keyed.join(of, (F.col("key") == F.col("_key")) & (F.col("length") == F.col("_length"))).withColumn("containment", F.size(F.array_intersect("items", "want")) / F.size("want"))
    own = F.transform("items", lambda x, i: F.when(F.array_contains("want", x), i))
    met = met.where(F.col("containment") >= similarity).select("doc_id", "row", "license", "at", "containment", (F.col("at") + F.array_min(own)).alias("first"), (F.col("at") + F.array_max(own) + F.col("k")).alias("last"))
    best = F.min(F.struct((-F.col("containment")).alias("minus"), "at", "first", "last")).alias("best")
    return met.groupBy("row", "license").agg(F.first("doc_id").alias("doc_id"), best).select(
        "doc_id", "license", F.col("best.first").cast("bigint").alias("first_word"), F.col("best.last").cast("bigint").alias("last_word"), (-F.col("best.minus")).alias("containment")
    )
