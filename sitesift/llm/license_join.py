"""License scan as an exact set-similarity join, in DataFrame operations only.

Templates are whole notices and short phrases. Each has its stride: ``STRIDE``
words, or its own length if that is more. Text blocks are two strides long and
start every stride, so any run of a stride's words lies whole in some block. A
template matches a block that contains at least ``PERCENT`` percent of its
distinct words; one of fewer than ``WHOLE`` distinct words needs all of them,
as the word that tells the license may be the one that lacks. The join is
exact by these filters:

* prefix: template words are ordered by how often they occur in all documents,
  rarest first; a matching block must hold one of the first
  ``size - need + 1`` of them, so only those are probed;
* length: a block with fewer distinct words than needed cannot match;
* positional: with the probed word at rank r, at most ``size - r`` words of
  the template can still be shared (earlier ranks are probed themselves).

Candidates are verified on the block's words at once, in the row; the places
of the three base phrases are then read off the candidate blocks, each place
counted in the one block in whose first half it starts.

Templates are configuration (bounded), so their words are the broadcast side.
Each document carries an end mark through the pass and needs no second join.

Defined cases: a null or empty text, or one without words, has no labels and
score 0. Repeated rows each give a row; two texts under one doc_id stay apart.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import written
from ._words import END_MARK, hashed

STRIDE = 32
PERCENT, WHOLE = 80, 20

#: Phrase and label of the base scan.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Further templates (short notices, then whole ones) and their labels, as the words are read.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
     "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
     "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
     "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
     "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
     "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
     "other dealings in the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
     "the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
     "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
     "conditions of any kind either express or implied see the license for the specific language governing permissions and "
     "limitations under the license", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation either version 3 of the license or at your option any later version this "
     "program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
     "merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl-3"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
     "with this file you can obtain one at https mozilla org mpl 2 0", "mpl-2"),
)


def _needed(size: int) -> int:
    return size if size < WHOLE else math.ceil(PERCENT * size / 100)


def stride(text: str) -> int:
    return max(STRIDE, len(text.split()))


def _places(hashes: DataFrame) -> DataFrame:
    marked = F.array_append("h", F.lit(END_MARK))
    return hashes.select("*", F.size("h").alias("n_words"), F.posexplode(marked).alias("at", "x"))


def word_order(docs: DataFrame, words: list[str]) -> list[str]:
    """``words`` from the rarest in all of ``docs`` to the commonest."""
    table = docs.sparkSession.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.xxhash64(F.lit(w)).alias("x")) for w in words])).alias("t"))
    found = (_places(hashed(docs)).select("x").join(F.broadcast(table.select("t.*")), "x")
             .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    seen = {r["word"]: r["n"] for r in found.collect()}  # as many rows as templates have words
    return sorted(words, key=lambda w: (seen.get(w, 0), w))


def _probes(spark, order: list[str]) -> DataFrame:
    """One row per template and prefix word, and the end mark."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t, (text, _) in enumerate(PHRASES + TEMPLATES):
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = _needed(len(words))
        rows.append(F.struct(F.lit(t).alias("t"), F.lit(need).alias("need"), F.lit(stride(text)).alias("stride"), F.lit(text).alias("text"),
                             F.lit(" ".join(words[:len(words) - need + 1])).alias("prefix")))
    hashes = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
    each = (spark.range(1).select(F.explode(F.array(*rows)).alias("p")).select("p.*")
            .select("t", "need", "stride", F.array_distinct(hashes).alias("tset"), hashes.alias("seq"),
                    F.posexplode(F.split("prefix", " ")).alias("r", "word")))
    none = F.array().cast("array<bigint>")
    end = spark.range(1).select(F.lit(END_MARK).cast("bigint").alias("x"), F.lit(-1).alias("t"), F.lit(0).alias("r"), F.lit(0).alias("need"),
                                F.lit(STRIDE).alias("stride"), none.alias("tset"), none.alias("seq"))
    return each.select(F.xxhash64("word").alias("x"), "t", "r", "need", "stride", "tset", "seq").unionAll(end)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_words, t, block, share, starts): every block that meets
    the containment threshold of template ``t``, and a row with t -1 per
    document. ``starts``: places of a base phrase that this block counts."""
    words = sorted({w for text, _ in PHRASES + TEMPLATES for w in text.split()})
    probes = _probes(docs.sparkSession, word_order(docs, words))
    found = _places(hashed(docs)).join(F.broadcast(probes), "x")
    first = F.floor(F.col("at") / F.col("stride")).cast("int")
    blocks = F.when(F.col("t") < 0, F.array(F.lit(0))).otherwise(
        F.filter(F.array(first, first - 1), lambda b: b >= 0))
    cut = (found.withColumn("block", F.explode(blocks))
           .withColumn("words", F.slice("h", F.col("block") * F.col("stride") + 1, 2 * F.col("stride"))))
    distinct = F.size(F.array_distinct("words"))
    long_enough = distinct >= F.col("need")
    in_reach = 1 + F.least(F.size("tset") - F.col("r") - 1, distinct - 1) >= F.col("need")
    shared = F.size(F.array_intersect("tset", "words"))
    cut = cut.filter((F.col("t") < 0) | (long_enough & in_reach & (shared >= F.col("need"))))
    begin = F.filter(
        F.sequence(F.lit(0), F.lit(STRIDE - 1)),
        lambda p: F.slice("words", p + 1, F.size("seq")) == F.col("seq"))
    base = (F.col("t") >= 0) & (F.col("t") < len(PHRASES))
    starts = F.when(base, F.transform(begin, lambda p: p + F.col("block") * STRIDE))
    share = F.when(F.col("t") >= 0, shared / F.size("tset"))
    return cut.select("doc_id", "th", "n_words", "t", "block", share.alias("share"), starts.alias("starts"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base places, labels and score."""
    found = written(matches(docs), "license-matches")
    labels = [label for _, label in PHRASES + TEMPLATES]
    marks = found.groupBy("doc_id", "th").agg(
        F.max("n_words").cast("bigint").alias("n_words"), F.count_if(F.col("t") < 0).alias("copies"),
        F.max("share").alias("score"), F.collect_set(F.when(F.col("t") >= 0, F.col("t"))).alias("ts"))
    places = (found.filter("size(starts) > 0").select("doc_id", "th", "t", F.explode("starts").alias("at")).distinct()
              .groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("t2"))
              .agg(F.count(F.lit(1)).alias("n_base"), F.min("at").cast("bigint").alias("first_word"),
                   F.max("at").cast("bigint").alias("last_word"), F.collect_set("t").alias("bs")))
    names = F.array(*[F.lit(x) for x in labels])

    def joined(ts: str) -> Column:
        got = F.transform(F.coalesce(F.col(ts), F.array().cast("array<int>")), lambda t: F.get(names, t))
        return F.concat_ws(",", F.array_sort(F.array_distinct(got)))

    rows = marks.join(places, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
                       "first_word", "last_word", joined("bs").alias("base_labels"), joined("ts").alias("labels"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))
