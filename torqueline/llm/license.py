"""License scan by diagonal voting, in DataFrame and SQL functions only.

All rolling three-word grams of all texts are hashed and joined to the gram positions of a fixed set of license texts. A hit
says that text word i equals template word j, so hits of one passage share the diagonal i - j. Hits are counted per diagonal;
a diagonal with the most votes within ``max_shift`` of it takes its neighbours with it as one passage (words inserted or left
out move the diagonal); a passage counts when its verified template words cover ``min_cover`` of the template. Passages of a
text compete: the one with the best cover stays (then that with most votes, then the first template), and whatever overlaps
it by half or more goes, so notices that differ in one word give one label. Short phrases must be covered whole on one
diagonal; they stay whatever else is found.

Texts are split into words once; one stored table holds a row per text and a row per hit.

Defined cases: null text is empty and has no words; repeated rows of one id and text each get the same result; a null id is
kept as an id; an empty table gives an empty result; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folded_words, stored, workspace

GRAM = 3

#: Phrases with their labels; a place is where the words stand consecutively.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Well-known license notices, openings and whole texts, as words.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def templates(spark: SparkSession) -> DataFrame:
    """``tpl, label, exact, t_words, tpos, gram``: the gram positions of the license texts, a few hundred rows."""
    texts = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]
    rows = ", ".join(f"({i}, '{label}', '{text}', {str(exact).lower()})" for i, (label, text, exact) in enumerate(texts))
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(tpl, label, words, exact)").withColumn("w", F.split("words", " "))
    return df.select("tpl", "label", "exact", F.size("w").alias("t_words"), F.posexplode(grams(F.col("w"))).alias("tpos", "g")).select(
        "tpl", "label", "exact", "t_words", "tpos", gram_hash(F.col("g")).alias("gram"), F.col("g").alias("t_g")
    )


def grams(words: Column) -> Column:
    n = F.greatest(F.size(words) - (GRAM - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, k + 1, n) for k in range(GRAM)])


def gram_hash(gram: Column) -> Column:
    return F.xxhash64(*[gram.getField(str(k)) for k in range(GRAM)])


def scan_licenses(docs: DataFrame, id_col="doc_id", text_col="text", max_shift=6, min_cover=0.6) -> DataFrame:
    """One row per input row: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score, passages``.

    ``n_base, first_word, last_word`` describe the places of :data:`PHRASES`; ``labels`` adds those of notices found by
    voting; ``score`` is the best covered share of a template; ``passages`` lists (label, first, last, cover)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    each = docs.select("id", F.xxhash64("id", F.md5("text")).alias("row_key"), folded_words(F.col("text")).alias("w"))
    each = each.select("id", "row_key", F.size("w").cast("long").alias("n_words"), grams(F.col("w")).alias("g"))

    tpl = F.broadcast(templates(spark))  # fixed size: the texts above
    # Place 0 stands for the text itself, place i + 1 for the gram at word i.
    own = F.array(F.lit(None).cast(each.schema["g"].dataType.elementType))
    places = each.select("id", "row_key", "n_words", F.posexplode(F.concat(own, "g")).alias("place", "g"))
    found = places.withColumn("gram", F.when(F.col("place") > 0, gram_hash(F.col("g")))).join(tpl, "gram", "left")
    found = found.where((F.col("place") == 0) | (F.col("g") == F.col("t_g"))).select(
        "id", "row_key", "place", F.when(F.col("place") == 0, F.col("n_words")).alias("n_words"), "tpl", "label", "exact", "t_words", "tpos")
    found = stored(found, workspace(spark, "license") + "/hits")

    # Votes of a diagonal: a repeated row votes for the same positions again, so positions count once.
    keys = ["id", "row_key", "tpl", "label", "exact", "t_words"]
    pos = F.col("place") - 1
    hits = found.where("place > 0").select(*keys, pos.alias("pos"), "tpos", (pos - F.col("tpos")).alias("diagonal")).distinct()
    votes = hits.groupBy(*keys, "diagonal").agg(F.count("*").alias("votes"))

    base = votes.where("exact and votes = t_words - 2").groupBy("id", "row_key").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"),
        F.collect_set("label").alias("base_set"),
    )
    near = Window.partitionBy(*keys).orderBy("diagonal").rangeBetween(-max_shift, max_shift)
    anchors = votes.where("not exact").withColumn("most", F.max("votes").over(near)).where("votes = most")
    # Each anchor with the diagonals beside it; null ids are equal.
    joined = ("id", "row_key", "tpl")
    beside = hits.where("not exact").select(*[F.col(k).alias(f"h_{k}") for k in joined], "pos", "tpos", F.col("diagonal").alias("h_diagonal"))
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"h_{k}")), joined, F.col("d") == F.col("h_diagonal"))
    band = anchors.select(*keys, "diagonal", F.explode(F.sequence(F.col("diagonal") - max_shift, F.col("diagonal") + max_shift)).alias("d"))
    # Verification: the distinct template words that a passage covers, gram by gram.
    spans = band.join(beside, same).select(*keys, "diagonal", "pos", F.explode(F.sequence("tpos", F.col("tpos") + GRAM - 1)).alias("tword"))
    verified = spans.groupBy(*keys, "diagonal").agg(
        F.count_distinct("tword").alias("n"), F.count_distinct("pos").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"))
    verified = verified.withColumn("cover", F.col("n") / F.col("t_words")).where(F.col("cover") >= min_cover)
    passage = F.struct((-F.col("cover")).alias("order"), (-F.col("votes")).alias("fewer"), "tpl", "first", "last", "label", "cover")
    chosen = verified.groupBy("id", "row_key").agg(winners(F.sort_array(F.collect_list(passage))).alias("won"))  # a text's own passages
    chosen = chosen.select(
        "id", "row_key", F.array_distinct(F.transform("won", lambda p: p["label"])).alias("found_set"), F.array_max(F.transform("won", lambda p: p["cover"])).alias("cover"),
        F.sort_array(F.transform("won", lambda p: F.struct(p["label"].alias("label"), p["first"].alias("first"), p["last"].alias("last"), p["cover"].alias("cover")))).alias("passages"),
    )
    rows = found.where("place = 0").select("id", "row_key", "n_words")
    result = with_key(with_key(rows, base, "b"), chosen, "f")
    none = F.array().cast("array<string>")
    base_set, found_set = F.coalesce("base_set", none), F.coalesce("found_set", none)
    return result.select(
        "id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_set), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_set, found_set)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).cast("double").alias("score"),
        F.coalesce("passages", F.array().cast("array<struct<label:string,first:int,last:int,cover:double>>")).alias("passages"),
    )


def winners(passages: Column) -> Column:
    """Those of ``passages``, best first, that no better one overlaps by half of the shorter of both or more."""

    def step(kept: Column, p: Column) -> Column:
        def rival(k: Column) -> Column:
            common = F.least(k["last"], p["last"]) - F.greatest(k["first"], p["first"]) + 1
            return 2 * common >= F.least(k["last"] - k["first"], p["last"] - p["first"]) + 1

        return F.when(F.exists(kept, rival), kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(passages, F.slice(passages, 1, 0), step)


def with_key(rows: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """Left join on (id, row_key), where null ids are equal."""
    more = more.withColumnsRenamed({"id": f"{name}_id", "row_key": f"{name}_key"})
    same = (F.col("row_key") == F.col(f"{name}_key")) & F.col("id").eqNullSafe(F.col(f"{name}_id"))
    return rows.join(more, same, "left").drop(f"{name}_id", f"{name}_key")
