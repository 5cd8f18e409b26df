"""License scans by diagonal voting (native).

Templates are licence notices as word sequences. Every document's rolling word k-gram hashes are
joined to the templates' positions. A hit votes for the diagonal (document position minus
template position) of its template; a verbatim copy puts all its votes on one diagonal, an
edited one on neighbouring ones, which are merged. A span is verified by the share of the
template's words that its votes, each confirmed word by word, cover on these diagonals.

Base phrases are templates of their own that must be covered whole, on one diagonal.

Main path: DataFrame functions only. K-grams are made inside a row, and only hits and one row
per document leave the join, whose template side is a constant table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: Phrase and label of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wording of public licence notices, lower-cased words only, by label.
NOTICES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "gpl-2.0": [
        "licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-4.0": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0-1.0": ["dedicated to the public domain under cc0 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

#: Words in a gram: of base phrases, and of notices.
BASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals at most this far apart belong to one span.
NEAR = 4
#: Share of a notice's words that a span must cover.
COVER = 0.8
#: A larger template table is joined by shuffle.
BROADCAST_ROWS = 100_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows(base: dict[str, str] = BASE, notices: dict[str, list[str]] = NOTICES) -> list[tuple]:
    """(gram, template, label, is_base, n words, position) for all positions of all templates."""
    rows, number = [], 0
    for texts, is_base in (([(p, label) for p, label in base.items()], True), ([(t, label) for label, ts in notices.items() for t in ts], False)):
        for text, label in texts:
            words, k = text.split(), BASE_GRAM if is_base else NOTICE_GRAM
            rows += [(" ".join(words[i : i + k]), number, label, is_base, len(words), i) for i in range(len(words) - k + 1)]
            number += 1
    return rows


def templates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The template table: a constant, broadcast up to BROADCAST_ROWS rows of one gram each."""
    df = spark.createDataFrame(rows, "gram string, template int, label string, is_base boolean, n_template int, at int")
    # One more row meets one more gram of each document, so that none without hits is lost.
    df = df.withColumn("hash", F.xxhash64("gram")).unionByName(spark.range(1).select(F.lit(_DOCUMENT).alias("hash")), allowMissingColumns=True)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


_DOCUMENT = 0


def _grams(k: int) -> Column:
    n = F.greatest(F.size("words") - (k - 1), F.lit(0))
    return F.transform(F.slice("words", F.lit(1), n), lambda w, i: F.xxhash64(F.concat_ws(" ", w, *[F.get("words", i + j) for j in range(1, k)])))


def license_votes(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    """doc_id, key, n_words and, for each confirmed hit, template, label, is_base, n_template, at, place."""
    spark = docs.sparkSession
    df = docs.select("doc_id", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))).alias("key"), F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0)).alias("words"))
    df = df.withColumn("grams", F.concat(F.array(F.lit(_DOCUMENT).cast("long")), _grams(BASE_GRAM), _grams(NOTICE_GRAM)))
    n_base = F.greatest(F.size("words") - (BASE_GRAM - 1), F.lit(0))
    # Outer, for no other reason than that an inner one has its rows filtered by size(grams) first;
    # that filter would be pushed below the words and extract them anew for every gram.
    hits = df.select("doc_id", "key", "words", F.posexplode_outer("grams").alias("i", "hash")).join(templates(spark, rows), "hash")
    place = F.when(F.col("i") > n_base, F.col("i") - 1 - n_base).otherwise(F.col("i") - 1)
    hits = hits.withColumn("place", place).withColumn("k", F.when(F.col("is_base"), BASE_GRAM).otherwise(NOTICE_GRAM))
    # The hash of a gram brought it here; its words decide. The document's own row has place -1.
    own = F.col("i") == 0
    same = (F.col("i") > n_base) != F.col("is_base")
    hits = hits.where((own & F.col("template").isNull()) | (~own & same & (F.array_join(F.slice("words", F.greatest(F.col("place"), F.lit(0)) + 1, F.coalesce("k", F.lit(1))), " ") == F.col("gram"))))
    return hits.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "template", "label", "is_base", "n_template", "at", F.when(~own, F.col("place")).alias("place"))


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased. n_base counts the places where a base phrase's words stand consecutively,
    first_word and last_word are their smallest and largest start (null without any). labels has
    those of the base and of notices that are covered; score is the largest share of a
    template's words that a span covers, 1 with any base phrase, 0 without votes.

    Null texts count as empty, with no words and no labels. Null ids are carried through.
    Repeated rows (id and text) are scanned as one and each returned. Texts are read whole. An
    empty table gives an empty one. Other columns are ignored.
    """
    votes = license_votes(docs, template_rows(base, notices))
    # All votes of a document together, once: the shuffle has a row per document and per hit.
    keys = ["key", "doc_id", "n_words"]
    votes = votes.withColumn("diagonal", F.col("place") - F.col("at"))
    diagonals = votes.groupBy(*keys, "template", "label", "is_base", "n_template", "diagonal").agg(F.collect_set("at").alias("ats"), F.count("*").alias("rows"))
    # Neighbouring diagonals of a notice are one span; those of a base phrase stay apart.
    ordered = F.array_sort(F.collect_list(F.struct("diagonal", "ats")))
    merged = diagonals.groupBy(*keys, "template", "label", "is_base", "n_template").agg(ordered.alias("ds"), F.max("rows").alias("rows"))
    k = F.when(F.col("is_base"), BASE_GRAM).otherwise(NOTICE_GRAM)
    covered = lambda ats: F.size(F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + k - 1))))) / F.col("n_template")
    # The open span and the best share so far, never a list of spans: the work is linear in the hits.
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("ats"), F.lit(0.0).alias("best"))

    def step(open_span: Column, d: Column) -> Column:
        near = F.coalesce(d["diagonal"] - open_span["last"] <= NEAR, F.lit(False))
        joined = F.struct(d["diagonal"].alias("last"), F.array_union(open_span["ats"], d["ats"]).alias("ats"), open_span["best"].alias("best"))
        alone = F.struct(d["diagonal"].alias("last"), d["ats"].alias("ats"), F.greatest(open_span["best"], covered(open_span["ats"])).alias("best"))
        return F.when(near, joined).otherwise(alone)

    share = F.aggregate("ds", start, step, lambda x: F.greatest(x["best"], covered(x["ats"])))
    merged = merged.withColumn("share", F.when(F.col("template").isNotNull() & ~F.col("is_base"), share))
    whole = F.transform(F.filter("ds", lambda d: F.size(d["ats"]) == F.col("n_template") - (BASE_GRAM - 1)), lambda d: d["diagonal"])
    merged = merged.withColumn("places", F.when(F.col("is_base"), whole))
    is_base, found = F.col("is_base"), F.size("places") > 0
    base_label = F.when(is_base & found, F.col("label"))
    label = F.when(is_base & found | ~is_base & (F.col("share") >= COVER), F.col("label"))
    out = merged.groupBy(*keys).agg(
        F.sum(F.when(is_base, F.size("places")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base_label)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.round(F.max(F.when(is_base, F.when(found, 1.0).otherwise(0.0)).otherwise(F.coalesce("share", F.lit(0.0)))), 6).alias("score"),
        # A repeated row repeats its document's own row.
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.coalesce("score", F.lit(0.0)).alias("score"))
