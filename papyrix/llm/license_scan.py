"""Operator 3: license scan by diagonal voting.

Every rolling word k-gram hash of every document meets the k-grams of the license templates in a Spark join. A match of
document position p with template position t votes for the diagonal p - t. Votes are counted by diagonal,
neighbouring diagonals are merged into spans, and spans are verified: by the share of template words they cover, by the words
that tell the template from its sisters, and against better spans of the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 4
#: Diagonals at most this far apart belong to one span: so many words may be inserted or dropped.
NEIGHBOURS = 6
#: A span stands when its matched k-grams cover this share of the template's words...
COVER = 0.5

#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of well-known licenses (public texts), by label.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "licensed under the mit license",
    ],
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program if not see",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "bsl": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"],
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words; to split there costs a fraction of extracting them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text) -> F.Column:
    """Null as no words; A-Z in lower case; words are runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), BETWEEN), "")


def template_grams(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES, k: int = K) -> DataFrame:
    """Rows (gram_hash, gram, template, label, t, t_words, sisters, tells): a few hundred, by the templates given.

    Sisters of a template are those of other labels that share a k-gram with it and lack a word of it; ``tells`` are the sisters
    that lack a word of the gram.
    """
    texts = {f"{label}/{i}": (label, text.split()) for label, given in templates.items() for i, text in enumerate(given)}
    grams = {name: [tuple(w[t : t + k]) for t in range(len(w) - k + 1)] for name, (_, w) in texts.items()}
    rows = []
    for name, (label, w) in texts.items():
        sisters = {s: set(w) - set(v) for s, (other, v) in texts.items() if other != label and set(grams[s]) & set(grams[name])}
        sisters = {s: own for s, own in sorted(sisters.items()) if own}
        rows += [(list(g), name, label, t, len(w), list(sisters), [s for s, own in sisters.items() if own & set(g)]) for t, g in enumerate(grams[name])]
    made = spark.createDataFrame(rows, "gram array<string>, template string, label string, t int, t_words int, sisters array<string>, tells array<string>")
    return made.withColumn("gram_hash", F.xxhash64("gram"))


def _phrase_starts(w, phrase: list[str], label: str) -> F.Column:
    last = F.size(w) - len(phrase)
    at = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(w, i + 1, len(phrase)) == F.array(*map(F.lit, phrase))))
    return F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def _base_starts(w) -> F.Column:
    """Array of (start, label) of every base phrase; cheap for documents without the word they all hold."""
    found = [_phrase_starts(w, phrase.split(), label) for phrase, label in PHRASES.items()]
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(F.array_contains(w, "license"), F.concat(*found)).otherwise(none)


def _best_apart(ranked) -> F.Column:
    """Of spans, best first, those that no better one of them stands in the place of: shares half of the shorter one's words with."""
    words_of = lambda s: s["last"] - s["first"] + 1
    shared = lambda a, b: F.least(a["last"], b["last"]) - F.greatest(a["first"], b["first"]) + 1
    taken = lambda kept, s: F.exists(kept, lambda o: 2 * shared(o, s) >= F.least(words_of(o), words_of(s)))
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, s: F.when(taken(kept, s), kept).otherwise(F.concat(kept, F.array(s))))


def license_spans(docs: DataFrame, k: int = K, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, base (array of start and label) and spans.

    ``spans`` is an array of (label, template, first, last, votes, cover): a run of neighbouring diagonals, from its first
    to its last document word, with the votes it got and the share of the template's words that its matches cover. A span
    stands if it covers COVER of them, and of the words that each sister of its template lacks one at least. Of spans in one
    place that of the best cover stands (then of most votes, of the longer template, of the label and template first by name).
    Rows have results of their own, so repeated rows give repeated results. Null texts have no words. Texts of any length are
    scanned whole; other columns, whatever their names, are not read. Spans come in the order of label, template and place.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), _base_starts(F.col("w")).alias("base"))
    known = template_grams(spark, templates, k)  # as large as the templates given, whatever the corpus
    hashes = [r.gram_hash for r in known.select("gram_hash").distinct().collect()]
    count = F.greatest(F.size("w") - k + 1, F.lit(0))
    every = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.struct((i - 1).alias("p"), F.xxhash64(F.slice("w", i, k)).alias("h")))
    # Only k-grams whose hash a template has become rows. Position -1 stands for the document itself, so that one without any keeps its row.
    hits = F.when(count > 0, F.filter(every, lambda g: g["h"].isin(hashes)))
    itself = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("h")))
    grams = rows.withColumn("gram_at", F.explode(F.concat(itself, F.coalesce(hits, F.slice(itself, 1, 0)))))
    grams = grams.select("row", "doc_id", "w", "n_words", "base", "gram_at.p", "gram_at.h")
    met = grams.join(F.broadcast(known), F.col("h") == F.col("gram_hash"), "left")
    sure = (F.col("p") >= 0) & (F.slice("w", F.col("p") + 1, k) == F.col("gram"))
    met = met.filter(sure | (F.col("p") == -1))
    vote = F.when(F.col("p") >= 0, F.col("p") - F.col("t"))
    first = F.when(F.col("p") == -1, F.struct("n_words", "base"))
    votes = met.select("row", "doc_id", first.alias("doc"), F.when(F.col("p") >= 0, F.col("template")).alias("template"), "label", "t_words", vote.alias("diagonal"), "p", "t", "sisters", "tells")
    # Votes of one diagonal; one template position counts once a diagonal by nature.
    lines = votes.groupBy("row", "doc_id", "template", "label", "t_words", "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("t").alias("ts"), F.collect_set(F.when(F.size("tells") > 0, F.col("tells"))).alias("tells"), F.first("sisters").alias("sisters"), F.max("doc").alias("doc"))
    # Merging: diagonals in turn with small gaps are one family, and in a family the lines with few document words between them
    # are one span, whatever lines of other families stand there.
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    runs = lines.withColumn("family", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= NEIGHBOURS, 0).otherwise(1)).over(by))
    along = Window.partitionBy("row", "template", "family").orderBy("first", "diagonal")
    reached = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("opens", F.when(F.col("first") - reached <= k + NEIGHBOURS, 0).otherwise(1))
    runs = runs.withColumn("span", F.struct("family", F.sum("opens").over(along).alias("part")))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ts")), lambda t: F.sequence(t, t + k - 1)))))
    unmet = F.array_except(F.first("sisters"), F.flatten(F.flatten(F.collect_list("tells"))))
    spans = runs.groupBy("row", "doc_id", "template", "span").agg(F.max("label").alias("label"), F.sum("votes").alias("votes"), F.min("first").cast("long").alias("first"), (F.max("last") + k - 1).cast("long").alias("last"), covered.alias("covered"), F.max("t_words").alias("t_words"), unmet.alias("unmet"), F.max("doc").alias("doc"))
    spans = spans.withColumn("cover", F.col("covered") / F.col("t_words")).filter(F.col("template").isNull() | ((F.col("cover") >= COVER) & (F.size("unmet") == 0)))
    # Choosing: spans that share a word are one cluster, and each cluster is settled by itself. The document's own row is alone in its.
    over = Window.partitionBy("row").orderBy(F.col("first").asc_nulls_first(), "last", "template", "span")
    clear = F.when(F.col("first") <= F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    spans = spans.withColumn("cluster", clear).withColumn("cluster", F.sum("cluster").over(over))
    one = F.struct((-F.col("cover")).alias("less"), (-F.col("votes")).alias("fewer"), (-F.col("t_words")).alias("shorter"), "label", "template", "first", "last", "votes", F.round("cover", 6).alias("cover"))
    settled = spans.groupBy("row", "doc_id", "cluster").agg(F.max("doc").alias("doc"), F.array_sort(F.collect_list(F.when(F.col("template").isNotNull(), one))).alias("ranked"))
    settled = settled.withColumn("spans", F.transform(_best_apart(F.col("ranked")), lambda s: F.struct(*[s[c].alias(c) for c in ("label", "template", "first", "last", "votes", "cover")])))
    out = settled.groupBy("row", "doc_id").agg(F.max("doc").alias("doc"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return out.select("doc_id", "doc.n_words", "doc.base", "spans")


def license_digest(found: DataFrame) -> DataFrame:
    """The flat columns of ``license_spans``: counts, first and last base start, labels of either kind, score.

    The score is 1 with a base phrase, else the best cover of a span, else 0.
    """
    starts = F.transform("base", lambda b: b["start"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("spans", lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """Spans and base phrases of ``docs`` as one flat row per document; an empty table gives no rows."""
    return license_digest(license_spans(docs))
