"""License scans by a positional rare-token index, in DataFrame expressions only.

Templates are notices of licences. The index has, for the words of highest inverse
document frequency of each template (function words aside), where in the template
they stand. A text's
words that are in the index are its rarest licence words; each gives, for every
posting, the place where the template would begin. Places of a template that lie
within SLACK words of each other are one alignment, and its evidence is the share
of the template's rare weight whose positions it has. With enough evidence the
alignment's window of the text must also hold every mandatory phrase of the
template; then its label is found.

Base phrases go through the same index: the rarest word of a phrase is looked up,
gives the place where the phrase would begin, and every word is verified there.

Alignments come from one sorted list, so the work grows with the text: a text
full of licence words costs its hits times the few postings of a word.

Edge cases: a null text counts as empty (no words, no labels, score 0); repeated
rows give equal rows; an empty table gives an empty table; other columns are not
read. Words are runs of digits, letters and characters beyond ASCII; only A-Z are
lowered, so letters that other rules would fold (the Kelvin sign) stay apart.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lowered.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a template that the index keeps, words that parts of a template may be shifted by, and the least evidence.
RARE_WORDS, SLACK, EVIDENCE = 8, 3, 0.6


#: Function words of English, which are rare in no text, so that the index leaves them out.
COMMON = "a all and any are as at be by for has in into is it no of on or that the this to use which will with without you"


@dataclass(frozen=True)
class Template:
    """A notice, the label it stands for, and phrases without which it does not."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return words_of(self.text)


#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening notices of common licences, as their authors give them.
TEMPLATES = (
    Template("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3", ("gnu affero general public license",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template("artistic-2", "distributed under the terms of the Artistic License 2.0", ("artistic license 2",)),
    Template("boost-1", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "following conditions")),
    Template("bsd", "Use of this source code is governed by a BSD-style license", ("bsd style license",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", ("cc0 1 0",)),
    Template("epl-2", "are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Template("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge", "permission is hereby granted")),
    Template("mit", "Released under the MIT License", ("the mit license",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("license identifier mit",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages", ("express or implied warranty",)),
)


def words_of(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


@dataclass(frozen=True)
class Index:
    """Postings (template, position) by word, weights by template and position, and weights in all by template."""

    postings: dict[str, list[tuple[int, int]]]
    weights: list[list[int]]
    totals: list[int]
    anchors: list[int]


def build_index(templates: tuple[Template, ...], phrases: dict[str, str]) -> Index:
    """Inverse document frequencies over the templates, in thousandths; a phrase's anchor is its rarest word."""
    seen = Counter(w for t in templates for w in set(t.words))
    idf = lambda w: round(1000 * math.log((len(templates) + 1) / max(1, seen[w])))
    postings: dict[str, list[tuple[int, int]]] = {}
    weights = []
    for k, t in enumerate(templates):
        telling = [p for p, w in enumerate(t.words) if w not in COMMON.split()]
        rarest = sorted(telling, key=lambda p: (-idf(t.words[p]), p))[:RARE_WORDS]
        weights.append([idf(w) if p in rarest else 0 for p, w in enumerate(t.words)])
        for p in sorted(rarest):
            postings.setdefault(t.words[p], []).append((k, p))
    anchors = []
    for phrase in phrases:
        words = words_of(phrase)
        anchors.append(min(range(len(words)), key=lambda p: (-idf(words[p]), p)))
        postings.setdefault(words[anchors[-1]], [])
    return Index(postings, weights, [sum(w) for w in weights], anchors)


def words_in(text: Column) -> Column:
    """The words of a text with A-Z lowered. Cutting between words is several times faster than extracting them."""
    parts = F.split(F.translate(text, UPPER, LOWER), BETWEEN_WORDS, -1)
    blank = lambda p, i: F.when(F.element_at(p, i) == "", 1).otherwise(0)

    def trimmed(p: Column) -> Column:
        return F.slice(p, blank(p, 1) + 1, F.greatest(F.size(p) - blank(p, 1) - blank(p, -1), F.lit(0)))

    return F.element_at(F.transform(F.array(parts), trimmed), 1)


def _ints(values: list) -> Column:
    return F.expr(str(values).replace("[", "array(").replace("]", ")"))


def _constant(values: list[Column], kind: str) -> Column:
    return F.array(*values).cast(f"array<{kind}>")


HITS, POSTED, ALIGNED = "array<struct<i:int,w:string>>", "array<struct<t:int,p:int>>", "array<struct<t:int,o:int,p:int>>"
FOUND = "array<struct<t:int,label:string,start:int,end:int,score:double>>"


def hits(words: Column, index: Index) -> Column:
    """Places and forms of the words that the index has."""
    places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(list(index.postings)), i)))
    return F.transform(places, lambda i: F.struct(i.alias("i"), F.get(words, i).alias("w"))).cast(HITS)


def phrase_starts(found: Column, words: Column, phrase: str, anchor: int) -> Column:
    """Where a phrase's words stand one after the other."""
    own = words_of(phrase)
    begins = F.transform(F.filter(found, lambda h: h["w"] == own[anchor]), lambda h: h["i"] - anchor)

    def stands(s: Column) -> Column:
        every = F.lit(True)
        for p, w in enumerate(own):
            every = every & F.coalesce(F.get(words, s + p) == w, F.lit(False))
        return every

    return F.filter(begins, stands)


def aligned(found: Column, index: Index) -> Column:
    """For each hit and posting the template, where it would begin, and the position; in this order."""
    posted = [F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in rows)).cast(POSTED) for rows in index.postings.values()]
    table = F.map_from_arrays(F.array(*map(F.lit, index.postings)), F.array(*posted))

    def of(h: Column) -> Column:
        return F.transform(table[h["w"]], lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["p"]).alias("o"), q["p"].alias("p")))

    return F.array_sort(F.flatten(F.transform(found, of)).cast(ALIGNED))


def alignments(posted: Column) -> Column:
    """Neighbours of aligned() of one template within SLACK words: template, first and last begin, positions."""

    def fresh(k: Column) -> Column:
        now, before = F.get(posted, k), F.get(posted, k - 1)
        return (k == 0) | (now["t"] != before["t"]) | (now["o"] > before["o"] + SLACK)

    def of(begins: Column) -> Column:
        def one(k: Column, n: Column) -> Column:
            stop = F.coalesce(F.get(begins, n + 1), F.size(posted))
            return F.struct(
                F.get(posted, k)["t"].alias("t"),
                F.get(posted, k)["o"].alias("low"),
                F.get(posted, stop - 1)["o"].alias("high"),
                F.array_distinct(F.transform(F.slice(posted, k + 1, stop - k), lambda x: x["p"])).alias("ps"),
            )

        return F.transform(begins, one)

    some = F.filter(F.sequence(F.lit(0), F.size(posted) - 1), fresh)
    none = F.array().cast("array<struct<t:int,low:int,high:int,ps:array<int>>>")
    return F.when(F.size(posted) > 0, F.element_at(F.transform(F.array(some), of), 1)).otherwise(none)


def verified(groups: Column, words: Column, templates: tuple[Template, ...], index: Index) -> Column:
    """Alignments with enough evidence whose window holds all mandatory phrases, as (template, label, start, end, score)."""
    weights, totals = _ints(index.weights), _ints(index.totals)
    sizes = _ints([len(t.words) for t in templates])
    labels = _constant([F.lit(t.label) for t in templates], "string")
    keys = F.array(*(F.array(*(F.lit(f" {' '.join(words_of(p))} ") for p in t.phrases)) for t in templates))

    def scored(g: Column) -> Column:
        weight = F.aggregate(g["ps"], F.lit(0), lambda acc, p: acc + F.get(F.get(weights, g["t"]), p))
        start = F.greatest(g["low"] - SLACK, F.lit(0))
        end = F.least(g["high"] + F.get(sizes, g["t"]) + SLACK, F.size(words))
        return F.struct(g["t"].alias("t"), F.get(labels, g["t"]).alias("label"), start.alias("start"), end.alias("end"), (weight / F.get(totals, g["t"])).alias("score"))

    def holds(g: Column) -> Column:
        window = F.concat(F.lit(" "), F.array_join(F.slice(words, g["start"] + 1, F.greatest(g["end"] - g["start"], F.lit(0))), " "), F.lit(" "))
        return F.element_at(F.transform(F.array(window), lambda w: F.forall(F.get(keys, g["t"]), lambda k: F.contains(w, k))), 1)

    strong = F.filter(F.transform(groups, scored).cast(FOUND), lambda g: g["score"] >= EVIDENCE)
    return F.filter(strong, holds)


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Base places, labels and evidence of every row of df (doc_id, text); found has every alignment that was verified."""
    index = build_index(templates, phrases)
    rows = df.select("doc_id", words_in(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.withColumn("hits", hits(F.col("words"), index))
    starts = [phrase_starts(F.col("hits"), F.col("words"), p, a) for p, a in zip(phrases, index.anchors)]
    rows = rows.withColumn("starts", F.array(*starts)).withColumn("posted", aligned(F.col("hits"), index))
    rows = rows.withColumn("groups", alignments(F.col("posted")))
    rows = rows.withColumn("found", verified(F.col("groups"), F.col("words"), templates, index))
    places = F.flatten("starts")
    labels = _constant([F.lit(x) for x in phrases.values()], "string")
    base = F.array_compact(F.transform("starts", lambda s, k: F.when(F.size(s) > 0, F.get(labels, k))))
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda g: g["score"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.transform("found", lambda g: g["label"]))).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(best).alias("score"),
        "found",
    )
