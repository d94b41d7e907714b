"""License scans as an exact set-similarity join of text blocks with license templates.

A template is a sentence of a notice; its blocks in a text are all runs of as many words as
it has itself, over line wraps, comment marks and punctuation alike. A block matches when
it holds at least THRESHOLD of the template's distinct words. Template words are ordered
by how many documents of the whole table hold them, rarest first. A template of n words
that needs o of them must share one of its n - o + 1 rarest with a block (prefix filter).
Around each such word the blocks that hold it are looked at, as those whose rarest shared
word it is: only template words from its place in the order on count then, and the words
around it must hold o of these (positional filter), before each block, which can't be
shorter than o words (length filter), is counted exactly.

The templates are a bounded library, given or read from a table. It stands in the plan as
one constant, an array of templates with their words in order, and the join is evaluated
inside each row with array expressions: templates meet a text by the prefix words that it
has. So the plan is the same for two dozen templates and for hundreds, there is no shuffle
and no Python, whatever the number of equal texts. The only thing collected is one count
for each template word.
"""

from __future__ import annotations

import json
import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a word is, the base phrases with their labels, and sentences of public notices.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "bsd-3-clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc-by-4.0": ["This work is licensed under the Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "gpl-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-notice": ["GNU Lesser General Public License"],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "reserved-notice": ["All rights reserved"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
THRESHOLD = 0.9
#: Bytes of templates that a library may have: it is part of the plan.
LIBRARY_BYTES = 8 << 20


def words_of(template: str) -> list[str]:
    """The words of a template, A-Z lower-cased."""
    return re.findall("[^" + NOT_WORD[1:-2] + "]+", template.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def needed(words: int, threshold: float) -> int:
    """How many of a template's distinct words a block must hold."""
    return max(1, math.ceil(threshold * words - 1e-9))


def _low(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def library(table: DataFrame, label: str = "label", template: str = "template") -> dict[str, list[str]]:
    """Templates by label from a table of at most LIBRARY_BYTES; a larger one raises an error. Null labels and templates without words are left out."""
    rows = table.where(F.col(label).isNotNull() & F.col(template).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(template).alias("template"))
    size = rows.agg(F.sum(F.octet_length("label") + F.octet_length("template")).alias("n")).first()["n"] or 0
    if size > LIBRARY_BYTES:
        raise ValueError(f"{size} bytes of templates are more than {LIBRARY_BYTES}")
    found: dict[str, list[str]] = {}
    for r in sorted(rows.collect()):
        if words_of(r["template"]):
            found.setdefault(r["label"], []).append(r["template"])
    return found


def _constant(value: list, schema: str) -> Column:
    """A nested value as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def word_frequencies(df: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word of a bounded vocabulary occurs, over the whole table."""
    # words are told apart by the same classes as in the scan; lower() differs from A-Z folding only beyond ASCII
    words = df.select(F.explode(F.array_intersect(F.split(F.lower(text), NOT_WORD), _constant(vocabulary, "array<string>"))).alias("word"))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _ordered(df: DataFrame, templates: dict[str, list[str]], text: str, threshold: float) -> list[dict]:
    """Each template's label and length, how many of its distinct words a block needs, these words, rarest first, and those of the prefix."""
    words = {w for several in templates.values() for t in several for w in words_of(t)}
    count = word_frequencies(df, sorted(words), text) if words else {}
    found = []
    for label, several in sorted(templates.items()):
        for t in several:
            own = sorted(set(words_of(t)), key=lambda w: (count.get(w, 0), w))
            need = needed(len(own), threshold)
            # a word in no document at all needs no search
            prefix = [w for w in own[: len(own) - need + 1] if count.get(w)]
            if prefix:
                found.append({"label": label, "length": len(words_of(t)), "need": need, "tokens": own, "prefix": prefix})
    return found


def _best(words: Column, anchors: Column, template: Column) -> Column:
    """The largest part of a template that a block of its length holds, if that is enough; else null."""
    length, tokens = template["length"], template["tokens"]

    def around(anchor: Column) -> Column:
        later = F.slice(tokens, F.array_position(tokens, anchor["word"]).cast("int"), F.size(tokens))  # words from this place in the order on
        first = F.greatest(anchor["at"] - (length - 1), F.lit(0))
        near = F.slice(words, first + 1, anchor["at"] - first + length)
        blocks = F.transform(F.sequence(first, anchor["at"]), lambda s: F.size(F.array_intersect(F.slice(words, s + 1, length), later)))
        return F.when(F.size(F.array_intersect(near, later)) >= template["need"], F.array_max(blocks))

    held = F.array_max(F.transform(F.filter(anchors, lambda a: F.array_contains(template["prefix"], a["word"])), around))
    return F.when(held >= template["need"], held / F.size(tokens).cast("double"))


def scan(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | DataFrame | None = None,
    base: dict[str, str] | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches), one row for each row of df.

    templates is a table (label, template) or the same as a dictionary of lists. n_base
    counts the places where a base phrase's words stand consecutively; first_word
    and last_word are the smallest and largest start (words from 0, null without a place).
    matches are (label, part) of labels with a template whose best block holds at least
    threshold of its words; labels joins base and template labels, sorted. score is the
    largest part, 1 with a base label, 0 without any. Null and empty texts have no words;
    rows are independent of each other, so nulls, repeats and other columns of df don't matter.
    """
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else library(templates) if isinstance(templates, DataFrame) else templates
    known = _ordered(df, templates, text, threshold)
    phrases = {tuple(p.split()): label for p, label in base.items()}
    rows = df.select(F.col(key).alias("key"), F.array_remove(F.split(_low(F.coalesce(F.col(text), F.lit(""))), NOT_WORD), "").alias("words"))
    rare = _constant(sorted({w for t in known for w in t["prefix"]}), "array<string>")
    starts = [_starts(F.col("words"), p).alias(f"s{i}") for i, p in enumerate(phrases)]
    rows = rows.select("key", "words", F.array_intersect("words", rare).alias("present"), *starts)
    at = F.transform("words", lambda w, i: F.when(F.array_contains("present", w), F.struct(i.alias("at"), w.alias("word"))))
    none = F.array().cast("array<struct<at:int,word:string>>")
    rows = rows.select("*", F.when(F.size("present") > 0, F.array_compact(at)).otherwise(none).alias("anchors"))
    every = F.concat(*[F.col(f"s{i}") for i in range(len(phrases))])
    labels = [F.when(F.size(f"s{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]
    library_ = _constant(known, "array<struct<label:string,length:int,need:int,tokens:array<string>,prefix:array<string>>>")
    met = F.filter(library_, lambda t: F.arrays_overlap(t["prefix"], F.col("present")))
    part_of = lambda t: F.struct(t["label"].alias("label"), _best(F.col("words"), F.col("anchors"), t).alias("part"))
    found = F.when(F.size("present") > 0, F.filter(F.transform(met, part_of), lambda m: m["part"].isNotNull())).otherwise(F.array().cast("array<struct<label:string,part:double>>"))
    rows = rows.select("key", F.size("words").cast("long").alias("n_words"), every.alias("every"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("own"), found.alias("found"))
    own_part = lambda x: F.array_max(F.transform(F.filter("found", lambda m: m["label"] == x), lambda m: m["part"]))
    named = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["label"])))
    rows = rows.select("key", "n_words", "every", "own", F.transform(named, lambda x: F.struct(x.alias("label"), own_part(x).alias("part"))).alias("matches"))
    part = F.coalesce(F.array_max(F.transform("matches", lambda m: m["part"])), F.lit(0.0))
    return rows.select(
        F.col("key").alias(key), "n_words", F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("own") > 0, 1.0).otherwise(part).alias("score"), "matches",
    )


def _starts(words: Column, phrase: tuple[str, ...]) -> Column:
    """Where the words of a phrase stand consecutively; empty if words is null."""
    same = lambda i: [F.get(words, i + k) == w for k, w in enumerate(phrase)]

    def all_of(i: Column) -> Column:
        out = same(i)[0]
        for s in same(i)[1:]:
            out = out & s
        return out

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), all_of)
    return F.when(F.size(words) >= len(phrase), places).otherwise(F.array().cast("array<int>"))
