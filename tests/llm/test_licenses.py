import random
import re

import pytest

from lumaframe.llm import licenses, queries

from . import oracle

SF = "/root/testdata/sf0.01"


def plain(text, threshold=licenses.THRESHOLD):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(licenses.NOT_WORD, low) if w]
    starts, own = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        own |= {label} if at else set()
    best = {}
    here = set(words)
    for name, templates in licenses.TEMPLATES.items():
        for template in templates:
            t = [w for w in re.split("[^a-z0-9]+", template.lower()) if w]
            length, t = len(t), set(t)
            if len(t & here) >= threshold * len(t) - 1e-9:
                part = max(len(t & set(words[i : i + length])) for i in range(len(words))) / len(t)
                if part >= threshold - 1e-9:
                    best[name] = max(best.get(name, 0), part)
    score = 1.0 if own else max(best.values(), default=0.0)
    labels = ",".join(sorted(own | set(best)))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), labels, score)


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = rows_of(queries.op9_license_scan(spark, SF))
    assert got == {d.doc_id: plain(d.text) for d in docs}
    assert {"gpl", "cc-by", "reserved"} <= {x for r in got.values() for x in r[4].split(",")}
    assert {"mit", "apache-2.0"} <= {x for r in got.values() for x in r[5].split(",")}


def test_edges(spark):
    texts = [
        None, "", "CC-BY cc\nby, ccby CC BYE cc  by", "all rights reserved. ALL_RIGHTS_RESERVED all rights\treserved all", "ẞİ K GENERAL public\x00License é",
        "Licensed under the apache license 2 0 thing.", "Released under the. MIT license", "released the license mit under x", "cc " * 30_000 + "by", "aé cc by ó all rightsé reserved",
        "This work is licensed under the GNU General Public, version 3",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = rows_of(licenses.scan(df))
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert licenses.scan(df.union(df)).count() == 2 * len(texts)
    assert licenses.scan(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


NOTICES = {
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.""",
    "bsd-3-clause": """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    "gpl,gpl-notice": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}


def test_canonical_notices_wrapped(spark):
    texts, want = [], []
    for labels, notice in NOTICES.items():
        for prefix in ("", " * ", "# ", "// ", "\r"):
            texts.append("Some words before it.\n" + "\n".join(prefix + line for line in notice.split("\n")) + "\n\nand after it. " * 3)
            want.append(labels)
    texts += ["Licensed under the Apache License, Ver. 1.", "released the mit under license", "redistribution of words in forms of source and binary use"]
    want += ["", "mit", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(licenses.scan(df))
    assert {k: r[5] for k, r in got.items()} == dict(enumerate(want))
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_a_library_from_a_table(spark):
    """Hundreds of templates of a table give the plan that two dozen give, without Python, and find what the plain form finds."""
    rng = random.Random(9)
    vocabulary = [f"term{i}" for i in range(900)]
    made = {f"license-{i % 170}-{i}": " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 25))) for i in range(500)}
    table = spark.createDataFrame([(k, t) for k, t in made.items()] + [(None, "term1 term2"), ("empty", " - "), ("none", None)], "label string, template string")
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(40)]
        for name in rng.sample(sorted(made), 2):
            own = made[name].split()
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "other"
            words[rng.randrange(40) : 0] = own
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    large = licenses.scan(df, templates=table)
    found = 0
    for r in large.collect():
        words, want = texts[r.doc_id].split(), {}
        for name, t in made.items():
            t = t.split()
            part = max(len(set(t) & set(words[i : i + len(t)])) for i in range(len(words))) / len(set(t))
            if part >= licenses.THRESHOLD - 1e-9:
                want[name] = part
        assert {m.label: m.part for m in r.matches} == want, r.doc_id
        found += len(want)
    assert found > 60
    shape = lambda d: re.sub(r"Some\(.*?\)|\[\{.*?\}\]|\[.term.*?\]|#\d+L?|\d+", "", d._jdf.queryExecution().analyzed().toString())
    small = licenses.scan(df, templates={k: made[k].split("|") for k in sorted(made)[:24]})
    assert shape(large).count("lambda") == shape(small).count("lambda") and not re.search("Python|Pandas|Arrow|Exchange", large._jdf.queryExecution().executedPlan().toString())
    assert licenses.library(table).keys() == made.keys()


def test_a_library_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(licenses, "LIBRARY_BYTES", 20)
    with pytest.raises(ValueError):
        licenses.library(spark.createDataFrame([("a", "word " * 20)], "label string, template string"))
    assert licenses.library(spark.createDataFrame([("a", "word")], "label string, template string")) == {"a": ["word"]}
    assert licenses.scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"), templates={}).first().labels == "cc-by"


def test_text_above_a_megabyte(spark):
    text = "plain words of a text " * 60_000 + "Released under the MIT License " + "and more of it " * 20_000 + "all rights reserved"
    assert rows_of(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))) == {1: plain(text)}


def test_random_runs_of_template_words(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            own = re.findall("[A-Za-z0-9]+", rng.choice(rng.choice(list(licenses.TEMPLATES.values()))))
            for i in range(len(own) - 1, -1, -1):
                if rng.random() < 0.08:
                    own[i : i + 1] = rng.choice([[], ["other"], [own[i], "more"]])
            words += own + ["between"] * rng.randrange(3)
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(licenses.scan(df)) == {i: plain(t) for i, t in enumerate(texts)}


def test_sql(spark):
    oracle.compare(spark, queries.op9_license_scan, queries.ORACLES["op9_license_scan"], SF)
