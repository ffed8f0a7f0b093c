import random
import re

from provend.llm import license_scan as s

PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    return (len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None,
            ",".join(sorted({x for _, x in found})))


CASES = [
    ("Under the MIT License. under-the/mit license", "mit"),
    ("cc by nc cc by nc", "cc-by-nc"),
    ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("the GNU Lesser General Public License v2.1 applies", "lgpl-2.1"),
    ("Apache License Version 2.0, and released under the BSD license", "apache-2,bsd"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2"),
    ("licensed under the 3-clause BSD license", "bsd-3"),
    ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
    ("mit der Lizenz im Kopf", ""),
    ("a driving license is required", ""),
    ("All rights reserved.", "proprietary"),
    ("under the mıt license", ""),
    ("License: MIT", "mit"),
    ("the MIT licence", "mit"),
    ("This package is released under MIT.", "mit"),
    ("distributed under the GPL v3", "gpl-3"),
    ("available under LGPL 2.1 or later", "lgpl-2.1"),
    ("It was released under the general public pressure.", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published", "gpl"),
    ("You may not use this file except in compliance with the License.", "apache-2"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("A warranty is hereby granted to the contributor who may redistribute beer.", ""),
]


def test_base_counts_and_labels(spark, some_docs, edge_docs, tmp_path):
    texts = [t for t, _ in CASES] + [t for _, t, _, _ in some_docs] + [r["text"] for r in edge_docs.collect()]
    texts += ["license " * 300, "under the mit license " * 200]
    texts += [None, "x " * 100_000 + "cc by nc"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    rows = {r["doc_id"]: r for r in s.query(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    for i, (t, labels) in enumerate(CASES):
        assert rows[i]["labels"] == labels, t


def test_rules_are_many_and_anchored():
    table = s.rules()
    assert len(table) > 300 and all(f"<{k}>" in r for _, k, r, _ in table)
    for _, _, r, _ in table:
        re.compile(r)


def test_overlaps(spark):
    df = spark.createDataFrame([(1, "distributed under the GNU General Public License version 3, or the MIT license")],
                               "doc_id long, text string")
    found = s.scan(df).first()["found"]
    assert [(x["start"], -x["neg_end"], x["label"]) for x in found] == [(0, 9, "gpl-3"), (11, 13, "mit")]


def test_empty_table(no_docs):
    assert s.scan(no_docs).count() == 0


def plain(text):
    """Rules, priority and containment in plain Python, rule by rule over the words."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    n, found = s.context(), []
    for p, k, r, label in s.rules():
        for i in (i for i, w in enumerate(words) if w == k):
            near = words[max(0, i - n):i] + [f"<{k}>"] + words[i + 1:i + 1 + n]
            if m := re.search(r, " ".join(near)):
                start = i - m[0].split("<")[0].count(" ")
                found.append((start, -(start + m[0].count(" ") + 1), p, label))
    kept = []
    for d in sorted(found):
        if not kept or d[0] >= -kept[-1][1]:
            kept.append(d)
        elif d[2] < kept[-1][2]:
            kept[-1] = d
        elif d[2] == kept[-1][2] and d[1] < kept[-1][1]:
            kept.append(d)
    return kept


def test_detections_match_plain_python(spark):
    rng = random.Random(11)
    parts = [t for t, _ in CASES] + [r.split("(")[0].replace("<", "").replace(">", "") for _, _, r, _ in s.BODIES]
    pool = sorted({w for p in parts for w in p.split()} | {"license", "under", "the", "2", "0", "gnu", "or", "public", "v3"})
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 25)))
             for _ in range(150)] + parts
    df = spark.createDataFrame([(i, t, "l", 1, "w") for i, t in enumerate(texts)],
                               "doc_id long, text string, label string, start int, words string")
    rows = s.scan(df).collect()
    assert sum(len(r["found"]) for r in rows) > 200
    for r in rows:
        assert [tuple(x) for x in r["found"]] == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_no_rule_reaches_beyond_the_context():
    for _, k, r, _ in s.rules():
        assert not re.search(r"[*+]|\{\d*,\}", r.replace("\\w+", "")) and r.count(f"<{k}>") >= 1
    assert 10 <= s.context() < 60


def test_many_detections_in_one_text(spark):
    n = 3_000
    df = spark.createDataFrame([(1, "all rights reserved " * n)], "doc_id long, text string")
    assert s.scan(df).selectExpr("size(found) AS n").first()["n"] == n
