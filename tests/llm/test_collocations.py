import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF
from provend.llm.collocations import BASES, Miner, slices, words_of
from provend.llm.rolling import powers

SCHEMA = "doc_id long, text string, lang string, fp long, key long, words string, n long, a int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 1, 2, "w", 3, 4) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, min_count=10, max_words=3, top=2000, percent=50):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i:i + n])) for n in range(1, max_words + 1) for i in range(len(words) - n + 1))
    cand = {k: a for k, a in counts.items() if a >= min_count and len(k[1]) >= 2}
    out = []
    for (lang, w), a in cand.items():
        inside = any(percent * a <= 100 * b for (x, v), b in cand.items() if x == lang and len(v) > len(w)
                     and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)))
        if not inside:
            score, _, l, r = min((10 ** 6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k,
                                  counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    rows, rank = set(), Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.add((lang, rank[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return rows


def mined(spark, rows, top=2000, percent=50, **opts):
    return {tuple(r) for r in Miner(frame(spark, rows), **opts).collocations(top, percent).collect()}


def prose(n, seed=0, vocabulary=14):
    rng = random.Random(seed)
    words = ["The", "of", "ÉTÉ", "été", "new", "york", "city", "x", "a b", "zz-9", "中文", "(b)", "it's", "A"][:vocabulary]
    glue = [" "] * 9 + ["\t", "  ", ", ", ".", "\n", " \t "]
    return [("".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "fr", "und", None])) for _ in range(n)]


EDGE = [(None, "en"), ("", "en"), (" \t\n.", None), ("one", "fr"), ("new york " * 30, "en"), ("new york " * 30, "en"),
        ("x" * 5000 + " of " + "y" * 5000, "en"), ("Of The . of the of the", None)]


@pytest.mark.parametrize("opts", [
    {}, {"bits": 6}, {"bits": 12, "max_words": 4}, {"slice_bytes": 50, "slice_words": 4},
    {"min_count": 3, "slice_bytes": 7, "slice_words": 1, "max_words": 2}])
def test_matches_brute_force(spark, opts):
    rows = EDGE + prose(150, vocabulary=9) * 2
    want = brute(rows, opts.get("min_count", 10), opts.get("max_words", 3))
    assert len(want) > 30 and mined(spark, rows, **opts) == want


def test_containment_top_and_empty_table(spark):
    rows = [("new york city. " * 20 + "new york. " * 21 + "york city, big apple. " * 10, "en")]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {"new york city", "new york", "big apple"}
    assert mined(spark, rows, percent=0) == brute(rows, percent=0)
    more = prose(80, 3)
    assert mined(spark, more, top=4) == brute(more, top=4)
    assert mined(spark, []) == set()


def test_matches_brute_force_on_documents(spark, some_docs):
    rows = [(text, lang) for _, text, lang, _ in some_docs if text is None or len(text) < 3000]
    want = brute(rows)
    assert len(want) > 20 and mined(spark, rows) == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Miner(docs).collocations().count() >= len({r[0] for r in want})


def test_edge_documents_of_the_other_tests(spark, edge_docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in edge_docs.collect()]
    assert {tuple(r) for r in Miner(edge_docs).collocations().collect()} == brute(rows)
    assert Miner(no_docs).collocations().count() == 0


def test_fingerprints_do_not_depend_on_place_or_slices():
    text = ("alpha beta. Gamma " * 40 + "w" * 300 + " alpha beta gamma").encode()
    buf = np.frombuffer(text, dtype=np.uint8)
    whole = list(words_of(buf, 1 << 20))[0]
    for size in (1, 10, 64, 1000):
        parts = list(words_of(buf, size))
        assert np.array_equal(np.concatenate([p.marks[0] for p in parts]), whole.marks[0])
        assert np.array_equal(np.concatenate([p.start for p in parts]), whole.start)
    assert len(set(whole.marks[0].tolist())) == 4
    for n in (1, 2, 3):
        salts = np.zeros(len(whole), dtype=np.uint64)
        want = whole.grams(n, salts)
        for words in (1, 2, 5, 17):
            got = [w.grams(n, salts[:len(w)])[:k] for w, k in slices(buf, n, 32, words)]
            assert np.array_equal(np.concatenate(got), want)
    for base in BASES[0] + BASES[1]:
        up, down = powers(base, 50)
        assert (up * down == 1).all()
