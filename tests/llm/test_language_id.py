import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from provend.llm import language_id as s


def test_held_out_accuracy_and_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = s.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in test) >= 0.98 * len(test)
    assert all(0 <= r["score"] <= 1 for r in rows)


class Plain:
    """The model word by word in plain Python."""

    def __init__(self, counts):
        self.langs = sorted({lang for lang, _ in counts})
        words, grams = {}, {}
        for (lang, word), n in counts.items():
            words.setdefault(word, Counter())[lang] += n
        for word, by in words.items():
            for size in range(1, s.LONGEST + 1):
                for g in self.grams_of(word, size):
                    for lang, n in by.items():
                        grams.setdefault(size, {}).setdefault(g, Counter())[lang] += n
        self.words = self.logs(words)
        self.grams = {size: self.logs(table) for size, table in grams.items()}
        self.raw = grams

    @staticmethod
    def grams_of(word, size):
        text = word if size == 1 else f" {word} "
        return [text[i:i + size] for i in range(len(text) - size + 1) if size != 2 or text[i:i + size].strip()]

    def logs(self, table):
        total = {x: sum(by[x] for by in table.values()) for x in self.langs}
        return {key: [math.log((by[x] + 0.5) / (total[x] + 0.5 * len(table))) for x in self.langs] for key, by in table.items()}

    def predict(self, text):
        words = regex.findall(r"\p{L}+", (text or "").lower())
        if not words or not self.langs:
            return "und", 0.0
        sums = [0.0] * len(self.langs)
        for w in words:
            row = self.words.get(w)
            for size in range(s.LONGEST, 0, -1) if row is None else ():
                known = [self.grams[size][g] for g in self.grams_of(w, size) if g in self.grams[size]]
                if known:
                    row = [sum(r[i] for r in known) / len(known) for i in range(len(sums))]
                    break
            sums = [a + b for a, b in zip(sums, row or [0.0] * len(sums))]
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        return self.langs[best], 1 / sum(math.exp(max(-700.0, x - sums[best])) for x in sums)

    def evidence(self, text, lang):
        i, table = self.langs.index(lang), self.raw[s.EVIDENCE]
        total = sum(by[lang] for by in table.values())
        size = total + 0.5 * len(table)
        letters = sum(1 for by in self.raw[1].values() if by[lang]) + 1
        floor = math.log(0.5 / size)
        logs = {g: math.log((by[lang] + 0.5) / size) for g, by in table.items()}
        even = floor + sum(v - floor for v in logs.values()) / letters ** s.EVIDENCE
        typical = sum(by[lang] * math.log(max(by[lang] - 0.5, 0.5) / size) for by in table.values()) / total
        grams = [g for w in regex.findall(r"\p{L}+", text.lower()) for g in self.grams_of(w, s.EVIDENCE)]
        return sum(logs.get(g, floor) - even for g in grams) / (typical - even) / len(grams)


def test_matches_the_model_in_plain_python(some_docs):
    counts = Counter((lang, w) for d, t, lang, _ in some_docs if d % 3 for w in regex.findall(r"\p{L}+", (t or "").lower()))
    model, plain = s.Model.of(counts), Plain(counts)
    texts = [t for _, t, _, _ in some_docs] + [None, "", "1 2", "x", "Ω", "qqqq zzzz", "ÉTÉ été", "house Haus дом", "a b c"]
    got = model.weigh(texts)
    for i, text in enumerate(texts):
        lang, score = plain.predict(text)
        assert got.lang[i] == lang and got.score[i] == pytest.approx(score, abs=1e-3)
        if lang != "und":
            assert got.evidence[i] == pytest.approx(plain.evidence(text, lang), abs=1e-3)
            letters = regex.findall(r"\p{L}", text.lower())
            assert got.letters[i] == len(letters)
            assert got.native[i] == pytest.approx(sum(plain.raw[1].get(x, {}).get(lang, 0) > 0 for x in letters) / len(letters))
    one_by_one = [model.weigh([t]) for t in texts]
    assert [v.lang[0] for v in one_by_one] == got.lang
    assert [v.score[0] for v in one_by_one] == pytest.approx(got.score.tolist())


def test_words_first_then_shorter_grams():
    model = s.Model.of({("en", "house"): 5, ("en", "mouse"): 3, ("de", "haus"): 5, ("de", "maus"): 3})
    said = lambda text: model.weigh([text]).lang[0]
    assert said("House") == "en" and said("Haus, Maus") == "de"
    assert said("blouse") == "en"  # unseen: by its 4-grams
    row = lambda g: model.gram_logs[len(g)][model.grams[len(g)].find(
        s.hashed(np.array([ord(c) for c in g]), np.array([0]), np.array([len(g)])))[0]]
    line = s.code_points(" blouse qh qqq ")
    off = model.backed_off(line, 3)
    assert off[0] == pytest.approx((row("ouse") + row("use ")) / 2, abs=1e-5)
    assert off[1] == pytest.approx(row("h"), abs=1e-5)  # only the single letter is known
    assert (off[2] == 0).all()


@pytest.mark.parametrize("text", [None, "", " \n", "123 ... ½ ² !?"])
def test_no_letter_is_und(text):
    got = s.Model.of({("en", "a"): 1}).weigh([text])
    assert (got.lang[0], got.score[0], got.told()[0]) == ("und", 0.0, False)


def test_edge_documents(spark, edge_docs, no_docs):
    rows = s.identify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    learned = {r["lang"] for r in edge_docs.collect() if r["doc_id"] is not None and r["lang"] is not None}
    for r in rows:
        assert r["lang_pred"] in learned | {"und"} and r["held_out"] is not None
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 3, 13))
    out = s.identified(edge_docs)
    assert out.columns == edge_docs.columns
    assert s.identify(no_docs).count() == 0 and s.identified(no_docs).count() == 0


def test_labels_do_not_leak(spark, some_docs):
    rows = [(d, t, x if zlib.crc32(str(d).encode()) % 3 != 1 else "zz") for d, t, x, _ in some_docs]
    a = spark.createDataFrame([(d, t, x) for d, t, x, _ in some_docs], "doc_id long, text string, lang string")
    b = spark.createDataFrame(rows, a.schema)
    key = lambda r: r["doc_id"]
    assert sorted(s.identify(a).collect(), key=key) == sorted(s.identify(b).collect(), key=key)


def test_letters_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(5)
    noise = lambda n: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9)))
                               for _ in range(n))
    other = ["Привет, это русский текст, которого никто не учил.", "这是一个没有学过的中文文本", "Αυτό είναι ελληνικό κείμενο. " * 200,
             "هذا نص عربي", *(noise(n) for n in (10, 20, 50, 200, 2000) for _ in range(4))]
    held = [i for i in range(10 ** 6, 10 ** 6 + 1000) if zlib.crc32(str(i).encode()) % 3 == 1]  # never learned from
    bad = spark.createDataFrame(list(zip(held, other, ["en"] * len(other))), docs.schema)
    kept = {d["doc_id"] for d in s.identified(docs.union(bad)).collect()}
    assert kept == {d["doc_id"] for d in docs.collect()}


def test_evidence_is_free_of_length_and_languages():
    counts = Counter(("en", w) for w in ("house", "mouse", "horse", "nurse", "house", "use", "hose") * 3)
    one, two = s.Model.of(counts), s.Model.of({**counts, ("de", "haus"): 5})
    for text in ("house", "mouse blouse", "zzz"):
        assert abs(one.weigh([text]).evidence[0] - one.weigh([f"{text} " * 500]).evidence[0]) < 1e-5
        assert two.weigh([text]).evidence[0] == pytest.approx(one.weigh([text]).evidence[0], abs=0.1)
    assert one.weigh(["house"]).evidence[0] > 0.9 and one.weigh(["дом"]).evidence[0] < 0.1


def test_the_bound_depends_on_letters_not_on_the_corpus(spark):
    """Labelled documents stay at every size, short ones too, unless their letters speak clearly against them."""
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        assert s.identified(docs).count() == docs.count()
    model = s.fit(docs)
    short = model.weigh(["Withthesones |", "ab", "the"])
    assert short.told().all() and (short.least < s.LEAST).all()
    noise = model.weigh(["qzxv jkqw xzzq vvkj wqxz", "qzxv jkqw xzzq vvkj wqxz " * 50, "дом", "中文"])
    assert not noise.told().any() and noise.least[1] > noise.least[0]


def test_languages_without_enough_text_keep_theirs(spark):
    model = s.Model.of({("en", "x"): 1})
    assert model.weigh(["x", "x x x"]).told().all()
    rows = [(i, "one line of text", "en") for i in range(6)] + [(10, None, "en"), (11, "", "fr"), (12, "один", "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in s.identified(docs).collect()}
    assert kept >= set(range(6)) and not kept & {10, 11}


def test_long_texts_and_sample_bounds(spark):
    rows = [(i, "the house of the mouse " * 50, "en") for i in range(300)] + [(i, "das haus der maus " * 50, "de") for i in range(300, 330)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert s.fit(docs, fit_chars=20_000).langs == ["de", "en"]
    long = spark.createDataFrame([(1, "das haus " * 300_000, "en"), (2, "x" * 2_000_000, "en")], docs.schema)
    got = {r["doc_id"]: r["lang_pred"] for r in s.identify(long, s.fit(docs)).collect()}
    assert got[1] == "de"
