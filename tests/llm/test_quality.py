import re

import pytest

from provend.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in q.clean(df).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute(t), (t or "")[:80]
        assert not (r["base_failed"] and r["kept"])
    return rows


def test_base_counts(spark, some_docs, edge_docs):
    texts = [t for _, t, _, _ in some_docs] + [r["text"] for r in edge_docs.collect()]
    texts += ["a b c d e f a b c d e", "a a a a a", "a a a a a a", "a b c d e " * 400, "x\n\nx\n \nx", "  a b",
              "one two three four five six seven eight nine ten one two three four five", "a b c d"]
    check(spark, texts)


CLEAN = "A plain sentence of ordinary words that ends as sentences do. "


@pytest.mark.parametrize("text, kept", [
    (CLEAN + "Another one follows it, with more to say on other things!", True),
    ("No full stop at the end but ordinary words in one line all the same", True),
    ("Many | short | labels | in | a | row | without | any | sentence | at | all | here", False),
    ("These### words%%% are*** followed&&& by$$$ odd### signs%%% at*** every&&& step$$$ here###", False),
    ("LOUD!! WORDS!! ALL!! OF!! THEM!! SHOUT!! AT!! THE!! READER!! WITHOUT!! END!!", False),
    (CLEAN + "Some more is said here so that furniture is the smaller share of it."
     "\nHome | About | Contact | Login | Help\nAll rights reserved.", True),
    ("Accueil\nConnexion\nLire la suite\nPage suivante\nTous droits réservés 2024\nSuivez-nous sur ce site", False),
    ("Startseite\nAnmelden\nNach oben\nWeiterlesen\nALLE RECHTE VORBEHALTEN\nImpressum\nÜBER UNS", False),
    ("Inicio\nBuscar\nLeer más\nVolver arriba\nTodos los derechos reservados\nPolítica de cookies\nContacto", False),
    ("Anterior to the second war, the town lay on the other bank of the river and had few houses.", True),
    ("Weiter oben am Fluss stand einst ein kleines Haus, das heute keiner mehr kennt oder sucht.", True),
    ("Contacto con la naturaleza era lo que buscaba, y lo encontró en un valle lejano y tranquilo.", True),
    ("5 < 6 and 7 > 3 are two of the things that clean documents may well say now and then.", True),
    ("Really?! Yes!! said one of them, and the other did not know what to answer to that.", True),
])
def test_verdicts(spark, text, kept):
    row = q.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["kept"] is kept, row


def test_clean_text_loses_only_failing_lines(spark):
    text = CLEAN + "\nHome | About | Contact\n\nThis site uses cookies.\n" + CLEAN
    row = q.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["clean_text"] == CLEAN + "\n\n" + CLEAN


def test_clean_labelled_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    rows = (q.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
            .where("not base_failed").groupBy("quality", "kept").count().collect())
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.05 * n[(0, False)]


def test_empty_table(no_docs):
    assert q.clean(no_docs).count() == 0
