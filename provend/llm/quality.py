"""Quality rules, lines first, in DataFrame expressions only.

Every line with a word is tried by three rules:

* punctuation: symbols, or doubled ``!`` and ``?``, in too large a share of its words;
* navigation: separators such as ``|`` between its words, or a short line that begins
  with a navigation word of one of four languages and does not end as a sentence;
* boilerplate: a short line with one of the fixed phrases of page furniture in these languages.

Failing lines are removed. A document that loses too large a share of its words, or
fails the base rules (too few words, too many words in repeated five-word windows),
is rejected. A clean document loses no line, whatever its length.

Repeated windows are found in the row: windows are hashed to 64 bits, and only texts
with equal hashes sort them to find the places.

Defined cases: null and empty texts have no words and fail; null and repeated ids are
rows of their own; of equal lines all but the first are duplicates; very long texts are read
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·→"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS_PER_WORD = 0.5
SEPARATORS_PER_WORD = 0.3
DOUBLED_PER_WORD = 0.3
SHORT_LINE = 25
MIN_KEPT_SHARE = 0.6

DOUBLED = r"[!?]{2,}"
#: First words of navigation lines, in four languages
NAVIGATION_WORDS = (
    "home", "menu", "login", "log in", "log out", "sign in", "sign up", "register", "my account", "next", "previous",
    "next page", "previous page", "older posts", "newer posts", "back to top", "back to home", "read more", "show more",
    "view all", "see all", "share", "search", "skip to content", "skip to main content", "sitemap", "site map", "contact us",
    "about us", "add to cart", "checkout", "categories", "archives", "tags", "leave a comment", "comments",
    "accueil", "connexion", "se connecter", "inscription", "suivant", "précédent", "page suivante", "page précédente",
    "haut de page", "retour en haut", "lire la suite", "en savoir plus", "voir tout", "partager", "rechercher",
    "aller au contenu", "plan du site", "nous contacter", "contactez-nous", "ajouter au panier",
    "startseite", "anmelden", "abmelden", "registrieren", "weiter", "zurück", "nächste seite", "vorherige seite",
    "nach oben", "weiterlesen", "mehr lesen", "mehr erfahren", "alle anzeigen", "teilen", "suche", "zum inhalt springen",
    "zum inhalt", "kontakt", "über uns", "in den warenkorb", "inhaltsverzeichnis",
    "inicio", "iniciar sesión", "cerrar sesión", "registrarse", "siguiente", "anterior", "página siguiente",
    "página anterior", "volver arriba", "ir arriba", "leer más", "ver más", "ver todo", "compartir", "buscar",
    "saltar al contenido", "ir al contenido", "mapa del sitio", "contacto", "quiénes somos", "añadir al carrito")
#: Phrases of page furniture, in four languages
BOILERPLATE_PHRASES = (
    "all rights reserved", "cookie policy", "uses cookies", "use of cookies", "accept cookies", "accept all cookies",
    "privacy policy", "terms of (?:use|service)", "terms and conditions", "enable javascript", "javascript is disabled",
    "subscribe to our newsletter", "sign up for our newsletter", "click here to", "lorem ipsum", "powered by",
    "follow us on", "share this (?:post|page|article)", "you must be logged in", "this site is protected by",
    "your browser does not support", "page not found",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "utilise des cookies",
    "accepter les cookies", "gestion des cookies", "conditions générales", "abonnez-vous à", "cliquez ici",
    "activer javascript", "suivez-nous sur", "partager cet article", "propulsé par",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen",
    "verwendet cookies", "cookies akzeptieren", "newsletter abonnieren", "klicken sie hier", "aktivieren sie javascript",
    "folgen sie uns", "diesen artikel teilen", "impressum",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "aviso legal", "utiliza cookies",
    "aceptar cookies", "términos y condiciones", "condiciones de uso", "suscríbete a", "haga clic aquí", "haz clic aquí",
    "active javascript", "síguenos en", "compartir este artículo")
#: a short line that begins with one of the words, and does not go on as a sentence
NAVIGATION = r"(?i)^[^\p{L}\p{N}]{0,3}(?:" + "|".join(sorted(NAVIGATION_WORDS, key=len, reverse=True)) + r")(?:[^\p{L}\p{N}.!?][^.!?]{0,39})?$"
BOILERPLATE = r"(?i)(?:^|[^\p{L}])(?:" + "|".join(BOILERPLATE_PHRASES) + r")(?:[^\p{L}]|$)"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words that lie in a window of five words which the text has twice or more."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")

    def covered(at: Column) -> Column:
        """Words covered by the windows that start at these places, given in order."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda a, i: F.struct(
            (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])

    def repeated(h: Column) -> Column:
        """Places of the windows whose hash is not the only one."""
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(marked, lambda s: F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(
            (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())))

    def counted(w: Column) -> Column:
        at = lambda i: F.get(w, i)
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                             lambda i: F.xxhash64(*(at(i + k) for k in range(WINDOW))))
        return F.when(F.size(w) <= WINDOW, 0).otherwise(_let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(repeated(h)))))

    return _let(words, counted).cast("long")


def _any_case(pattern: str) -> str:
    """The pattern with letters beyond ASCII in either case, too; the SQL's patterns have that by themselves."""
    return pattern.replace("(?i)", "(?iu)", 1)


def line_ok(line: Column) -> Column:
    """Does a line pass the punctuation, navigation and boilerplate rules? Lines without words pass."""
    def by(words: Column) -> Column:
        punctuation = ((_count_of(line, SYMBOLS) < F.greatest(F.lit(2.0), words * SYMBOLS_PER_WORD))
                       & (F.regexp_count(line, F.lit(DOUBLED)) < F.greatest(F.lit(2.0), words * DOUBLED_PER_WORD)))
        navigation = (_count_of(line, SEPARATORS) < F.greatest(F.lit(2.0), words * SEPARATORS_PER_WORD)) & ~(
            (words <= 6) & line.rlike(_any_case(NAVIGATION)))
        boilerplate = ~((words <= SHORT_LINE) & line.rlike(_any_case(BOILERPLATE)))
        return punctuation & navigation & boilerplate
    return _let(n_words(line), by)


def cleaned(text: Column) -> Column:
    """The text without the lines that fail."""
    return F.array_join(F.filter(F.split(text, "\n", -1), line_ok), "\n")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, clean_text, kept_words and kept for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    counts = rows.select(
        "doc_id", n_words(t).alias("n_words"), F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"),
        n_repeat_words(t).alias("n_repeat_words"), cleaned(t).alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (counts.withColumn("base_failed", failed).withColumn("kept_words", n_words(F.col("clean_text")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= F.col("n_words") * MIN_KEPT_SHARE)))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: base counts and verdict of every document."""
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "kept_words")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE words > 0 GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
k AS (SELECT doc_id, sum(words) AS n FROM l
      WHERE len(line) - len(translate(line, '{SYMBOLS}', '')) < greatest(2.0, words * {SYMBOLS_PER_WORD})
        AND len(regexp_extract_all(line, '{DOUBLED}')) < greatest(2.0, words * {DOUBLED_PER_WORD})
        AND len(line) - len(translate(line, '{SEPARATORS}', '')) < greatest(2.0, words * {SEPARATORS_PER_WORD})
        AND NOT (words <= 6 AND regexp_matches(line, '{NAVIGATION}'))
        AND NOT (words <= {SHORT_LINE} AND regexp_matches(line, '{BOILERPLATE}'))
      GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(t) - len(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(k.n, 0) AS BIGINT) AS kept_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND kept_words >= n_words * {MIN_KEPT_SHARE} AS kept,
       kept_words
FROM c
"""
