"""License scans by ordered signature rules, in DataFrame expressions only.

A text is reduced to its words (A-Z lower-cased, single spaces). Keywords gate the
rules: a text without any keyword is done after the reduction, and a rule is tried
only around a place of its own keyword, on the words next to it with the keyword
marked, so the expression is anchored there. Rules are signatures of license bodies
and notices, keyed on their rare words, and the product of license names and
mention templates: some hundreds of expressions, each with a priority (1 is best) and
each compiled once.

Overlapping detections are resolved in order of place: a better priority replaces
what it overlaps; at equal priority an interval inside another one is dropped and
others stay. The three base phrases are counted on their own and their labels are
never suppressed.

Defined cases: null and empty texts have no words, no labels and score 0; null and
repeated ids are rows of their own; detections that tie in place and priority are ordered
by label; very long texts are read whole; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = 256  # detections kept in one list while sweeping

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label -> words before "license", words after it, short identifier in words
NAMES = {
    "mit": ("(?:mit|expat|x11)", "", "mit"),
    "apache-1": ("apache(?: software)?", " (?:version |v)?1(?: [01])?", "apache 1 [01]"),
    "apache-2": ("apache(?: software)?", " (?:version |v)?2(?: 0)?", "apache 2 0"),
    "apache": ("apache(?: software)?", "", "apache"),
    "bsd-2": ("(?:(?:2|two) clause bsd|simplified bsd|freebsd)", "", "bsd 2 clause"),
    "bsd-3": ("(?:(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)", "", "bsd 3 clause"),
    "bsd-4": ("(?:(?:4|four) clause bsd|original bsd)", "", "bsd 4 clause"),
    "bsd": ("bsd(?: style)?", "", "bsd"),
    "gpl-2": ("(?:gnu )?(?:general public|gpl)", " (?:version |v)?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    "gpl-3": ("(?:gnu )?(?:general public|gpl)", " (?:version |v)?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    "gpl": ("(?:gnu )?(?:general public|gpl)", "", "gpl"),
    "lgpl-2.1": ("(?:gnu )?(?:(?:lesser|library) general public|lgpl)", " (?:version |v)?2(?: [01])?", "lgpl 2 [01](?: only| or later)?"),
    "lgpl-3": ("(?:gnu )?(?:lesser general public|lgpl)", " (?:version |v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    "lgpl": ("(?:gnu )?(?:(?:lesser|library) general public|lgpl)", "", "lgpl"),
    "agpl-3": ("(?:gnu )?(?:affero general public|agpl)", " (?:version |v)?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    "agpl": ("(?:gnu )?(?:affero general public|agpl)", "", "agpl"),
    "fdl": ("(?:gnu )?free documentation", "", "gfdl 1 [123](?: only| or later)?"),
    "mpl-1.1": ("mozilla public", " (?:version |v)?1 1", "mpl 1 1"),
    "mpl-2": ("mozilla public", " (?:version |v)?2(?: 0)?", "mpl 2 0"),
    "mpl": ("mozilla public", "", "mpl"),
    "epl-1": ("eclipse public", " (?:version |v)?1(?: 0)?", "epl 1 0"),
    "epl-2": ("eclipse public", " (?:version |v)?2(?: 0)?", "epl 2 0"),
    "cddl": ("common development and distribution", "", "cddl 1 [01]"),
    "cpl": ("common public", "", "cpl 1 0"),
    "eupl": ("european union public", "", "eupl 1 [12]"),
    "isc": ("isc", "", "isc"),
    "zlib": ("zlib(?: libpng)?", "", "zlib"),
    "boost": ("boost(?: software)?", "", "bsl 1 0"),
    "python": ("python(?: software foundation)?", "", "psf 2 0"),
    "artistic-1": ("artistic", " (?:version |v)?1(?: 0)?", "artistic 1 0"),
    "artistic-2": ("artistic", " (?:version |v)?2(?: 0)?", "artistic 2 0"),
    "artistic": ("artistic", "", "artistic"),
    "ms-pl": ("microsoft public", "", "ms pl"),
    "ms-rl": ("microsoft reciprocal", "", "ms rl"),
    "ofl": ("(?:sil )?open font", "", "ofl 1 1"),
    "odbl": ("open database", "", "odbl 1 0"),
    "ogl": ("open government", "", "ogl uk 3 0"),
    "openssl": ("openssl", "", "openssl"),
    "php": ("php", "", "php 3 01"),
    "postgresql": ("postgresql", "", "postgresql"),
    "ruby": ("ruby", "", "ruby"),
    "unlicense": ("un", "", "unlicense"),
    "wtfpl": ("do what the fuck you want to public", "", "wtfpl"),
    "w3c": ("w3c(?: software)?", "", "w3c"),
    "beerware": ("beer ?ware", "", "beerware"),
    "cecill": ("cecill", "", "cecill 2 1"),
    "osl": ("open software", "", "osl 3 0"),
    "afl": ("academic free", "", "afl 3 0"),
}

#: priority, keyword, expression; <word> is the place of the keyword
TEMPLATES = (
    (1, "spdx", "<spdx> license identifier {id}(?![^ ])"),
    (1, "license", "under (?:the )?(?:terms of )?(?:the )?{pre} <license>{post}(?![^ ])"),
    (1, "licence", "under (?:the )?(?:terms of )?(?:the )?{pre} <licence>{post}(?![^ ])"),
    (1, "licensed", "<licensed> under (?:the )?(?:terms of )?(?:the )?{pre}(?: licen[cs]e)?{post}(?![^ ])"),
    (1, "released", "<released> under (?:the )?(?:terms of )?(?:the )?(?:{pre} licen[cs]e{post}|{id})(?![^ ])"),
    (1, "distributed", "<distributed> under (?:the )?(?:terms of )?(?:the )?(?:{pre} licen[cs]e{post}|{id})(?![^ ])"),
    (2, "license", "(?:(?<![^ ]){pre} <license>{post}|<license>(?: is)? {id})(?![^ ])"),
    (2, "licence", "(?:(?<![^ ]){pre} <licence>{post}|<licence>(?: is)? {id})(?![^ ])"),
)

#: Signatures of license texts and notices (priority, keyword, expression, label)
BODIES = (
    (1, "hereby", "permission is <hereby> granted free of charge to any person obtaining a copy of this software", "mit"),
    (1, "substantial", "shall be included in all copies or <substantial> portions of the software", "mit"),
    (2, "warranty", "the software is provided as is without <warranty> of any kind express or implied", "mit"),
    (1, "hereby", "permission is <hereby> granted free of charge to any person or organization obtaining a copy", "boost"),
    (1, "hereby", "permission is <hereby> granted free of charge to any person obtaining a copy of the font software", "ofl"),
    (1, "hereby", "for any purpose with or without fee is <hereby> granted provided that the above copyright notice", "isc"),
    (1, "disclaims", "and the author <disclaims> all warranties with regard to this software", "isc"),
    (1, "hereby", "without fee and without a written agreement is <hereby> granted", "postgresql"),
    (1, "hereby", "psf <hereby> grants licensee a nonexclusive royalty free world ?wide license", "python"),
    (1, "redistribution", "<redistribution> and use in source and binary forms with or without modification are permitted", "bsd"),
    (1, "redistributions", "<redistributions> (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", "bsd"),
    (1, "endorse", "may be used to <endorse> or promote products derived from this software without specific prior", "bsd-3"),
    (1, "advertising", "all <advertising> materials mentioning features or use of this software must display", "bsd-4"),
    (1, "compliance", "you may not use this file except in <compliance> with the license", "apache-2"),
    (1, "applicable", "unless required by <applicable> law or agreed to in writing software distributed under the license", "apache-2"),
    (1, "contributor", "each <contributor> hereby grants to you a perpetual worldwide non exclusive", "apache-2"),
    (1, "redistribute", "you can <redistribute> it and or modify it under the terms of the gnu general public license", "gpl"),
    (1, "redistribute", "you can <redistribute> it and or modify it under the terms of the gnu (?:lesser|library) general public license", "lgpl"),
    (1, "redistribute", "you can <redistribute> it and or modify it under the terms of the gnu affero general public license", "agpl"),
    (1, "option", "either version 2 of the license or at your <option> any later version", "gpl-2"),
    (1, "option", "either version 3 of the license or at your <option> any later version", "gpl-3"),
    (1, "merchantability", "implied warranty of <merchantability> or fitness for a particular purpose see the gnu general public license", "gpl"),
    (1, "verbatim", "everyone is permitted to copy and distribute <verbatim> copies of this license document", "gpl"),
    (1, "copyleft", "free <copyleft> license for software", "gpl"),
    (1, "misrepresented", "the origin of this software must not be <misrepresented>", "zlib"),
    (1, "liable", "in no event will the authors be held <liable> for any damages arising from the use of this software", "zlib"),
    (1, "unencumbered", "this is free and <unencumbered> software released into the public domain", "unlicense"),
    (1, "fuck", "you just do what the <fuck> you want to", "wtfpl"),
    (1, "mozilla", "is subject to the terms of the <mozilla> public license v 2 0", "mpl-2"),
    (1, "accompanying", "this program and the <accompanying> materials are made available under the terms of the eclipse public license", "epl"),
    (1, "dedicated", "has <dedicated> the work to the public domain by waiving all of his or her rights", "cc0"),
    (1, "package", "the conditions under which a <package> may be copied such that the copyright holder", "artistic"),
    (1, "beer", "this stuff is worth it you can buy me a <beer> in return", "beerware"),
    (1, "openssl", "this product includes software developed by the <openssl> project", "openssl"),
    (1, "evil", "the software shall be used for good not <evil>", "json"),
    (2, "confidential", "<confidential> and proprietary", "proprietary"),
    (2, "reproduced", "no part of this (?:book|document|publication|work) may be <reproduced>", "proprietary"),
    (2, "unauthorized", "<unauthorized> (?:copying|reproduction|distribution|use) (?:of this \\w+ )?is (?:strictly )?prohibited", "proprietary"),
)

#: names that stand for their license by themselves after "under"
SHORT = {
    "mit": "mit", "apache-2": "apache (?:version |v)?2(?: 0)?", "bsd-2": "(?:2|two) clause bsd", "bsd-3": "(?:3|three) clause bsd",
    "gpl-2": "(?:gnu )?gpl (?:version |v)?2(?: 0)?", "gpl-3": "(?:gnu )?gpl (?:version |v)?3(?: 0)?", "gpl": "(?:gnu )?gpl",
    "lgpl-2.1": "(?:gnu )?lgpl (?:version |v)?2(?: [01])?", "lgpl-3": "(?:gnu )?lgpl (?:version |v)?3(?: 0)?", "lgpl": "(?:gnu )?lgpl",
    "agpl-3": "(?:gnu )?agpl (?:version |v)?3(?: 0)?", "agpl": "(?:gnu )?agpl", "mpl-2": "mpl (?:version |v)?2(?: 0)?"}
SHORT_TEMPLATE = "<{k}> under (?:the )?(?:terms of )?(?:the )?{name}(?![^ ])"

#: rules of the Creative Commons family and others without the word "license"
OTHERS = tuple(
    (p, k, rule.replace("{v}", "(?: [1-4] [05])?").replace("{n}", words), f"cc-by{suffix}")
    for suffix, words, names in (
        ("", "", "attribution"), ("-sa", " sa", "attribution share ?alike"), ("-nd", " nd", "attribution no ?deriv(?:ative)?s"),
        ("-nc", " nc", "attribution non ?commercial"), ("-nc-sa", " nc sa", "attribution non ?commercial share ?alike"),
        ("-nc-nd", " nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
    for p, k, rule in ((1, "cc", "<cc> by{n}{v}(?![^ ])"), (1, "commons", f"creative <commons> {names}{{v}}(?![^ ])"))
) + (
    (1, "cc0", "<cc0>(?: 1 0)?(?: universal)?", "cc0"),
    (1, "unlicense", "<unlicense>", "unlicense"),
    (2, "commons", "creative <commons>(?: public domain| zero| cc0)", "cc0"),
    (2, "reserved", "all rights <reserved>", "proprietary"),
    (2, "domain", "(?:in|into|to) the public <domain>", "public-domain"),
)


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, keyword, expression, label) of all rules."""
    out = [(p, k, t.format(pre=pre, post=post, id=ident), label)
           for label, (pre, post, ident) in NAMES.items() for p, k, t in TEMPLATES]
    out += [(1, k, SHORT_TEMPLATE.format(k=k, name=name), label)
            for label, name in SHORT.items() for k in ("released", "distributed", "available")]
    out += [(p, k, f"(?<![^ ]){r}(?![^ ])", label) for p, k, r, label in BODIES]
    return out + [(p, k, r, label) for p, k, r, label in OTHERS]


def context() -> int:
    """Words on either side of a keyword that some rule can match: rules have no open repetitions, so it is at most
    the number of spaces on that side of the keyword."""
    return max(max(r.split(f"<{k}>")[0].count(" "), r.split(f"<{k}>")[1].count(" ")) for _, k, r, _ in rules())


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def reduced(text: Column) -> Column:
    """The words of a text with one space around each: ' w0 w1 ... '; a text without words is one space."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def base_places(words: Column) -> Column:
    """Places of the base phrases in a reduced text: array of (label, n, first, last)."""
    def places(phrase: str, label: str) -> Column:
        cut = F.split(words, f"(?<= ){phrase}(?= )", -1)
        n = F.size(cut) - 1
        first = _spaces(F.element_at(cut, 1)) - 1
        last = _spaces(words) - 1 - len(phrase.split()) - (_spaces(F.element_at(cut, -1)) - 1)
        return F.when(words.contains(f" {phrase} "), F.struct(
            F.lit(label).alias("label"), n.cast("long").alias("n"), first.alias("first"), last.alias("last")))
    return F.filter(F.array(*(places(p, x) for p, x in BASE)), lambda x: x.isNotNull())


def detections(words: Column) -> Column:
    """Detections left after suppression, of a reduced text: array of (start, neg_end, priority, label).

    ``neg_end`` is minus the end (exclusive), so that longer ones come first at the same start.
    """
    by_keyword: dict[str, list] = {}
    for priority, keyword, rule, label in rules():
        by_keyword.setdefault(keyword, []).append((priority, rule, label))
    keywords, reach = sorted(by_keyword), context()
    kind = "struct<start:int,neg_end:int,priority:int,label:string>"
    nothing = F.array().cast(f"array<{kind}>")

    def around(w: Column, i: Column) -> Column:
        """The words next to word i (from 0) with it marked."""
        places = F.sequence(F.greatest(F.lit(0), i - reach), F.least(F.size(w) - 1, i + reach))
        return F.array_join(F.transform(places, lambda j: F.when(
            j == i, F.concat(F.lit("<"), F.get(w, j), F.lit(">"))).otherwise(F.get(w, j))), " ")

    def matches(text: Column, word: Column) -> Column:
        """(match, priority, label) of the word's rules; each rule is an expression of its own, compiled once."""
        out = None
        for k in keywords:
            tried_ = F.array(*(F.struct(F.regexp_extract(text, r, 0).alias("m"), F.lit(p).alias("priority"), F.lit(x).alias("label"))
                               for p, r, x in by_keyword[k]))
            out = F.when(word == k, tried_) if out is None else out.when(word == k, tried_)
        return F.filter(out, lambda x: x["m"] != "")

    def tried(w: Column, i: Column) -> Column:
        found = F.transform(F.array(around(w, i)), lambda text: matches(text, F.element_at(w, i + 1)))[0]
        before = lambda m: _spaces(F.substring_index(m, "<", 1)).cast("int")
        return F.transform(found, lambda x: F.struct(
            (i - before(x["m"])).alias("start"),
            (-(i - before(x["m"]) + _spaces(x["m"]).cast("int") + 1)).alias("neg_end"), x["priority"], x["label"]))

    def swept(found: Column) -> Column:
        """The state holds finished lists and a short one that ends with the last detection kept, so that a step
        copies few."""
        def step(state: Column, d: Column) -> Column:
            cur = state["cur"]
            last = F.element_at(cur, -1)
            free = (F.size(cur) == 0) | (d["start"] >= -F.try_element_at(cur, F.lit(-1))["neg_end"])
            kept = F.when(free, F.concat(cur, F.array(d))).when(
                d["priority"] < last["priority"], F.concat(F.slice(cur, 1, F.size(cur) - 1), F.array(d))).when(
                (d["priority"] == last["priority"]) & (d["neg_end"] < last["neg_end"]),
                F.concat(cur, F.array(d))).otherwise(cur)
            # written out twice: a lambda's result is copied, and ``done`` must not be
            full = F.size(kept) > CHUNK
            return F.struct(
                F.when(full, F.concat(state["done"], F.array(F.slice(kept, 1, CHUNK)))).otherwise(state["done"]).alias("done"),
                F.when(full, F.slice(kept, CHUNK + 1, 1)).otherwise(kept).alias("cur"))
        start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), nothing.alias("cur"))
        return F.aggregate(F.array_sort(found), start, step,
                           lambda a: F.flatten(F.concat(a["done"], F.array(a["cur"]))))

    def of(w: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.element_at(w, i + 1).isin(keywords))
        return swept(F.flatten(F.transform(hits, lambda i: tried(w, i))).cast(
            "array<struct<start:int,neg_end:int,priority:int,label:string>>"))

    gate = reduce(lambda a, b: a | b, (words.contains(f" {k} ") for k in keywords))
    return F.when(gate, F.transform(F.array(F.split(F.trim(words), " ")), of)[0]).otherwise(nothing)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (array of label, n, first, last), found (array of start, neg_end, priority, label)."""
    words = docs.select(F.col(id_col).alias("doc_id"), reduced(F.col(text_col)).alias("words"))
    return words.select("doc_id", (_spaces(F.col("words")) - 1).alias("n_words"),
                        base_places(F.col("words")).alias("base"), detections(F.col("words")).alias("found"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: word and base counts, labels and a score for every document."""
    base, found = F.col("base"), F.col("found")
    names = lambda a: F.transform(a, lambda x: x["label"])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.array_min(F.transform(found, lambda x: x["priority"]))
    score = F.when((F.size(base) > 0) | (best == 1), 1.0).when(best == 2, 0.6).otherwise(0.0)
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", F.aggregate(base, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["last"])).alias("last_word"),
        listed(names(base)).alias("base_labels"), listed(F.concat(names(base), names(found))).alias("labels"),
        score.alias("score"))
