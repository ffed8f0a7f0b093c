"""Language identification, words first, with back-off to shorter and shorter character n-grams.

A word of the vocabulary adds its log frequency in each language. A word outside
it is scored by its character n-grams, the longest length of which any is known
(from ``LONGEST`` down to 1). The language with the highest sum wins; the score is
its share under equal priors.

Word counts are Spark aggregates over a sample of labelled documents. The sample is bounded
for each language by ``fit_docs`` documents and ``fit_chars`` characters; all of its words and
n-grams are learned. The model is a few sorted arrays of 64-bit hashes with one row of
numbers each, so a worker needs some tens of megabytes for it. Every document is predicted,
on its whole text: a batch becomes one array of code points, words and n-grams are hashed by
prefix polynomials, and each distinct word is looked up once.

The score compares learned languages with each other only. Whether a text is of its
language at all is told by ``evidence``: the mean log frequency of its 3-grams, one for
each letter, on a scale with 0 for 3-grams drawn evenly from the language's letters and
1 for text of the language. The 1 is found by leaving each 3-gram out once, so it holds for
new text, however little was learned. ``identified`` rejects a text if its evidence lies
below ``LEAST`` by more than chance explains: the deviation allowed shrinks with the root of the
number of letters, so a short text stays unless its letters speak clearly against it. A text
most of whose letters no learned text of the language has is rejected at any length.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing was learned; ties go to the language first in order; labels
are never read when predicting; documents without id are not learned from and not
held out; repeated rows are predicted each; very long texts are read whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provend.llm.rolling import mixed, spans
from provend.llm.worker_memory import drop_all
from provend.session import bound_batches

LONGEST = 4
FIT_DOCS = 4000  # labelled documents learned from, for each language
FIT_CHARS = 6_000_000  # and their characters
FIT_WORDS = 50_000  # distinct words hashed at once when learning
UNKNOWN = "und"
EVIDENCE = 3  # length of the n-grams that tell text of a language from other letters
LEAST, DEVIATIONS = 0.4, 4.0  # evidence of new text, at least, and how many deviations below it are chance
FOREIGN = 0.5  # share of letters foreign to the language beyond which it is not told
BATCH_CHARS = 1 << 20  # characters scored at once (a longer text by itself)
SPACE = 32
BASE = 0x9E3779B97F4A7C15


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@functools.cache
def _letters() -> np.ndarray:
    """Is a code point a letter?"""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), dtype=bool,
                       count=sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray:
    """The lower-cased text's code points, everything but letters as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[points], points, np.uint32(SPACE))


def hashed(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mixed(spans(points.astype(np.uint64) + np.uint64(1), BASE, start, stop))


def in_line(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """These words one after the other, with one space between them and at both ends."""
    sizes = stop - start + 1
    ends = np.cumsum(sizes) + 1
    out = np.full(int(ends[-1]) if len(ends) else 1, SPACE, dtype=np.uint32)
    within = np.arange(len(out) - 1) - np.repeat(ends - 1 - sizes, sizes)
    inside = within < np.repeat(sizes - 1, sizes)
    out[1:][inside] = points[(np.repeat(start, sizes) + within)[inside]]
    return out


def grams(line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hash) of the n-grams of the words ``in_line``, with the spaces at a word's ends as
    its marks; single letters without marks."""
    n = len(line) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = line == SPACE
    spaces = np.concatenate([np.zeros(1, np.int32), np.cumsum(space, dtype=np.int32)])
    at = np.arange(n, dtype=np.int32)
    if size == 1:
        at = at[~space[at]]
    else:  # no space inside
        at = at[spaces[at + size - 1] == spaces[at + 1]]
        if size == 2:  # two marks are no n-gram
            at = at[~(space[at] & space[at + 1])]
    return spaces[at + 1] - 1, hashed(line, at, at + size)


class Table:
    """Sorted hashes; ``find`` gives each hash's row, or the number of rows if it is not there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        there = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes if len(self.keys) else np.zeros(len(at), bool)
        return np.where(there, at, len(self.keys))


def _summed(hashes: np.ndarray, of: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of the rows of counts that they are ``of``."""
    keys = np.unique(hashes)
    which = np.searchsorted(keys, hashes).astype(np.int32)
    sums = np.zeros((len(keys), counts.shape[1]))
    for i in range(counts.shape[1]):
        sums[:, i] = np.bincount(which, counts[of, i], len(keys))
    return keys, sums


def _logs(counts: np.ndarray) -> np.ndarray:
    """Log frequencies, smoothed by a half."""
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))


class Model:
    """Learned from a table of (lang, word, count): ``langs`` in order, and by word and n-gram one number for each language."""

    def __init__(self, counts: pa.Table):
        langs, words = (counts[c].combine_chunks().dictionary_encode() for c in ("lang", "word"))
        names = langs.dictionary.to_pylist()
        self.langs = sorted(names)
        column = np.array([self.langs.index(x) for x in names], dtype=np.int64)
        n = np.zeros((len(words.dictionary), len(names)))
        np.add.at(n, (words.indices.to_numpy(), column[langs.indices.to_numpy()]), counts["count"].to_numpy())
        words = words.dictionary

        def lines() -> Iterator[tuple[int, np.ndarray]]:
            for at in range(0, len(words), FIT_WORDS):
                some = " ".join(words.slice(at, FIT_WORDS).to_pylist())
                yield at, np.frombuffer(f" {some} ".encode("utf-32-le"), dtype=np.uint32)

        ends = [(line, np.flatnonzero(line == SPACE)) for _, line in lines()]
        keys, by_word = _summed(np.concatenate([np.zeros(0, np.uint64), *(hashed(x, e[:-1] + 1, e[1:]) for x, e in ends)]),
                                np.arange(len(words)), n)
        del ends
        self.words, self.word_logs = Table(keys), _logs(by_word).astype(np.float32)
        self.grams, self.gram_logs = {}, {}
        for size in range(1, LONGEST + 1):
            found = [(np.zeros(0, np.int32), np.zeros(0, np.uint64))]
            for at, line in lines():
                word, hashes = grams(line, size)
                found.append((word + np.int32(at), hashes))
            of, hashes = (np.concatenate(x) for x in zip(*found))
            del found
            keys, by_gram = _summed(hashes, of, n)
            self.grams[size], self.gram_logs[size] = Table(keys), _logs(by_gram).astype(np.float32)
            if size == 1:
                # letters that a language has; the last row is a letter that none has
                self.native = np.vstack([by_gram > 0, np.zeros((1, len(self.langs)), bool)]).astype(np.float32)
            if size == EVIDENCE:
                self.scale, self.deviation = self._scaled(by_gram, self.native.sum(axis=0) + 1)  # and the mark

    @classmethod
    def of(cls, counts: dict[tuple[str, str], int]) -> Model:
        return cls(pa.table({"lang": pa.array([x for x, _ in counts], pa.string()),
                             "word": pa.array([w for _, w in counts], pa.string()),
                             "count": pa.array(list(counts.values()), pa.int64())}))

    @staticmethod
    def _scaled(n: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the evidence by 3-gram, the last for one never seen, and its deviation by language.

        A language whose own text is not above even draws has no scale: its rows are 1, without deviation.
        """
        total = n.sum(axis=0)
        floor = np.log(0.5 / (total + 0.5 * len(n)))
        logs = np.log((n + 0.5) / (total + 0.5 * len(n)))
        even = floor + (logs - floor).sum(axis=0) / np.maximum(letters, 1) ** EVIDENCE
        without = np.log(np.maximum(n - 0.5, 0.5) / (total + 0.5 * len(n)))  # each 3-gram left out once
        typical = (n * without).sum(axis=0) / np.maximum(total, 1)
        known = typical > even
        unit = np.where(known, typical - even, 1.0)
        spread = np.sqrt((n * ((without - typical) / unit) ** 2).sum(axis=0) / np.maximum(total, 1))
        rows = np.where(known, (np.vstack([logs, floor]) - even) / unit, 1.0)
        return rows.astype(np.float32), np.where(known, spread, 0.0)

    def backed_off(self, line: np.ndarray, n: int) -> np.ndarray:
        """Mean log frequency of each of the n words' n-grams, of the longest length of which any is known, else zeros."""
        out = np.zeros((n, len(self.langs)))
        open_ = np.ones(n, dtype=bool)
        for size in range(LONGEST, 0, -1):
            of, hashes = grams(line, size)
            of, hashes = of[open_[of]], hashes[open_[of]]
            at = self.grams[size].find(hashes)
            found = at < len(self.grams[size].keys)
            of, at = of[found], at[found]
            known = np.bincount(of, minlength=n)
            for i in range(len(self.langs)):
                out[:, i] += np.bincount(of, self.gram_logs[size][at, i], n) / np.maximum(known, 1)
            open_ &= known == 0
        return out

    def weigh(self, texts: list[str | None], weighing: bool = True) -> Verdicts:
        """Language, score, evidence, letters and foreign letters of each text."""
        sizes, parts = [], []
        for t in texts:
            parts.append(code_points(t) if t else np.zeros(0, np.uint32))
            sizes.append(len(parts[-1]) + 1)
            parts.append(np.array([SPACE], np.uint32))
        points = np.concatenate([np.array([SPACE], np.uint32), *parts])
        edges = np.flatnonzero(np.diff(points != SPACE))
        start, stop = edges[0::2] + 1, edges[1::2] + 1
        text = np.searchsorted(np.cumsum(sizes) + 1, start, side="right")
        keys, first, which = np.unique(hashed(points, start, stop), return_index=True, return_inverse=True)
        n, langs = len(texts), len(self.langs)
        out = Verdicts(n, np.bincount(text, stop - start, n))
        if not langs or not len(keys):
            return out
        at = self.words.find(keys)
        new = np.flatnonzero(at == len(self.words.keys))
        rows = np.zeros((len(keys), langs))
        known = at < len(self.words.keys)
        rows[known] = self.word_logs[at[known]]
        rows[new] = self.backed_off(in_line(points, start[first[new]], stop[first[new]]), len(new))
        sums = np.stack([np.bincount(text, rows[which, i], n) for i in range(langs)], axis=1)
        best = sums.argmax(axis=1)
        some = out.letters > 0
        out.lang = [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
        with np.errstate(over="ignore", under="ignore"):
            out.score = np.where(some, 1.0 / np.exp(sums - sums[np.arange(n), best][:, None]).sum(axis=1), 0.0)
        if weighing:
            line = in_line(points, start[first], stop[first])
            mine = best[text]
            for size, table, value in ((EVIDENCE, self.scale, "evidence"), (1, self.native, "native")):
                of, hashes = grams(line, size)
                found = self.grams[size].find(hashes)
                by_word = np.stack([np.bincount(of, table[found, i], len(keys)) for i in range(langs)], axis=1)
                total = np.bincount(text, by_word[which, mine], n) / np.maximum(out.letters, 1)
                setattr(out, value, np.where(some, total, np.nan))
            out.least = LEAST - DEVIATIONS * self.deviation[best] / np.sqrt(np.maximum(out.letters, 1))
        return out


class Verdicts:
    """What was found out about each text of a batch."""

    def __init__(self, n: int, letters: np.ndarray):
        self.lang, self.score, self.letters = [UNKNOWN] * n, np.zeros(n), letters
        self.evidence, self.native, self.least = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n)

    def told(self) -> np.ndarray:
        """Is the text of its language, as far as its letters tell?"""
        return (self.letters > 0) & (self.evidence >= self.least) & (self.native >= 1.0 - FOREIGN)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """Learn from labelled documents that are not held out: at most about ``fit_docs`` and ``fit_chars`` of each
    language, chosen by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("double"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), chars.alias("chars")).collect()  # one row for each language
    if not sizes:
        return Model.of({})
    share = F.create_map(*(F.lit(x) for r in sizes for x in (
        r["lang"], min(1.0, fit_docs / r["n"], fit_chars / max(1.0, r["chars"])))))
    chance = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 20)) / float(1 << 20)
    return Model(rows.where(chance < share[F.col("lang")])
                 .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
                 .groupBy("lang", "word").count().toArrow())  # the words of a bounded sample


def predicted(spark, model: Model, text: Column, weighing: bool = False) -> Column:
    """Column struct<lang, score, told> of a text column; ``told`` is null if not ``weighing``."""
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,told:boolean>")
    def guess(texts: pa.Array) -> pa.Array:
        drop_all()  # what another operator's tasks left in this worker
        langs, scores, told = [], [], []
        for some in _small(texts):
            found = sent.value.weigh(some, weighing)
            langs += found.lang
            scores.append(found.score)
            told += found.told().tolist() if weighing else [None] * len(some)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, []])),
                                           pa.array(told, pa.bool_())], ["lang", "score", "told"])
    return guess(text)


def _small(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of at most ``BATCH_CHARS`` characters, a longer text by itself."""
    held, chars = [], 0
    for t in texts:
        t = t.as_py()
        if held and chars + len(t or "") > BATCH_CHARS:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t or "")
    if held:
        yield held


def identify(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       predicted(docs.sparkSession, model, F.col(text_col)).alias("guess"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def identified(docs: DataFrame, model: Model | None = None, *, text_col: str = "text") -> DataFrame:
    """The documents whose language is told, all columns as they were."""
    model = model or fit(docs, text_col=text_col)
    if not model.langs:
        return docs.limit(0)
    names = [f"c{i}" for i in range(len(docs.columns))]  # free of clashes with the column added
    text = F.col(names[docs.columns.index(text_col)])
    rows = docs.toDF(*names).withColumn("told", predicted(docs.sparkSession, model, text, weighing=True)["told"])
    return rows.where("told").drop("told").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: predicted language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
