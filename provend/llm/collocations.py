"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at ``PIECE_ENDS`` and those into words. In a
task, prefix polynomials over the bytes of a batch give every word a fingerprint, and
prefix polynomials over the words one to every n-gram, at a few vector operations each.
What is shuffled for each distinct n-gram of a slice is its 64-bit fingerprint (language
and length mixed in), its count, the range of a second, independent fingerprint, and one
occurrence pointer (text key and byte offset): never the phrase.

Lengths are counted one after the other. An n-gram can only be frequent if both its
(n-1)-grams are, so those not marked in a bitmap of fixed size are left out; the bitmap
never misses a frequent one, whatever the size of the input.

Only frequent phrases are materialised: pointers are joined with the texts, the phrase is
read there, and must have both fingerprints. A fingerprint whose second one is not the same
everywhere stands for several phrases; these are counted again by their text.

A phrase of 2 or more words that occurs ``min_count`` times is a candidate. For each way of
cutting it in two, with l and r the counts of both parts, it scores
floor(1000000 a a / (l r)), and the lowest counts. Candidates that lie inside a longer one
which has ``contained_percent`` of their count are dropped.

Defined cases: null texts are empty; a null language is ``und``; texts may have any length
(they are read in slices cut between words, n-grams over the cuts included); repeated rows
count each; ties go to the larger count, then to the phrase by its bytes; an empty table
gives no rows; ids and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provend.llm.rolling import mixed, spans
from provend.session import bound_batches, stage_table

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
CONTAINED_PERCENT = 50
SLICE_BYTES = 1 << 18  # bytes hashed at once
SLICE_WORDS = 1 << 18  # words whose n-grams are counted at once
BATCH_BYTES = 1 << 21
MAP_BITS = 26  # of the bitmap: 8 MB
OFFSET_BITS = 31  # of a pointer; texts have less than 2 GB

WORD = rb"[^ \t.,;:!?\n\x0b\x0c\r]+"
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(SPACES)] = 1
KIND[list(PIECE_ENDS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bases (odd, so that they have inverses) of the byte and word polynomials of both fingerprints
BASES = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5))
COUNTED = "fp long, n long, low long, high long, ptr long"


class Words:
    """Words of a buffer: byte offsets, numbers of their pieces and both fingerprints."""

    __slots__ = ("start", "stop", "piece", "marks")

    def __init__(self, start, stop, piece, marks):
        self.start, self.stop, self.piece, self.marks = start, stop, piece, marks

    def __len__(self) -> int:
        return len(self.start)

    def part(self, a: int, b: int | None = None) -> Words:
        return Words(self.start[a:b], self.stop[a:b], self.piece[a:b], [m[a:b] for m in self.marks])

    @staticmethod
    def joined(parts: list[Words]) -> Words:
        return Words(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("start", "stop", "piece")),
                     [np.concatenate(m) for m in zip(*(p.marks for p in parts))])

    def grams(self, n: int, salts: np.ndarray, which: int = 0) -> np.ndarray:
        """Fingerprint of the n-gram that begins at each word but the last n - 1."""
        at = np.arange(len(self) - n + 1)
        if len(at) == 0:
            return np.zeros(0, dtype=np.uint64)
        return mixed(mixed(spans(self.marks[which], BASES[which][1], at, at + n) + np.uint64(n)) ^ salts[:len(at)])


def words_of(buf: np.ndarray, slice_bytes: int) -> Iterator[Words]:
    """The words of a buffer, slice by slice; slices end between words."""
    at, pieces = 0, 0
    while at < len(buf):
        end = min(at + slice_bytes, len(buf))
        if end < len(buf):
            cuts = np.flatnonzero(KIND[buf[at:end]])
            while not len(cuts) and end < len(buf):  # a word longer than the slice
                begin, end = end, min(end + slice_bytes, len(buf))
                cuts = np.flatnonzero(KIND[buf[begin:end]]) + (begin - at)
            end = at + int(cuts[-1]) + 1 if len(cuts) else end
        low = LOWER[buf[at:end]]
        kind = KIND[low]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edges[0::2], edges[1::2]
        ended = np.cumsum(kind == 2, dtype=np.int64) + pieces
        digits = low.astype(np.uint64) + np.uint64(1)
        yield Words(start + at, stop + at, ended[start], [mixed(spans(digits, b, start, stop)) for b, _ in BASES])
        at, pieces = end, int(ended[-1])


def slices(buf: np.ndarray, n: int, slice_bytes: int, slice_words: int) -> Iterator[tuple[Words, int]]:
    """(words, how many n-grams begin here): every n-gram of the buffer once, those over the cuts too."""
    held: list[Words] = []
    for words in words_of(buf, slice_bytes):
        held.append(words)
        if sum(map(len, held)) >= slice_words:
            all_ = Words.joined(held)
            yield all_, len(all_) - n + 1
            held = [all_.part(len(all_) - n + 1)] if n > 1 else []
    if held:
        yield (last := Words.joined(held)), max(0, len(last) - n + 1)


class Batch:
    """An Arrow batch (text, salt long, key long) as one buffer, a piece end behind every text."""

    def __init__(self, batch: pa.RecordBatch):
        end, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        texts = pc.binary_join_element_wise(batch.column("text").cast(pa.large_string()), end, nothing)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        self.buf, self.offsets = raw[offsets[0]:offsets[-1]], offsets - offsets[0]
        self.salts = batch.column("salt").to_numpy().view(np.uint64)
        self.keys = batch.column("key").to_numpy()

    @classmethod
    def small(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
        """Batches of bounded size (a longer text by itself)."""
        for batch in batches:
            size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(size) - size) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield cls(batch.slice(a, b - a))

    def texts_of(self, words: Words) -> np.ndarray:
        return np.searchsorted(self.offsets, words.start, side="right") - 1

    def grams(self, n: int, known: np.ndarray | None, bits: int, slice_bytes: int, slice_words: int):
        """(words, place of the first word, text number, fingerprint, second fingerprint) of n-grams, slice by slice.

        With ``known``, a bitmap of the fingerprints of frequent (n-1)-grams, only of those whose both parts are in it.
        """
        for words, begin in slices(self.buf, n, slice_bytes, slice_words):
            if begin <= 0:
                continue
            text = self.texts_of(words)
            salts = self.salts[text]
            at = np.arange(begin)
            fits = words.piece[at] == words.piece[at + n - 1]
            if known is not None and n > 1:
                seen = is_marked(known, cut_to(words.grams(n - 1, salts), bits))
                fits &= seen[at] & seen[at + 1]
            at = np.flatnonzero(fits)
            fp, check = words.grams(n, salts)[at], words.grams(n, salts, 1)[at]
            yield words, at, text[at], cut_to(fp, bits), check


def cut_to(fp: np.ndarray, bits: int) -> np.ndarray:
    return fp if bits == 64 else fp & np.uint64((1 << bits) - 1)


def is_marked(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    bit = fp & np.uint64((1 << MAP_BITS) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(fps: DataFrame) -> np.ndarray:
    """A bitmap of 2^MAP_BITS bits with those of the fingerprints set; what reaches the driver has this size at most."""
    bit = F.col("fp").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = (fps.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast((fp & 63) as int))").alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


class Miner:
    """Frequent phrases of up to ``max_words`` words and the collocations among them."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, bits: int = 64, slice_bytes: int = SLICE_BYTES,
                 slice_words: int = SLICE_WORDS):
        lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.docs = docs.select(text.alias("text"), lang.alias("lang")).select(
            "text", "lang", F.xxhash64("lang").alias("salt"),
            F.shiftrightunsigned(F.xxhash64("lang", "text"), OFFSET_BITS).alias("key"))
        self.spark, self.min_count, self.max_words = docs.sparkSession, min_count, max_words
        bound_batches(self.spark)
        self.bits, self.sizes = bits, (slice_bytes, slice_words)

    def _counted(self, n: int, known: np.ndarray | None) -> DataFrame:
        """(fp, a, low, high, ptr) of the n-grams counted ``min_count`` times or more."""
        sent, bits, sizes = self.spark.sparkContext.broadcast(known), self.bits, self.sizes

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in Batch.small(batches):
                for words, at, text, fp, check in batch.grams(n, sent.value, bits, *sizes):
                    if not len(at):
                        continue
                    ptr = (batch.keys[text] << OFFSET_BITS) | (words.start[at] - batch.offsets[text])
                    order = np.argsort(fp)
                    fp, check, ptr = fp[order].view(np.int64), check[order].view(np.int64), ptr[order]
                    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(fp[first]), pa.array(np.diff(first, append=len(fp))),
                        pa.array(np.minimum.reduceat(check, first)), pa.array(np.maximum.reduceat(check, first)),
                        pa.array(np.minimum.reduceat(ptr, first))], ["fp", "n", "low", "high", "ptr"])

        grams = self.docs.select("text", "salt", "key").mapInArrow(count, COUNTED)
        return grams.groupBy("fp").agg(F.sum("n").alias("a"), F.min("low").alias("low"), F.max("high").alias("high"),
                                       F.min("ptr").alias("ptr")).where(F.col("a") >= self.min_count)

    def phrases(self) -> DataFrame:
        """(lang, words, phrase, a) of every phrase that occurs ``min_count`` times, staged."""
        levels, known = [], None
        for n in range(1, self.max_words + 1):
            level = stage_table(self._counted(n, known).withColumn("words", F.lit(n)), f"collocations-{n}")
            levels.append(level)
            if n < self.max_words:
                known = bitmap_of(level.select("fp"))
        found = levels[0]
        for level in levels[1:]:
            found = found.unionByName(level)
        out = self._read_at_pointers(found.where("low = high"))
        mixed_up = stage_table(found.where("low <> high").select("words", "fp"), "collocations-collided")
        if not mixed_up.isEmpty():
            out = out.unionByName(self._recounted(mixed_up))
        return stage_table(out, "collocations-phrases")

    def _read_at_pointers(self, found: DataFrame) -> DataFrame:
        """Phrases from their texts; what does not have both fingerprints stands in another text with the same key."""
        bits, sizes = self.bits, self.sizes
        offset = F.col("ptr").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))
        wanted = found.select(F.shiftrightunsigned("ptr", OFFSET_BITS).alias("key"),
                              F.struct("words", "fp", F.col("low").alias("check"), offset.alias("at")).alias("x"))
        # a text's list holds at most its own n-grams; of equal texts one is read
        lists = wanted.groupBy("key").agg(F.collect_list("x").alias("wanted"))
        texts = self.docs.distinct()

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    raw, by_length = row["text"].encode().lower(), {}
                    for x in row["wanted"]:
                        by_length.setdefault(x["words"], []).append(x)
                    for n, some in by_length.items():
                        phrase = regex.compile(WORD + rb"(?:[ \t]+" + WORD + rb"){%d}" % (n - 1))
                        at = [(x, m[0]) for x in some if (m := phrase.match(raw, x["at"]))]
                        if not at:
                            continue
                        text = b"\n".join(m for _, m in at) + b"\n"
                        words = Words.joined(list(words_of(np.frombuffer(text, dtype=np.uint8), sizes[0])))
                        salts = np.full(len(words), row["salt"], dtype=np.int64).view(np.uint64)
                        fp, check = (words.grams(n, salts, k)[::n] for k in (0, 1))
                        ok = (cut_to(fp, bits) == np.array([x["fp"] for x, _ in at], dtype=np.int64).view(np.uint64)) & (
                            check == np.array([x["check"] for x, _ in at], dtype=np.int64).view(np.uint64))
                        kept = [y for y, fine in zip(at, ok) if fine]
                        yield pa.RecordBatch.from_pylist(
                            [{"lang": row["lang"], "words": n, "fp": x["fp"], "phrase": b" ".join(m.split()).decode()}
                             for x, m in kept],
                            pa.schema([("lang", pa.string()), ("words", pa.int32()), ("fp", pa.int64()), ("phrase", pa.string())]))

        read_ = (lists.join(texts, "key").select("text", "lang", "salt", "wanted")
                 .mapInArrow(read, "lang string, words int, fp long, phrase string").distinct())
        return read_.join(found.select("words", "fp", "a"), ["words", "fp"]).select("lang", "words", "phrase", "a")

    def _recounted(self, mixed_up: DataFrame) -> DataFrame:
        """Exact counts, by text, of the phrases whose fingerprint (words, fp) stands for several."""
        marks = self.spark.sparkContext.broadcast({n: bitmap_of(mixed_up.where(F.col("words") == n))
                                                   for n in range(1, self.max_words + 1)})
        bits, sizes, max_words = self.bits, self.sizes, self.max_words
        schema = pa.schema([("salt", pa.int64()), ("words", pa.int32()), ("fp", pa.int64()), ("phrase", pa.string()),
                            ("n", pa.int64())])

        def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in Batch.small(batches):
                for n in range(1, max_words + 1):
                    for words, at, text, fp, _ in batch.grams(n, None, bits, *sizes):
                        hit = np.flatnonzero(is_marked(marks.value[n], fp))
                        counts: dict[tuple, int] = {}
                        for i in hit.tolist():
                            raw = batch.buf[words.start[at[i]]:words.stop[at[i] + n - 1]].tobytes()
                            key = (int(batch.salts[text[i]].view(np.int64)), int(fp[i].view(np.int64)),
                                   b" ".join(raw.lower().split()))
                            counts[key] = counts.get(key, 0) + 1
                        if counts:
                            yield pa.RecordBatch.from_pylist(
                                [{"salt": s, "words": n, "fp": f, "phrase": p.decode(), "n": c}
                                 for (s, f, p), c in counts.items()], schema)

        found = self.docs.select("text", "salt", "key").mapInArrow(recount, "salt long, words int, fp long, phrase string, n long")
        langs = self.docs.select("salt", "lang").distinct()
        return (found.groupBy("salt", "words", "fp", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= self.min_count)
                .join(mixed_up, ["words", "fp"], "left_semi").join(langs, "salt").select("lang", "words", "phrase", "a"))

    def word_totals(self) -> DataFrame:
        """(lang, n): all word occurrences of each language."""
        words = F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+")).cast("long")
        return self.docs.groupBy("lang").agg(F.sum(words).alias("n"))

    def collocations(self, top: int = TOP, contained_percent: int = CONTAINED_PERCENT) -> DataFrame:
        """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language."""
        phrases = self.phrases()
        parts = F.split("phrase", " ", -1)
        joined = lambda begin, n: F.concat_ws(" ", F.slice(parts, begin, n))
        candidates = phrases.where("words >= 2")
        cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"),
                           joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
        side = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
        # counts below 10^16; the products have up to 38 digits
        score = F.expr("cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 "
                       "div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
        scored = (cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
                  .select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
                  .groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")))
        # every candidate that lies inside a longer one, with the highest count of those
        inner = candidates.where("words >= 3").select("lang", F.col("a").alias("longer"), "words", "phrase", F.explode(
            F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
                F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m")))))).alias("x"))
        inner = inner.select("lang", "longer", joined(F.col("x.i"), F.col("x.m")).alias("phrase"))
        inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        dropped = F.coalesce(100 * F.col("longer") >= contained_percent * F.col("a"), F.lit(False))
        left = scored.join(inner, ["lang", "phrase"], "left").where(~dropped)
        order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
        best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return best.join(self.word_totals(), "lang").select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: each language's 2000 best collocations of two and three words."""
    return Miner(spark.read.parquet(f"{sf_dir}/documents.parquet")).collocations()


SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r,
         CAST((1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
), i AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
  GROUP BY lang, phrase
), d AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT d.lang, rank, phrase, a, l, r, n, score FROM d JOIN t USING (lang) WHERE rank <= 2000
"""
