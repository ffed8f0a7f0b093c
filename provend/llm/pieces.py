"""Token ids of whole texts by a BPE vocabulary file, with each distinct piece encoded once.

Both vocabularies used here cut a text into pieces by a pattern and merge inside
pieces only. So a piece has the same ids wherever it stands, and the library is
asked once for each distinct piece. What stands between single spaces is cut the
same wherever it stands too. So a slice of texts is split at spaces and its
distinct chunks are found by Arrow, only those are cut into pieces, and the ids
of the texts are gathered from the chunks' by NumPy.

This holds for texts of common Latin letters, digits, ASCII punctuation and plain
white space; any other text (and one with a special token's string) goes to the
library as a whole.

Memory is bounded: a slice is one text or at most ``SLICE_CHARS``, and the table of
pieces, which outlives a task, starts anew once it holds ``MAX_ENTRIES``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from provend.llm.worker_memory import keep_one

#: Letters and numbers among the characters that are not uncommon.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿĀ-įı-ſ"
NUMBER = "0-9²³¹¼-¾"
#: Patterns by which the two vocabulary files cut text, for such characters.
BYTE_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
#: Anything but tab, line breaks, ASCII, and Latin-1 / Latin Extended-A letters and signs (without the dotted I).
UNCOMMON = re.compile(r"[^\t\n\r -~¡-ÿĀ-įı-ſ]|<\|")
#: Spaces next to other white space: there a piece may hold more than one chunk's space.
MIXED_SPACE = ("  ", " \n", "\n ", "\t", "\r")
MAX_ENTRIES = 1_000_000
SLICE_CHARS = 1 << 23
MARK = "\0"  # stands between pieces on their way through the library; not a common character
CALL_PIECES = 200
CUT_CHUNKS = 20_000
GATHERED = 100_000  # stretches copied at a time


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts that hold at most ``chars`` together, or are one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > chars:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``rows`` of ``flat`` one after another, and their sizes."""
    out = [flat[:0]]
    for i in range(0, len(rows), GATHERED):
        part = rows[i:i + GATHERED]
        n = sizes[part]
        at = np.repeat(starts[part] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        out.append(flat[at])
    return np.concatenate(out), sizes[rows]


def _bounds(sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of groups of ``counts`` consecutive stretches of the given sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    last = np.cumsum(counts)
    starts = ends[last - counts]
    return starts, ends[last] - starts


class PieceEncoder:
    """``lower``: the vocabulary lower-cases text and drops white space. ``end_id`` closes every document."""

    def __init__(self, path: str, end_id: int, lower: bool, max_entries: int = MAX_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # pieces are cut and lower-cased already: what is left to do for them is the merging
        self.merging = Tokenizer.from_file(path)
        self.merging.normalizer = None
        self.merging.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(MARK, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.mark,) = self.merging.encode(MARK, add_special_tokens=False).ids
        self.cut = (WORD_PIECES if lower else BYTE_PIECES).findall
        self.lower, self.max_entries = lower, max_entries
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], dtype=self.dtype)
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}  # piece -> its row in starts and sizes
        self.flat = np.empty(0, self.dtype)
        self.starts = self.sizes = np.empty(0, np.int64)

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, joined, and their sizes. Many pieces go through the library as one text."""
        flat, sizes = [], []
        for i in range(0, len(pieces), CALL_PIECES):
            text = MARK.join(pieces[i:i + CALL_PIECES])
            ids = np.array(self.merging.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            marks = np.flatnonzero(ids == self.mark)
            flat.append(np.delete(ids, marks))
            sizes.append(np.diff(marks, prepend=-1, append=len(ids)) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _piece_rows(self, pieces: list[str]) -> np.ndarray:
        known, row_of = len(self.rows), self.rows.setdefault
        rows = np.array([row_of(p, len(self.rows)) for p in pieces], dtype=np.int64)
        new = len(self.rows) - known
        if new:
            flat, sizes = self._merged(list(islice(reversed(self.rows), new))[::-1])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        return rows

    def _cut_rows(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the chunks' pieces, one after another, and the number of pieces of each chunk."""
        rows, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(chunks), CUT_CHUNKS):  # pieces of few chunks at a time are held as strings
            cuts = [self.cut(c) for c in chunks[i:i + CUT_CHUNKS]]
            rows.append(self._piece_rows([p for ps in cuts for p in ps]))
            counts.append(np.fromiter(map(len, cuts), np.int64, len(cuts)))
        return np.concatenate(rows), np.concatenate(counts)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole texts, each closed by the end id, one after another; and the number of ids of each.

        A null text counts as empty.
        """
        if len(self.rows) > self.max_entries:
            self._reset()
        texts = [t or "" for t in texts]
        odd = [i for i, t in enumerate(texts) if UNCOMMON.search(t)]
        mixed = [] if self.lower else [i for i, t in enumerate(texts) if any(x in t for x in MIXED_SPACE)]
        plain = list(texts)
        for i in (*odd, *mixed):
            plain[i] = ""
        heads = [] if self.lower else [t.split(" ", 1)[0] for t in plain]
        for i in set(mixed).difference(odd):
            heads[i] = texts[i]  # cut as a whole
        plain = pa.array(plain, pa.large_string())
        chunks = pc.utf8_split_whitespace(plain) if self.lower else pc.split_pattern(plain, " ")
        n_chunks = chunks.value_lengths().to_numpy().astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        del plain, chunks, coded
        if self.lower:
            distinct = [c.lower() for c in distinct]
        else:  # white space counts: a chunk has the space before it, but a text's first has none
            codes[np.cumsum(n_chunks) - n_chunks] = len(distinct) + np.arange(len(texts))
            distinct = [" " + c for c in distinct] + heads
        rows, counts = self._cut_rows(distinct)
        flat, sizes = _gathered(self.flat, self.starts, self.sizes, rows)
        starts, sizes = _bounds(sizes, counts)
        # every text's last chunk is the end id, for uncommon texts after their ids
        lasts = [self.end]
        if odd:
            found = self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)
            lasts += [np.append(np.array(e.ids, dtype=self.dtype), self.end) for e in found]
        last = np.full(len(texts), len(distinct), dtype=np.int64)
        last[odd] += 1 + np.arange(len(odd))
        n_last = np.array([len(x) for x in lasts], dtype=np.int64)
        starts = np.concatenate([starts, len(flat) + np.cumsum(n_last) - n_last])
        flat, sizes = np.concatenate([flat, *lasts]), np.concatenate([sizes, n_last])
        ids, sizes = _gathered(flat, starts, sizes, np.insert(codes, np.cumsum(n_chunks), last))
        return ids, _bounds(sizes, n_chunks + 1)[1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text and the end id."""
        return self.encode_all([text])[0]


def encoder(path: str, end_id: int, lower: bool, max_entries: int = MAX_ENTRIES) -> PieceEncoder:
    """This worker's encoder of a vocabulary."""
    key = path, end_id, lower, max_entries
    return keep_one(key, lambda: PieceEncoder(*key))
