"""Packing of documents into fixed windows by the sum-of-squares rule, online, one pass over each partition.

Tokens of a document (its ids, then an end id) are cut at the window size; whole windows stand alone, the rest is placed
where it makes the sum of squared counts of partly filled windows smallest. The counts are kept in an array by fill level.
At the end of a partition the windows that are still open are filled from the emptiest of them, by cutting, so that
all but one are full.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from apisurface.llm.frames import in_arrow, pick, sliced

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SIGNS = ".,;:!?"
FIELDS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


LATIN = str.maketrans({chr(b): letter for b, letter in byte_letters().items()})


def as_letters(word: str) -> str | None:
    """The one token run that the tokenizer makes of a word of letters: composed, lower-cased. None if it may make another.

    The tokenizer knows no final sigma, and composing or lower-casing some letters leaves signs that are none.
    """
    if not word.isalpha():
        return None
    lower = word.lower()
    if word.isascii():
        return lower
    if "\u03a3" in word or not unicodedata.is_normalized("NFC", word) or not lower.isalpha():
        return None
    return lower


class WordTokenizer:
    """Ids of a text by a tokenizer file whose tokens never reach over blanks, through a bounded cache of words."""

    def __init__(self, path: str, end_id: int, cache_words: int = 1_000_000) -> None:
        self.path, self.cache_words = path, cache_words
        self.end = np.array([end_id], "<u4").tobytes()
        self.cache: dict[str, bytes] = {}
        self.tokenizer = None

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "tokenizer": None, "merges": None}

    def __call__(self, text: str | None) -> np.ndarray:
        # Only the blank and the line feed cut words; other white space is left to the tokenizer.
        words = (text or "").replace("\n", " ").split(" ")
        cache = self.cache
        # One look-up of each word, unless some are new; two blanks in a row enclose an empty word, which has no ids.
        found = list(map(cache.get, words))
        if None in found:
            new = dict.fromkeys(w for w, ids in zip(words, found, strict=True) if ids is None)
            if len(cache) + 2 * len(new) > self.cache_words:
                cache.clear()
                new = dict.fromkeys(words)
            cache[""] = b""
            if new := [w for w in new if w]:
                self.learn(new)
            found = list(map(cache.__getitem__, words))
        found.append(self.end)
        return np.frombuffer(b"".join(found), "<u4")

    def learn(self, words: list[str]) -> None:
        """Put words into the cache. A word of letters is one token run, and one sign behind it a run of its own."""
        if self.tokenizer is None:
            # The library's threads would compete with the other tasks of the executor.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.merges = self.tokenizer.model
        cache, odd = self.cache, []
        for word in words:
            signed = word[-1] in SIGNS
            letters = as_letters(word[:-1] if signed else word)
            if letters is None:
                odd.append(word)
                continue
            ids = cache.get(letters)
            if ids is None:
                ids = cache[letters] = self.run_ids(letters)
            cache[word] = ids + self.run_ids(word[-1]) if signed else ids
        for word, encoded in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            cache[word] = np.array(encoded.ids, "<u4").tobytes()

    def run_ids(self, run: str) -> bytes:
        """Ids of one token run."""
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(LATIN)
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()


class Packer:
    """Windows of one partition. ``add`` and ``close`` give finished pieces (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window = window
        self.next_sequence = first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.content: dict[int, list[tuple]] = {}

    def new_sequence(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def level_for(self, size: int) -> int:
        """Fill level to place a piece at, 0 for a new window: least rise of the sum of squares, then the fullest."""
        counts, window = self.counts, self.window
        levels = np.flatnonzero(counts[: window - size + 1])
        best, best_rise = 0, 2 * int(counts[size]) + 1 if size < window else 0
        if len(levels):
            target = levels + size
            closing = target == window
            rise = np.where(closing, 1 - 2 * counts[levels], 2 * (counts[np.minimum(target, window)] - counts[levels]) + 2)
            at = len(levels) - 1 - int(np.argmin(rise[::-1]))
            if rise[at] <= best_rise:
                best = int(levels[at])
        return best

    def place(self, piece: tuple) -> Iterator[tuple]:
        size = len(piece[2])
        level = self.level_for(size)
        if level:
            self.counts[level] -= 1
            sequence = self.open[level].pop()
        else:
            sequence = self.new_sequence()
            self.content[sequence] = []
        self.content[sequence].append((*piece, sequence, level))
        if level + size == self.window:
            yield from self.content.pop(sequence)
        else:
            self.counts[level + size] += 1
            self.open.setdefault(level + size, []).append(sequence)

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield (doc, start, ids[start : start + self.window], len(ids), self.new_sequence(), 0)
        if whole < len(ids):
            yield from self.place((doc, whole, ids[whole:], len(ids)))

    def close(self) -> Iterator[tuple]:
        """Fill the open windows, fullest first, with pieces of the emptiest; all but the last come out full."""
        left = sorted(((level, s) for level, ss in self.open.items() for s in ss), reverse=True)
        donors: list[tuple] = []
        while left:
            level, sequence = left.pop(0)
            yield from self.content.pop(sequence)
            while level < self.window and (donors or left):
                if not donors:
                    _, emptied = left.pop()
                    donors = [p[:4] for p in self.content.pop(emptied)]
                doc, start, ids, total = donors.pop()
                room = self.window - level
                yield (doc, start, ids[:room], total, sequence, level)
                level += min(room, len(ids))
                if len(ids) > room:
                    donors.append((doc, start + room, ids[room:], total))
        # What is left of the last donor makes windows of its own.
        level, sequence = 0, self.new_sequence() if donors else 0
        for doc, start, ids, total in donors:
            yield (doc, start, ids, total, sequence, level)
            level += len(ids)


def pack(docs: DataFrame, id_col: str, text_col: str, tokenize: Callable[[str | None], np.ndarray], window: int = 4096) -> DataFrame:
    """Pieces: ``doc_id``, ``start``, ``length``, ``ids`` (unsigned 32-bit, little-endian), ``doc_tokens``, ``sequence_id``, ``offset``.

    Every row of ``docs`` is packed, rows with null or empty text as the end id alone, repeated rows each for
    themselves, null ids as null. Each token is in exactly one piece. There is no shuffle: a partition makes sequences of its own,
    numbered from its partition number shifted by 33 bits. An empty partition makes none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 33)

        def pieces() -> Iterator[tuple]:
            for batch in sliced(batches):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from packer.add(doc, tokenize(text))
            yield from packer.close()

        found = pieces()
        while chunk := list(itertools.islice(found, 1000)):
            rows = [(d, s, len(i), i.tobytes(), t, q, o) for d, s, i, t, q, o in chunk]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), TYPES, strict=True)]
            yield pa.record_batch(columns, FIELDS)

    return in_arrow(pick(docs, doc_id=id_col, text=text_col), run, SCHEMA)
