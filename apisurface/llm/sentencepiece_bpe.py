"""SentencePiece models of the merge type: exact encoding by backtracking over longest matches, and decoding.

A text is the sequence of tokens in which every two neighbours stay apart when their joint text is merged anew. The
encoder takes the longest vocabulary entry at each place (found by one automaton pass), goes back to shorter ones
where neighbours do not fit, and marks places from which no way led on in a bitfield, so no place is tried twice. No entry of
the vocabulary has the word mark behind another character, so texts are encoded word by word through a bounded cache.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from apisurface.llm.frames import in_arrow, pick, sliced

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What the unknown token is decoded to.
UNKNOWN_TEXT = " \u2047 "

# Bytes that make no character are replaced one by one.
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one message in protocol buffer wire format: number, then integer or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    sizes = {5: 4, 1: 8}
    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = sizes.get(kind)
        size = number() if size is None else size
        yield tag >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Vocabulary of a model file, with its encoder. Only merge models without text normalisation are accepted."""

    def __init__(self, path: str, cache_words: int = 500_000) -> None:
        import struct

        import ahocorasick

        self.cache_words = cache_words
        self.texts: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, self.squeeze, normal_form, model_type = True, True, b"", 1
        with open(path, "rb") as file:
            content = file.read()
        for field, value in wire_fields(content):
            if field == 1:
                piece = dict(wire_fields(value))
                self.texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                model_type = dict(wire_fields(value)).get(3, 1)
            elif field == 3:
                spec = dict(wire_fields(value))
                normal_form = spec.get(2, b"")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if model_type != 2 or normal_form or self.squeeze or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge models with identity normalisation and byte fallback are supported")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == NORMAL}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("an entry joins words")
        self.scores = {t: scores[i] for t, i in self.ids.items()}
        self.byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.end_id = self.texts.index("</s>")
        # A line feed that no entry holds is never merged, so it cuts words as well.
        self.pattern = WORD if any("\n" in t for t in self.ids) else LINE_WORD
        # Reversed entries: the matches of a reversed text that end at one place begin at one place of the text.
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for text in self.ids:
            self.automaton.add_word(text[::-1])
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[str, int, bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Symbols of ``text`` after all merges, best score first, then leftmost."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols):
                joined = symbols[i] + symbols[j]
                if (score := self.scores.get(joined)) is not None:
                    heapq.heappush(heap, (-score, i, joined))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else len(symbols)
            if symbols[i] is None or j >= len(symbols) or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def fit(self, left: str, right: str) -> bool:
        """Whether the two neighbours stay as they are when their joint text is merged anew; ``left`` is empty for a first token."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == [t for t in (left, right) if t]
        return known

    def prefix(self, token: str) -> str:
        """The next shorter entry that starts the token, its first character at least; empty for one character."""
        known = self.shorter.get(token)
        if known is None:
            cut = len(token) - 1
            while cut > 1 and token[:cut] not in self.ids:
                cut -= 1
            known = self.shorter[token] = token[:cut]
        return known

    def tokens(self, word: str) -> list[str]:
        """Tokens of one word by backtracking."""
        n = len(word)
        longest = [1] * n
        for end, length in self.automaton.iter(word[::-1]):
            start = n - 1 - end
            if length > longest[start]:
                longest[start] = length
        out: list[str] = []
        open_places = bytearray(b"\1") * (n + 1)
        at = 0
        token = word[: longest[0]] if n else ""
        while at < n:
            while token:
                end = at + len(token)
                if open_places[end] and self.fit(out[-1] if out else "", token):
                    break
                token = self.prefix(token)
            if token:
                out.append(token)
                at = end
                token = word[at : at + longest[at]] if at < n else ""
                continue
            open_places[at] = 0
            last = out.pop()
            at -= len(last)
            token = self.prefix(last)
        return out

    def ids_of(self, tokens: list[str]) -> list[int]:
        """Ids of tokens; what is no entry becomes its bytes."""
        out: list[int] = []
        for token in tokens:
            found = self.ids.get(token)
            if found is None:
                out.extend(self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass"))
            else:
                out.append(found)
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text: a run of marks with what follows up to the next mark; none for an empty text."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return self.pattern.findall(MARK + marked if self.dummy_prefix else marked)

    def piece_bytes(self, token_id: int) -> bytes:
        if token_id in self.byte_of:
            return bytes((self.byte_of[token_id],))
        if self.kinds[token_id] == UNKNOWN:
            return UNKNOWN_TEXT.encode()
        return b"" if self.kinds[token_id] == CONTROL else self.texts[token_id].replace(MARK, " ").encode()

    def word(self, word: str) -> tuple[str, int, bytes, str]:
        """Ids joined by blanks, their number, the decoded bytes and the last token of one word, through the cache."""
        known = self.words.get(word)
        if known is None:
            known = self.with_sign(word) or self.entry(self.tokens(word))
            if len(self.words) >= self.cache_words:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = known
        return known

    def entry(self, tokens: list[str]) -> tuple[str, int, bytes, str]:
        ids = self.ids_of(tokens)
        return " ".join(map(str, ids)), len(ids), b"".join(map(self.piece_bytes, ids)), tokens[-1]

    def with_sign(self, word: str) -> tuple[str, int, bytes, str] | None:
        """The word as that of all but its last sign and the sign, if the two tokens that meet there stay apart."""
        sign = word[-1]
        if sign not in SIGNS or len(word) < 3 or len(word) > 64 or sign not in self.ids:
            return None
        ids, n, data, last = self.word(word[:-1])
        if not self.fit(last, sign):
            return None
        return f"{ids} {self.ids[sign]}", n + 1, data + sign.encode(), sign

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text and the end id."""
        return [i for word in self.split(text or "") for i in self.ids_of(self.tokens(word))] + [self.end_id]

    def encode_words(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, ids joined by blanks, and decoded text, through the cache of words."""
        parts = list(map(self.word, self.split(text or "")))
        ids = " ".join([*[p[0] for p in parts], str(self.end_id)])
        return 1 + sum([p[1] for p in parts]), ids, self.shown(b"".join([p[2] for p in parts]))

    def decode(self, ids: list[int]) -> str:
        """Text of ids. The blank that encoding puts in front goes; bytes that make no character become replacement signs."""
        # Bytes make characters with their neighbours only, not over a control token.
        parts = [
            b"".join(map(self.piece_bytes, run)).decode("utf-8", "each_byte")
            for _, run in itertools.groupby(ids, lambda i: self.kinds[i])
        ]
        text = "".join(parts)
        # Only the mark of a first entry stands for the blank in front.
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        marked = first is not None and self.kinds[first] == NORMAL and self.texts[first].startswith(MARK)
        return text[1:] if self.dummy_prefix and marked else text

    def shown(self, data: bytes) -> str:
        if self.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "each_byte")


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LINE_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Signs that are tried as a token of their own behind the tokens of what precedes them.
SIGNS = frozenset(".,;:!?")
MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """The model of a file, loaded once in each Python process."""
    if path not in MODELS:
        MODELS[path] = PieceModel(path)
    return MODELS[path]


SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"


def encode_decode(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` (with the end id), ``ids`` in decimal joined by blanks, ``decoded``; one row for each row.

    Null texts are empty and have the end id alone. Whole texts are encoded whatever their length, repeated rows each for
    themselves. There is no shuffle and no limit on words; the cache holds short words only and is bounded. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in sliced(batches):
            coded = [model.encode_words(text) for text in batch.column(1).to_pylist()]
            counts, ids, decoded = zip(*coded, strict=True) if coded else ([], [], [])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return in_arrow(pick(docs, doc_id=id_col, text=text_col), run, SCHEMA)
