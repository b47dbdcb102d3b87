"""Exact BPE piece encoding by backtracking, and decoding.

A sequence of pieces is the one that merging would give if and only if each pair of
neighbours stays as it is when the two are merged anew.  So the encoder walks the longest
dictionary matches, found by an Aho-Corasick automaton, from left to right.  When a match
doesn't agree with its left neighbour it tries the next shorter one, and when none is left
it drops the neighbour and marks the position as failed, so that no position is tried twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadrat.llm.common import map_rows, schema_of

#: The mark that stands for a space inside pieces.
MARK = "▁"
#: Distinct words whose ids a task remembers; beyond that it forgets all and starts again.
REMEMBERED = 400_000
#: Words longer than this are encoded but not remembered.
LONGEST_REMEMBERED = 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their merge scores; bounded by the model, so it may travel with a job."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: bytes  # by id: 0 normal, 1 byte, 2 other (never matched in text, decodes to nothing), 3 unknown


def load_vocabulary(path: str) -> Vocabulary:
    """Read a BPE model that keeps its text as it is, adds a leading space and falls back to bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    kind = [3 if model.is_unknown(i) else 2 if model.is_control(i) or model.is_unused(i) else int(model.is_byte(i)) for i in ids]
    words = Vocabulary(tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), bytes(kind))
    normal = [p for p, k in zip(words.pieces, words.kinds, strict=True) if k == 0]
    single = {p for p in normal if len(p) == 1}
    if sum(k == 1 for k in kind) != 256:
        raise ValueError("the model has no byte fallback")
    if any(c not in single for p in normal for c in p):
        raise ValueError("a piece has a character that is no piece itself")
    if any(MARK in p.lstrip(MARK) for p in normal):
        raise ValueError("a piece spans several words")
    if model.encode("a  b ", out_type=str)[0][0] != MARK or model.decode(model.encode(" ﬁ½ b ")) != " ﬁ½ b ":
        raise ValueError("the model normalises its text or adds no leading space")
    return words


class Known(dict):
    """Ids of words met lately; asks ``encode`` for others and starts again when it has grown too large."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.encode(word))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = vocabulary.pieces
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.plain: list[str | None] = []
        for i, (piece, kind) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)):
            if kind == 0:
                self.ids[piece] = i
            elif kind == 1:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            self.plain.append(None if kind == 1 else piece.replace(MARK, " ") if kind == 0 else " ⁇ " if kind == 3 else "")
        self.score = {p: vocabulary.scores[i] for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:  # any single character is a match of its own
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known = Known(self.encode_word)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.prefix: dict[str, str] = {}

    def merge(self, text: str) -> list[str]:
        """Merge characters by the best score, leftmost first: the definition, for short strings."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stays(self, left: str, right: str) -> bool:
        """Whether the two neighbours come out as they are when merged anew."""
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        found = self.merge(left + right) == ([left, right] if left else [right])
        self.pairs[left, right] = found
        return found

    def shorter(self, piece: str) -> str:
        """The next shorter piece that ``piece`` begins with, or nothing."""
        found = self.prefix.get(piece)
        if found is None:
            found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), "")
            self.prefix[piece] = found
        return found

    def split(self, word: str) -> list[str]:
        """Pieces of a word of known characters."""
        size, longest = len(word), list(word)
        for end, piece in self.automaton.iter(word):  # by end, so the last one for a start is the longest
            longest[end + 1 - len(piece)] = piece
        failed = 0  # a bit for each position from which no way leads on
        known, out, at, before, piece = self.pairs, [], 0, "", longest[0]
        while True:
            end = at + len(piece)
            if not failed or not failed >> end & 1:
                fits = known.get((before, piece))
                if self.stays(before, piece) if fits is None else fits:
                    out.append(piece)
                    if end == size:
                        return out
                    at, before, piece = end, piece, longest[end]
                    continue
            piece = self.shorter(piece)
            while not piece:
                if not out:
                    raise ValueError(f"no way to encode {word!r}")
                failed |= 1 << at
                piece = self.shorter(last := out.pop())
                at -= len(last)
                before = out[-1] if out else ""

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word; characters outside the vocabulary become their bytes."""
        if self.characters.issuperset(word):
            return [self.ids[p] for p in self.split(word)]
        ids: list[int] = []
        begin = 0
        for i, c in enumerate(word):
            if c not in self.ids:
                ids += [self.ids[p] for p in self.split(word[begin:i])] if begin < i else []
                ids += [self.byte_ids[b] for b in c.encode()]
                begin = i + 1
        return ids + ([self.ids[p] for p in self.split(word[begin:])] if begin < len(word) else [])

    def encode(self, text: str) -> list[int]:
        """Ids of a text, word by word: no piece has a space after another character, so words never merge."""
        if not text:
            return []
        words = self.words.findall(MARK + text.replace(" ", MARK))
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids without the leading space; bytes that are no UTF-8 become U+FFFD each."""
        plain = list(map(self.plain.__getitem__, ids))
        if None in plain:
            out, run = [], bytearray()
            for i, text in zip(ids, plain, strict=True):
                if text is None:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(_utf8(run))
                    run = bytearray()
                out.append(text)
            plain = [*out, _utf8(run)]
        text = "".join(plain)
        first = next((i for i in ids if self.plain[i] != ""), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


def _utf8(run: bytearray) -> str:
    """Text of the bytes, one U+FFFD for each byte that begins no whole character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            width = next((w for w in (1, 2, 3, 4) if _is_character(run[i : i + w], w)), 0)
            out.append(run[i : i + width].decode() if width else "�")
            i += width or 1
        return "".join(out)


def _is_character(data: bytearray, width: int) -> bool:
    try:
        return len(data) == width and len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def encode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode each row's whole text.

    Returns the key, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text in UTF-8); with ``ids`` also ``ids`` and ``decoded``.
    A null or empty text has no ids and decodes to the empty text.  Rows are independent:
    a null key and repeated rows come back as they are, an empty table gives an empty one.
    One pass, no shuffle; a task holds one batch and a bounded memory of words.
    """
    sent = df.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.scores, vocabulary.kinds))
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if ids:
        added |= {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        codec = Codec(Vocabulary(*sent.value))
        numbers = [str(i) for i in range(len(codec.pieces))]
        for keys, texts in batches:
            rows = []
            for value in texts:
                found = codec.encode(value or "")
                decoded = codec.decode(found)
                joined = ",".join(map(numbers.__getitem__, found))
                row = [len(found), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + [found, decoded] if ids else row)
            yield [keys, *([list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in added])]

    return map_rows(df, [key, text], schema_of(df, key, **added), run)
