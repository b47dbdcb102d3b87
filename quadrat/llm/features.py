"""Dense features of a text's form, shared by the classifiers."""

from __future__ import annotations

import numpy as np

#: Byte classes: 0 other, 1 lower, 2 capital, 3 digit, 4 white space, 5 sentence marks, 6 symbols, 7 bytes beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[list(b" \t\n\r\x0b\x0c")], _CLASS[list(b".,;:?!'\"()-")], _CLASS[list(b"#*$%&|<>@=+/\\_~^{}[]")] = 4, 5, 6

FORM = (
    "log_words", "few_words", "word_length", "digits", "capitals", "capital_words", "marks", "symbols", "shouts", "bars",
    "distinct", "repeats", "same_next", "line_repeats", "line_length", "symbol_words", "beyond_ascii",
)


def form(text: str) -> list[float]:
    """The features in the order of FORM; rates are 0 for an empty text."""
    data = text.encode()
    n = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8).astype(float)
    words = data.split()
    count, chars = max(len(words), 1), max(len(data) - n[4], 1.0)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(len(words))),
        max(0.0, 1 - len(words) / 50),
        min(chars / count, 30.0) / 10,
        n[3] / chars,
        n[2] / chars,
        sum(map(bytes.isupper, words)) / count,
        n[5] / chars,
        n[6] / chars,
        data.count(b"!") / count,
        data.count(b"|") / count,
        len(set(words)) / count,
        1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        same / count,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        float(np.log1p(count / max(len(lines), 1))),
        sum(w[-1] in b"#*$%&|<>" for w in words) / count,
        n[7] / chars,
    ]
