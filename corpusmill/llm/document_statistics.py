"""Statistics of whole texts, as a vector of numbers, for the quality classifier."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Byte classes whose share of a text is a statistic.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "sentence": b".!?",
    "comma": b",;:",
    "symbol": b"#*$%&|<>@^~=+_/\\[]{}",
    "quote": b"'\"()-",
}
NAMES = (*CLASSES, "wide", "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "same_next", "words_per_line", "duplicate_lines", "lines_ended", "symbol_words", "letter_entropy")

_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _v in enumerate(CLASSES.values()):
    _CLASS_OF[list(_v)] = _k
_CLASS_OF[128:] = len(CLASSES) + 1
_SYMBOLS = bytes.maketrans(CLASSES["symbol"], b"#" * len(CLASSES["symbol"]))


def statistics(text: bytes) -> list[float]:
    """One number for each of ``NAMES``; an empty text has only zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, weights=counts, minlength=len(CLASSES) + 2) / len(text)
    n = len(words)
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = counts[counts > 0] / len(text)
    return [
        *shares[: len(CLASSES)].tolist(),
        float(shares[-1]),
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        (len(text) - n) / n,
        sum(map((24).__lt__, map(len, words))) / n,
        len(tally) / n,
        max(tally.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        text.translate(_SYMBOLS).count(b"# ") / n,
        float(-(letters * np.log2(letters)).sum()),
    ]
