"""Statistics of a text's words, lines and characters."""

from __future__ import annotations

import numpy as np

from millrace.llm.batches import rolling, split_words

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words in a window that may repeat.
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [
    "log_words",
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "top_share",
    "digit_share",
    "capital_share",
    "end_share",
    "symbol_word_share",
    "line_words",
    "short_line_share",
    "accent_share",
]

_SPACES = b" \t\n\x0b\x0c\r"
_NOT_DIGITS = bytes(set(range(256)) - set(b"0123456789"))
_NOT_CAPITALS = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def repeated(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    grams = rolling(hashes, width)
    ordered = np.sort(grams)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.isin(grams, ordered[1:][same])
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[: len(grams)] += twice
    edges[width : width + len(grams)] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_statistics(raw: bytes) -> tuple[list[int], list[float], list[bytes]]:
    """``COUNTS`` and ``SHARES`` of a text, and its words. An empty text has zeros throughout."""
    words = split_words(raw)
    n = len(words)
    n_chars = len(raw.decode("utf-8", "replace"))
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    # Python's own hash differs from process to process, but here words of one text are compared in one.
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeats = repeated(ids)
    counts = [n, n_chars - spaces, symbols, dup, repeats]
    if not n:
        return counts, [0.0] * len(SHARES), words
    chars = max(1, n_chars - spaces)
    ids.sort()
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    most = int(np.diff(starts, append=n).max())
    pairs = sum(raw.count(bytes([c, c])) for c in SYMBOLS) if symbols else 0
    shares = [
        float(np.log1p(n)),
        chars / n,
        symbols / chars,
        dup / len(lines),
        repeats / n,
        len(starts) / n,
        most / n,
        len(raw.translate(None, _NOT_DIGITS)) / chars,
        len(raw.translate(None, _NOT_CAPITALS)) / chars,
        (raw.count(b".") + raw.count(b"!") + raw.count(b"?")) / n,
        min(1.0, pairs / n),
        float(np.log1p(n / len(lines))),
        sum(len(x) < 40 for x in lines) / len(lines),
        (len(raw) - n_chars) / chars,
    ]
    return counts, shares, words
