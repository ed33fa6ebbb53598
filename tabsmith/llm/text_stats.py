"""Counts of whole texts, a batch at a time.

All functions see every byte of a text. A null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tabsmith.llm.textbatch import SLICE_BYTES, Words, mix, run_hashes, string_buffers

#: At most so many texts in a slice, so that much of a hash fits beside a text's number.
SLICE_TEXTS = 8192
U = np.uint64

#: FIXED VALUE: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?.,;:"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK = _table(SYMBOLS), _table(MARKS)
_BANG = _table(b"!")
_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_LINE_BYTES = mix((np.arange(256, dtype=np.uint64) + U(77)) * U(0x9E3779B97F4A7C15)) | U(1)

#: The counts of one text, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines",
          "n_distinct", "n_upper", "n_digits", "n_marks", "n_bangs", "n_long_words")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _keyed(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, U]:
    """The numbers of n texts before the upper bits of hashes, as many as are left; and how many those are."""
    bits = 64 - max(1, (n - 1).bit_length())
    return (text.astype(np.uint64) << U(bits)) | (hashes >> U(64 - bits)), U(bits)


def _line_counts(raw: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier one, for each text."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    text_of = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(n), text_of])
    # sorted by place, each line ends where the text's next break or the text itself ends
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    stop = np.empty(len(starts), np.int64)
    stop[:-1] = starts[1:] - 1
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool)
    stop[last] = offsets[1:][text[last]]
    first_word = np.searchsorted(words.starts, starts)
    after = np.searchsorted(words.starts, stop)
    full = after > first_word
    starts, stop, text = starts[full], stop[full], text[full]
    keys, bits = _keyed(text, run_hashes(_LINE_BYTES[raw], starts, stop), n)
    keys = np.unique(keys)
    lines = np.bincount(text, minlength=n)
    return lines, lines - np.bincount((keys >> bits).astype(np.int64), minlength=n)


def _repeat_words(words: Words, n: int) -> np.ndarray:
    """Words inside 3-word windows that their text has twice or more."""
    if len(words.starts) < 3:
        return np.zeros(n, np.int64)
    hashes, bounds = words.windows(3)
    text = np.repeat(np.arange(n), np.diff(bounds))
    place = np.arange(len(hashes)) - bounds[text] + words.bounds[text]
    keys, _ = _keyed(text, hashes, n)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = place[order[twice]]
    covered = np.zeros(len(words.starts) + 2, bool)
    for k in range(3):
        covered[at + k] = True
    return _per_text(covered[:len(words.starts)], words.bounds)


def slice_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """An array of one row a text and one column for each of COUNTS."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(raw):
        return out
    words = Words(raw, offsets, 0, fold=False)
    point = (raw & 0xC0) != 0x80                      # first bytes of code points
    col = {name: k for k, name in enumerate(COUNTS)}
    out[:, col["n_words"]] = words.counts
    out[:, col["word_chars"]] = _per_text(point & words.solid, offsets)
    out[:, col["n_chars"]] = _per_text(point, offsets)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK),
                        ("n_bangs", _BANG)):
        out[:, col[name]] = _per_text(table[raw], offsets)
    lines, dups = _line_counts(raw, offsets, words)
    out[:, col["n_lines"]], out[:, col["n_dup_lines"]] = lines, dups
    out[:, col["n_repeat_words"]] = _repeat_words(words, n)
    text = np.repeat(np.arange(n), words.counts)
    keys, bits = _keyed(text, words.hashes, n)
    out[:, col["n_distinct"]] = np.bincount((np.unique(keys) >> bits).astype(np.int64), minlength=n)
    out[:, col["n_long_words"]] = _per_text(words.ends - words.starts > 20, words.bounds)
    return out


def column_counts(col: pa.Array) -> np.ndarray:
    """``slice_counts`` of a whole string column, about SLICE_BYTES at a time."""
    raw, offsets = string_buffers(col)
    n, i, parts = len(offsets) - 1, 0, []
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n, i + SLICE_TEXTS)
        lo, hi = int(offsets[i]), int(offsets[j])
        parts.append(slice_counts(raw[lo:hi], offsets[i:j + 1] - lo))
        i = j
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
