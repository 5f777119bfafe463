"""Counts per text that quality rules and the quality classifier use, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

from trustloom.llm.words import IS_SPACE, mixed, window_hashes, word_bounds, word_hashes

WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[0xC0:] = True  # first bytes of other characters
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
CLOSING = np.zeros(256, dtype=bool)
CLOSING[list(b".,;:!?")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _first_seen(keys: np.ndarray) -> np.ndarray:
    _, first = np.unique(keys, return_index=True)
    new = np.zeros(len(keys), dtype=bool)
    new[first] = True
    return new


def _in_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    return h ^ mixed(text.astype(np.uint64) + np.uint64(1))


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text; words are runs of ``[^\\x20\\x09-\\x0D]``, lines are split at line feeds.

    ``n_repeat_words`` counts the words covered by windows of 8 words that the text has twice or more, ``n_dup_lines`` the lines
    with a word that equal an earlier line.
    """
    texts = len(offsets) - 1
    first, last, borders = word_bounds(data, offsets)
    words = np.diff(borders)
    text = np.repeat(np.arange(texts), words)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lengths = chars[last] - chars[first]
    hashes = word_hashes(data, first, last)

    def by_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=values, minlength=texts).astype(np.int64)
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    windows = window_hashes(hashes, WINDOW)
    if len(windows):
        at = np.flatnonzero(text[:len(windows)] == text[WINDOW - 1:])
        again = at[_repeats(_in_text(windows[at], text[at]))]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    covered = np.cumsum(covered)[:-1] > 0
    keys = _in_text(hashes, text)
    pairs = window_hashes(hashes, 2)
    same = np.flatnonzero(text[:len(pairs)] == text[1:]) if len(pairs) else np.zeros(0, np.int64)
    echo = np.bincount(text[same[hashes[same] == hashes[same + 1]]], minlength=texts)
    pair_new = np.bincount(text[same[_first_seen(_in_text(pairs[same], text[same]))]], minlength=texts)

    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_text = np.sort(np.concatenate([np.arange(texts), np.searchsorted(offsets, breaks, side="right") - 1]), kind="stable")
    ends = np.empty(len(begins), dtype=np.int64)
    ends[:-1] = begins[1:] - (line_text[1:] == line_text[:-1])
    if texts:
        ends[-1] = offsets[-1]
    solid = np.concatenate([[0], np.cumsum(~IS_SPACE[data])])
    filled = np.flatnonzero(solid[ends] > solid[begins])
    line_keys = _in_text(word_hashes(data, begins[filled], ends[filled]), line_text[filled])
    dup = ~_first_seen(line_keys)
    top = np.zeros(texts, dtype=np.int64)
    if len(keys):
        ordered = np.sort(keys)
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        often = np.diff(np.concatenate([heads, [len(ordered)]]))
        np.maximum.at(top, text, often[np.searchsorted(ordered[heads], keys)])
    upper = UPPER[data]
    upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    return {
        "n_words": words, "word_chars": by_text(lengths), "n_symbols": _per_text(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_text[filled[dup]], minlength=texts), "n_repeat_words": by_text(covered),
        "n_lines": np.bincount(line_text[filled], minlength=texts), "n_distinct": np.bincount(text[_first_seen(keys)], minlength=texts),
        "n_pairs": pair_new, "n_echo": echo, "n_top": top, "n_upper": _per_text(upper, offsets), "n_letters": _per_text(LETTER[data], offsets),
        "n_digits": _per_text(DIGIT[data], offsets), "n_closing": _per_text(CLOSING[data], offsets),
        "n_bangs": _per_text(data == 33, offsets), "n_bars": _per_text(data == 124, offsets),
        "n_short": by_text(lengths <= 3), "n_long": by_text(lengths >= 12), "n_ending": by_text(CLOSING[data[last - 1]] if len(last) else last)}


RATIOS = ("symbols", "dup_lines", "repeats", "word_chars", "distinct", "pairs", "echo", "top", "upper", "digits", "closing", "bangs", "bars",
          "short", "long", "ending", "line_words", "log_words")


def ratios(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics of ``RATIOS`` as columns, one row per text: shares of words, lines or letters, so that length matters little."""
    words, lines = np.maximum(stats["n_words"], 1), np.maximum(stats["n_lines"], 1)
    letters = np.maximum(stats["n_letters"], 1)
    chars = np.maximum(stats["word_chars"], 1)
    columns = [stats["n_symbols"] / words, stats["n_dup_lines"] / lines, stats["n_repeat_words"] / words, stats["word_chars"] / words,
               stats["n_distinct"] / np.power(words, 0.9), stats["n_pairs"] / words, stats["n_echo"] / words, stats["n_top"] / words,
               stats["n_upper"] / letters, stats["n_digits"] / chars, stats["n_closing"] / words, stats["n_bangs"] / words,
               stats["n_bars"] / words, stats["n_short"] / words, stats["n_long"] / words, stats["n_ending"] / words,
               np.log1p(words / lines), np.log1p(stats["n_words"])]
    return np.stack(columns, axis=1).astype(np.float64).reshape(-1, len(RATIOS))
