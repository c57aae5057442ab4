"""Counts of words, symbols, repeated lines and repeated word windows of whole texts."""

from __future__ import annotations

import numpy as np

from propkit.llm import _text as T

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def keyed(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hash of an item together with its text."""
    return T.mix(h ^ T.mix(own.astype(np.uint64) + _GOLD))


def count_in(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flagged bytes of each text."""
    acc = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    first = np.concatenate(([0], ends[:-1] + 1))
    return acc[ends] - acc[first]


def repeated_windows(h: np.ndarray, own: np.ndarray, bounds: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each text inside windows of ``width`` words that the text holds twice or more."""
    covered = np.zeros(len(h), bool)
    if len(h) >= width:
        m = len(h) - width + 1
        g = h[:m].copy()
        for i in range(1, width):
            g = g * _GOLD + h[i: m + i]
        at = np.flatnonzero(own[:m] == own[width - 1:])
        k = keyed(g[at], own[at])
        order = np.argsort(k)
        same = k[order][1:] == k[order][:-1]
        twice = np.zeros(len(k), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(width):
            covered[at[twice] + i] = True
    return T.per_text(covered, bounds)


def lines(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and how many of them equal an earlier one."""
    stop = np.flatnonzero(buf == 10)
    first = np.concatenate(([0], stop[:-1] + 1))
    filled = np.searchsorted(starts, stop) > np.searchsorted(starts, first)
    first, stop = first[filled], stop[filled]
    own = np.searchsorted(ends, stop)
    n = np.bincount(own, minlength=len(ends))
    k = keyed(T.span_hash(buf, first, stop), own)
    _, at = np.unique(k, return_index=True)
    return n, n - np.bincount(own[at], minlength=len(ends))


def signals(buf: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: the counts of the rules, and the word hashes with their texts for further use."""
    s, e, bounds = T.words(buf, ends)
    h, own = T.span_hash(buf, s, e), T.owner(bounds)
    char = (buf & 0xC0) != 0x80
    n_lines, dup = lines(buf, ends, s)
    return {"n_words": np.diff(bounds), "word_chars": count_in(char & ~T.SPACE[buf], ends),
            "n_symbols": count_in(_SYMBOL[buf], ends), "n_dup_lines": dup, "n_lines": n_lines,
            "n_repeat_words": repeated_windows(h, own, bounds), "hash": h, "own": own, "bounds": bounds, "starts": s, "stops": e}
