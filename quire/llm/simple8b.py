"""Simple-8b: ids packed into 64-bit words, a 4-bit selector and up to 60 ids of equal width in each.

Selector 0 is the escape: its word holds the position of an id wider than 60 bits in
the block's escape table. The last word of a block is padded with zeros.
"""

from __future__ import annotations

import numpy as np

# Ids per word and their width in bits, by selector (0 is the escape).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_LIMITS = (np.uint64(1) << WIDTHS[1:].astype(np.uint64)) - np.uint64(1)
_FIRST = (np.searchsorted(_LIMITS, np.arange(1 << 16).astype(np.uint64)) + 1).astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned ids, greedily: each word takes as many ids as any selector allows."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64, copy=False)
    wide = ids > _LIMITS[-1]
    escapes = ids[wide]
    # the first selector wide enough for each id; past the last for an escape
    narrow = _FIRST[ids.astype(np.int64)] if int(ids.max()) < len(_FIRST) else (np.searchsorted(_LIMITS, ids) + 1).astype(np.int8)
    pick = np.where(wide, 0, len(COUNTS) - 1).astype(np.int8)
    at = np.arange(n)
    for s in range(len(COUNTS) - 2, int(narrow.min()) - 1, -1):
        fits = np.concatenate([narrow <= s, np.ones(64, bool)])
        have, want = 1, int(COUNTS[s])
        while have < want:  # fits[i]: the next ``have`` ids from i on are narrow enough
            step = min(have, want - have)
            fits[:-step] &= fits[step:]
            have += step
        fits = fits[:n]
        if not fits.any():
            break  # a larger count of narrower ids cannot fit either
        pick[fits] = s
    following = (at + COUNTS[pick]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = following[i]
    starts = np.array(starts)
    chosen = pick[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(64, np.uint64)])
    escape_at = np.cumsum(wide) - 1
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            words[mine] |= escape_at[starts[mine]].astype(np.uint64)
            continue
        for k in range(COUNTS[s]):
            words[mine] |= padded[starts[mine] + k] << np.uint64(k * WIDTHS[s])
    return words, escapes


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block, all words of a selector at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        data = words[mine]
        if s == 0:
            out[starts[mine]] = escapes[(data & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[starts[mine] + k] = (data >> np.uint64(k * WIDTHS[s])) & mask
    return out[:n]
