"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import ragged

#: Alphabets up to this are sorted by induction again; a larger one means names that are nearly all different, which rank doubling settles in a few rounds.
RECURSE_ALPHABET = 1 << 11


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (non-negative integers) in order; a suffix that ends is smaller than one that goes on."""
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    return _sort(np.r_[text.astype(np.int64) + 1, 0])[1:]


def _sort(text: np.ndarray) -> np.ndarray:
    """For a text whose last symbol 0 occurs nowhere else."""
    n, sigma = len(text), int(text.max()) + 1
    if n < 3:
        return np.argsort(text, kind="stable")
    small = text.astype(np.uint8 if sigma <= 256 else np.uint16 if sigma <= 65536 else np.int64)
    # a suffix is of type S if it is smaller than the next one: equal symbols take the type that follows their run
    last = np.flatnonzero(np.r_[text[:-1] != text[1:], True])
    rises = np.r_[text[last[:-1]] < text[last[:-1] + 1], True]
    is_s = np.repeat(rises, np.diff(np.r_[-1, last]))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    count = np.bincount(text, minlength=sigma)
    ends = np.cumsum(count)
    by_symbol = lms[np.argsort(small[lms], kind="stable")]
    found = _induce(small, is_s, by_symbol, ends - count, ends)
    found = found[is_lms[found]]  # leftmost-smaller substrings in order
    names, order = _names(text, lms, found)
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), dtype=np.int64)
        reduced[order] = names
        found = lms[_sort(reduced) if names[-1] < RECURSE_ALPHABET else _double(reduced)]
    return _induce(small, is_s, found, ends - count, ends)


def _names(text: np.ndarray, lms: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the sorted leftmost-smaller substrings, equal ones sharing theirs; and their places in the text's order."""
    place = np.zeros(len(text), dtype=np.int64)
    place[lms] = np.arange(len(lms))
    order = place[found]
    length = np.r_[np.diff(lms), 0][order] + 1
    same = length[1:] == length[:-1]
    at = np.flatnonzero(same)
    if len(at):
        size = length[at]
        equal = text[ragged(found[at], size)] == text[ragged(found[at + 1], size)]
        same[at] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return np.r_[0, np.cumsum(~same)], order


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones: first type L from the left, then type S from the right.

    A bucket is worked off in waves: what a wave puts into its own bucket is the next wave.
    """
    sa = np.full(len(text), -1, dtype=np.int64)
    sigma = len(starts)
    head, tail = starts.copy(), ends.copy()
    lms_end = np.cumsum(np.bincount(text[lms], minlength=sigma))
    lms_start = np.r_[0, lms_end[:-1]]

    def place(found: np.ndarray, want_s: bool) -> None:
        p = found[found > 0] - 1
        p = p[is_s[p] == want_s]
        if not len(p):
            return
        symbol = text[p]
        order = np.argsort(symbol, kind="stable")
        p, symbol = p[order], symbol[order]
        count = np.bincount(symbol, minlength=sigma)
        rank = np.arange(len(p)) - (np.cumsum(count) - count)[symbol]
        if want_s:
            sa[tail[symbol] - 1 - rank] = p
            np.subtract(tail, count, out=tail)
        else:
            sa[head[symbol] + rank] = p
            np.add(head, count, out=head)

    used = np.flatnonzero(ends > starts).tolist()
    for c in used:
        done = starts[c]
        while head[c] > done:
            wave = sa[done : head[c]]
            done = int(head[c])
            place(wave, False)
        if lms_end[c] > lms_start[c]:
            place(lms[lms_start[c] : lms_end[c]], False)
    head_end = head.copy()
    for c in reversed(used):
        done = ends[c]
        while tail[c] < done:
            wave = sa[tail[c] : done][::-1]
            done = int(tail[c])
            place(wave, True)
        if head_end[c] > starts[c]:
            place(sa[starts[c] : head_end[c]][::-1], True)
    sa[0] = len(text) - 1
    return sa


def _double(text: np.ndarray) -> np.ndarray:
    """Suffix order by doubling the length that ranks look at."""
    rank, step = text, 1
    while True:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key)
        key = key[order]
        new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        if new[-1] + 1 == len(new):
            return order
        rank = np.empty(len(new), dtype=np.int64)
        rank[order] = new
        step *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, how much its suffix shares with the one before it in ``sa``.

    Where the symbols before both are equal, the value is one less than the position's left neighbour's; only the
    other positions are compared, all at once and symbol runs of eight at a time.
    """
    n = len(sa)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = text
    bits = 64 // max(1, int(text.max(initial=0)).bit_length())
    words = None
    if bits >= 8:  # eight symbols in one word
        words = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            words |= padded[k : n + k] << np.uint64(8 * k) if int(text.max(initial=0)) < 256 else np.uint64(0)
        if int(text.max(initial=0)) > 255:
            words = None
    reducible = np.zeros(n, dtype=bool)
    at = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    reducible[at] = text[at - 1] == text[before[at] - 1]
    start = np.flatnonzero(~reducible & (before >= 0))
    a, b, own = start.copy(), before[start], np.zeros(len(start), dtype=np.int64)
    live = np.arange(len(start))
    step = 8 if words is not None else 1
    while len(live):
        limit = n - np.maximum(a[live], b[live])
        if step == 8:
            inside = limit >= 8
            x, y = a[live], b[live]
            equal = inside & (words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)])
        else:
            inside = limit > 0
            equal = inside.copy()
            equal[inside] = text[a[live[inside]]] == text[b[live[inside]]]
        own[live[equal]] += step
        a[live[equal]] += step
        b[live[equal]] += step
        if step == 8:
            rest = live[~equal]
            for _ in range(8):  # the word in which they part
                ok = np.maximum(a[rest], b[rest]) < n
                rest = rest[ok]
                rest = rest[text[a[rest]] == text[b[rest]]]
                own[rest] += 1
                a[rest] += 1
                b[rest] += 1
        live = live[equal]
    out = np.zeros(n, dtype=np.int64)
    known = np.full(n, -1, dtype=np.int64)
    known[start] = start
    known[before < 0] = np.flatnonzero(before < 0)
    known = np.maximum.accumulate(known)
    value = np.zeros(n, dtype=np.int64)
    value[start] = own
    valid = known >= 0
    out[valid] = np.maximum(value[known[valid]] - (np.flatnonzero(valid) - known[valid]), 0)
    out[before < 0] = 0
    return out
