"""Vectorised work on UTF-8 bytes of many texts at once: words, exact statistics, hashed n-grams."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: An odd factor, so that it has an inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Bytes that are hashed at once.
BLOCK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR^i and its inverse^i modulo 2^64, for i below n or more."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (FACTOR, INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: each output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without ASCII white space, within a text) and the index of its text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text's first byte
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    ws, we = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return ws, we, np.searchsorted(offsets, ws, "right") - 1


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """64-bit hashes of words: equal words have equal hashes. Work is done a block at a time, so long texts and words need little memory."""
    p, q = powers(block + 1)
    out, n, at = np.zeros(len(ws), np.uint64), we - ws, 0
    while at < len(ws):
        base = ws[at]
        to = int(np.searchsorted(we, base + block, "right"))
        if to > at:
            c = np.zeros(we[to - 1] - base + 1, np.uint64)
            np.cumsum((data[base : we[to - 1]].astype(np.uint64) + np.uint64(1)) * p[: len(c) - 1], out=c[1:])
            out[at:to] = (c[we[at:to] - base] - c[ws[at:to] - base]) * q[ws[at:to] - base]
            at = to
            continue
        lead = np.uint64(1)  # a word longer than a block, part by part
        for i in range(base, we[at], block):
            part = data[i : min(i + block, we[at])].astype(np.uint64) + np.uint64(1)
            out[at] += lead * (part * p[: len(part)]).sum(dtype=np.uint64)
            lead *= p[block]
        at += 1
    return mixed(out + n.astype(np.uint64))


def run_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of words by the words' hashes: of the words first to end - 1. A run of any length costs the same."""
    p, q = powers(len(h) + 1)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=c[1:])
    return mixed((c[end] - c[first]) * q[first] + (end - first).astype(np.uint64))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words; the run at i is that of the words i to i + k - 1. Fewer than k words have none."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(FACTOR) + h[j : len(h) - k + 1 + j]
    return mixed(out)


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return np.diff(c[offsets])


def repeat_words(words: list[bytes], k: int) -> int:
    """Words that lie in a window of k words that the text has twice or more, the first time included."""
    if len(words) < k:
        return 0
    ids: dict[bytes, int] = {}
    w = [ids.setdefault(x, len(ids)) for x in words]
    runs = list(zip(*(w[j:] for j in range(k)), strict=False))
    often = Counter(runs)
    n, upto = 0, 0
    for i, r in enumerate(runs):
        if often[r] > 1:
            n += i + k - max(upto, i)
            upto = i + k
    return n


def statistics(data: np.ndarray, offsets: np.ndarray, symbols: bytes = b"#*$%&|<>", k: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    ws, we, at = find_words(data, offsets)
    sym = np.zeros(256, bool)
    sym[list(symbols)] = True
    out = {"n_words": np.bincount(at, minlength=n).astype(np.int64)}
    out["word_chars"] = per_text(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = per_text(sym[data], offsets)
    out["n_dup_lines"], out["n_repeat_words"] = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.flatnonzero(per_text(data == 10, offsets)):
        lines = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if len(ws) >= k:
        # equal windows have equal hashes, so texts without equal hashes have none; the others are counted on their words
        s = shingle_hashes(word_hashes(data, ws, we), k)
        own = at[: len(s)] == at[k - 1 :]
        s, of = s[own], at[: len(own)][own]
        key = s ^ mixed(of.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        for i in np.unique(of[order][1:][same]):
            out["n_repeat_words"][i] = repeat_words(data[offsets[i] : offsets[i + 1]].tobytes().split(), k)
    return out


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes, given where each begins."""
    p = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    a = p[lead]
    out = a.copy()
    for n, low in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
        m = np.flatnonzero((a >= low) & (a < (0xE0, 0xF0, 0xF8)[n - 2]))
        if len(m):
            x = a[m] & (0x7F >> n)
            for j in range(1, n):
                x = x << 6 | (p[lead[m] + j] & 0x3F)
            out[m] = x
    return np.minimum(out, 0x10FFFF)


def gram_buckets(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of n characters that lie within a text, and the index of their text's first run in them.

    Runs across texts are left out by their position, so text i has lengths[i] - n + 1 runs or none.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) < n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    cp, offsets = code_points(data, lead), np.searchsorted(lead, offsets)
    h = np.zeros(len(cp) - n + 1, np.uint32)
    for j in range(n):
        h *= np.uint32(0x01000193)
        h += cp[j : len(cp) - n + 1 + j]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - bits)
    sizes = np.maximum(np.diff(offsets) - n + 1, 0)
    keep = np.ones(len(h), bool)
    for j in range(1, n):
        cut = offsets[1:-1] - j
        keep[cut[(cut >= 0) & (cut < len(h))]] = False
    return h[keep].astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
