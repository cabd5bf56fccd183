"""Codes of words and of windows of words, for many texts at once: 64 bits, and a second code of their own to check them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from . import common

_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
common.REMEMBERED.append(_POWERS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, np.uint64(pow(int(base), -1, 2**64)), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[int(base)] = have
    return have


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the slice stands."""
    up, down = _powers(base, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


@dataclass
class Coded:
    """counts: words in each text; starts, ends: byte places of words in their own text; codes, checks: halves of their 128-bit hashes."""

    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    checks: np.ndarray


def spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and the byte past the last of each word."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[text]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def code_words(texts: list[bytes], piece: int = 1 << 20) -> Coded:
    """Codes all words, a piece of about `piece` bytes at a time; a word is never cut."""
    counts, starts, ends, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
    at = 0
    while at < len(texts):
        last, held = at, 0
        while last < len(texts) and (last == at or held + len(texts[last]) < piece):
            held += len(texts[last]) + 1
            last += 1
        raw = b"\n".join(texts[at:last]) + b"\n"
        offsets = np.zeros(last - at + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts[at:last]], out=offsets[1:])
        first, past = spans(np.frombuffer(raw, np.uint8))
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(past, first[i] + 2 * piece)))
            hashes = b"".join(map(xxhash.xxh3_128_digest, raw[first[i] : past[j - 1]].split()))
            codes.append(np.frombuffer(hashes, np.uint64).reshape(-1, 2))
            i = j
        owner = np.searchsorted(first, offsets)
        counts.append(np.diff(owner))
        shift = np.repeat(offsets[:-1], counts[-1])
        starts.append(first - shift)
        ends.append(past - shift)
        at = last
    both = np.concatenate(codes)
    return Coded(np.concatenate(counts), np.concatenate(starts), np.concatenate(ends), both[:, 0].copy(), both[:, 1].copy())


def windows(counts: np.ndarray, codes: np.ndarray, width: int, step: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of `width` words within one text: the place of its first word, its text's number, its code (of the step-th kind)."""
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(codes))
    places = places[places + width <= bounds[owner + 1]]
    out = np.empty(len(places), np.uint64)
    for a in range(0, len(places), 1 << 18):
        some = places[a : a + (1 << 18)]
        low = int(some[0])
        out[a : a + len(some)] = mix(sums(codes[low : int(some[-1]) + width], some - low, some - low + width, _STEPS[step]))
    return places, owner[places], out


def sort_codes(codes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (code, check), and which of the ordered begin a run of equals."""
    order = np.argsort(codes, kind="stable")
    for _ in range(2):
        a, b = codes[order], checks[order]
        same = a[1:] == a[:-1]
        equal = same & (b[1:] == b[:-1])
        if np.array_equal(same, equal):
            break
        order = np.lexsort((checks, codes))  # different windows of one code
    return order, np.concatenate([[True], ~equal]) if len(codes) else np.zeros(0, bool)
