"""Elias-Fano sequences over arrays of 64-bit words, queried in bulk, as they lie in a mapped file.

An ascending sequence of n values is cut at bit ``low``: the low bits are packed, the high parts are one bit string in unary
(for h = 0, 1, ...: a one for each value with high part h, then a zero). The place of a zero tells how many values come before a
high part, so ``bucket`` is a select of zeros: samples hold the place of every 64th zero, from where a few words are counted through;
where a long run of ones lies between, a directory of the zeros before each block of 256 bits is searched instead. String, samples
and directory take low + 2.75 bits a value at most (``build`` chooses ``low`` so that there are no more than n + 1 zeros).
"""

from __future__ import annotations

import numpy as np

#: 64-bit words of a directory block, zeros from sample to sample, words that are counted through before the directory is asked.
BLOCK, SAMPLE, STEPS = 4, 64, 4
U, ONES, TOPS = np.uint64, np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the r-th one of a byte, at 8 * byte + r.
NTH = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[r] for x in range(256) for r in range(8)], np.uint8)


def nth_one(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one (from 0) in each word; there must be one."""
    s = x - (x >> U(1) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + (s >> U(2) & U(0x3333333333333333))
    s = (s + (s >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * ONES  # ones up to and with each byte
    r = r.astype(U)
    byte = U(8) - np.bitwise_count((s | TOPS) - (r + U(1)) * ONES & TOPS).astype(U)
    shift = byte * U(8)
    r -= np.where(byte > 0, s >> (shift - U(8) & U(63)) & U(255), U(0))
    return (shift + NTH[(x >> shift & U(255)) * U(8) + r]).astype(np.int64)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, in 64-bit words (one to spare)."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 1, U)
    if width and n:
        part, at = values.astype(U) & U((1 << width) - 1), np.arange(n, dtype=U) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(part << shift, first)
        over = np.flatnonzero(shift + U(width) > U(64))  # at most one value a word runs over its end
        out[word[over] + 1] |= part[over] >> (U(64) - shift[over])
    return out


def _words(values: np.ndarray) -> np.ndarray:
    """32-bit numbers in whole 64-bit words."""
    return np.concatenate([values, np.zeros(len(values) % 2, np.int64)]).astype("<u4").view("<u8")


class EliasFano:
    """Ascending values below 2**64. ``low`` given: the number of low bits, so that a high part is a bucket of its own."""

    @staticmethod
    def build(values: np.ndarray, low: int | None = None, buckets: int | None = None) -> np.ndarray:
        n = len(values)
        top = int(values[-1]) if n else 0
        if low is None:
            low = max(0, (top // n).bit_length()) if n else 0
        zeros = buckets if buckets is not None else (top >> low) + 1
        bits = np.zeros(-(-(n + zeros) // (64 * BLOCK)) * 64 * BLOCK + 64 * BLOCK, np.uint8)
        bits[(values >> U(low)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        own = 64 * BLOCK - np.bitwise_count(high.reshape(-1, BLOCK)).sum(axis=1, dtype=np.int64)
        before, samples = _words(np.cumsum(own) - own), _words(np.flatnonzero(bits[: n + zeros] == 0)[::SAMPLE])
        lows = packed(values, low)
        return np.concatenate([np.array([n, low, zeros, len(high), len(before), len(samples), len(lows)], "<u8"), high, before, samples, lows])

    def __init__(self, words: np.ndarray):
        self.n, self.low, self.zeros, *sizes = (int(x) for x in words[:7])
        a, b, c, self.size = (7 + sum(sizes[: k + 1]) for k in range(4))
        self.high, self.lows = words[7:a], words[c : self.size]
        self.before, self.samples = words[a:b].view("<u4")[: sizes[0] // BLOCK], words[b:c].view("<u4")

    @property
    def bits(self) -> int:
        """Bits of the whole structure."""
        return 64 * self.size

    def zero(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th zeros."""
        at, left = self.samples[i // SAMPLE].astype(np.int64), i % SAMPLE
        word = at >> 6
        x = ~self.high[word] & (~U(0) << (at & 63).astype(U))
        n = np.bitwise_count(x)
        on = np.flatnonzero(n <= left)
        for _ in range(STEPS):
            if not on.size:
                break
            left[on] -= n[on]
            word[on] += 1
            x[on] = ~self.high[word[on]]
            n[on] = np.bitwise_count(x[on])
            on = on[n[on] <= left[on]]
        if on.size:
            block = np.searchsorted(self.before, i[on].astype(np.uint32), side="right") - 1
            left[on], word[on] = i[on] - self.before[block], block * BLOCK
            while on.size:
                x[on] = ~self.high[word[on]]
                n[on] = np.bitwise_count(x[on])
                on = on[n[on] <= left[on]]
                left[on] -= n[on]
                word[on] += 1
        return word * 64 + nth_one(x, left)

    def bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place, and the place after the last one, of the values with high part h (below ``zeros``)."""
        start = np.full(len(h), -1, np.int64)  # place of the zero before the bucket
        some = np.flatnonzero(h > 0)
        start[some] = self.zero(h[some] - 1)
        word = start + 1 >> 6
        rest = ~self.high[word] >> (start + 1 & 63).astype(U)
        end = start + 1 + np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)  # the bucket goes on in the next word
        end[far] = self.zero(h[far])
        return start + 1 - h, end - h

    def rest(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the i-th values."""
        if not self.low:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.low)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        out = self.lows[word] >> shift
        over = np.flatnonzero(shift + U(self.low) > U(64))
        out[over] |= self.lows[word[over] + 1] << (U(64) - shift[over])
        return out & U((1 << self.low) - 1)

    def within(self, lo: np.ndarray, hi: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places from lo to hi, which must lie in one bucket, the first whose low bits are not below ``rest``, and if equal."""
        some = np.flatnonzero(lo < hi)
        place, found = lo.copy(), np.zeros(len(lo), bool)
        lo, hi, rest = lo[some], hi[some], rest[some]
        on = np.flatnonzero(hi - lo > 1)
        while on.size:  # the last one that is not above
            mid = (lo[on] + hi[on]) >> 1
            above = self.rest(mid) > rest[on]
            lo[on] = np.where(above, lo[on], mid)
            hi[on] = np.where(above, mid, hi[on])
            on = on[hi[on] - lo[on] > 1]
        there = self.rest(lo)
        place[some], found[some] = lo + (there < rest), there == rest
        return place, found

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first value not below each, and whether it is equal."""
        place, found = np.full(len(values), self.n, np.int64), np.zeros(len(values), bool)
        high = values >> U(self.low)
        some = np.flatnonzero(high < U(self.zeros))
        if some.size and self.n:
            lo, hi = self.bucket(high[some].astype(np.int64))
            place[some], found[some] = self.within(lo, hi, values[some] & U((1 << self.low) - 1))
        return place, found
