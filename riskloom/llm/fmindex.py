"""A compressed FM-index over sequences of numbers, searched for many patterns in step.

Suffixes are sorted by prefix doubling, the Burrows-Wheeler transform is kept as a wavelet matrix: one
bit vector per binary digit of the symbols, packed in 64-bit words with a running count per word, so a
symbol costs about ``log2(alphabet) * 1.5`` bits. All patterns advance by one symbol per numpy step.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` ordered by at least their first ``depth`` symbols; the order of suffixes
    that agree for longer does not change the interval of any pattern up to that length."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1])) + 1
    known = 1
    while known < depth and rank[order[-1]] < n:
        key = rank * (n + 2)
        key[:n - known] += rank[known:] if known < n else 0
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1])) + 1
        known *= 2
    return order


class Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.append(0, np.cumsum(counts)[:-1])
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index over ``texts`` with symbols 0 .. ``alphabet`` - 1; no match runs across two texts."""

    def __init__(self, texts: list[np.ndarray], alphabet: int):
        longest = max((len(t) for t in texts), default=0)
        parts = [p for t in texts for p in (t + 1, np.zeros(1, np.int64))]
        text = np.concatenate(parts) if parts else np.zeros(1, np.int64)
        self.size = len(text)
        order = suffix_order(text, longest + 1)
        transform = text[order - 1]
        self.smaller = np.append(0, np.cumsum(np.bincount(text, minlength=alphabet + 1)))
        self.levels: list[Bits] = []
        rest = transform
        for digit in reversed(range(max(1, alphabet.bit_length()))):
            bit = (rest >> digit & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        symbols = np.arange(alphabet + 1)
        self.origin = self._descend(symbols, np.zeros(alphabet + 1, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for digit, level in zip(reversed(range(len(self.levels))), self.levels):
            ones = level.ones(place)
            place = np.where(symbol >> digit & 1, level.zeros + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The intervals of symbol + pattern from those of the patterns: one backward step."""
        n = len(symbol)
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        first = self.smaller[symbol] - self.origin[symbol]
        return both[:n] + first, both[n:] + first

    def repeats(self, patterns: list[np.ndarray], window: int) -> list[list[int]]:
        """For each pattern the maximal ranges [from, to) of at least ``window`` symbols that the index
        holds twice or more, as a flat list.

        A search runs leftwards from an end. Where it stops, every window over the stopping symbol
        that reaches the end is out; a search that came far enough reports its range and the next one
        ends where a window that starts just before the range would. One that fell short looks, in
        doubling steps from the stopping symbol, for the shortest run that is not repeated, and goes on
        before its end.
        """
        found: list[list[int]] = [[] for _ in patterns]
        if not patterns:
            return found
        text = np.concatenate(patterns) + 1
        length = np.array([len(p) for p in patterns])
        base = np.cumsum(length) - length
        who = np.flatnonzero(length >= window)
        end = length[who].copy()
        at = end.copy()
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.size)
        stop = np.full(len(who), -1)  # the symbol a probe wants to reach, -1 outside probes
        known = np.zeros(len(who), np.int64)  # end of the shortest run from there known to be out
        while len(who):
            new_low, new_high = self.extend(text[base[who] + at - 1], low, high)
            fits = new_high - new_low >= 2
            at = at - fits
            low, high = np.where(fits, new_low, low), np.where(fits, new_high, high)
            probe = stop >= 0
            whole = fits & (at == 0) & ~probe
            short = ~fits & ~probe & (end - at < window)
            enough = (~fits & ~probe & (end - at >= window)) | (whole & (end - at >= window))
            for i in np.flatnonzero(enough).tolist():
                found[who[i]] += [int(at[i]), int(end[i])]
            reached = probe & fits & (at == stop)
            missed = probe & ~fits
            turn = whole | ~fits | reached
            if not turn.any():
                continue
            # where the next search ends, and what it is for
            next_end, next_stop, next_known = end.copy(), stop.copy(), known.copy()
            next_end[enough] = at[enough] - 1 + window
            next_stop[turn] = -1
            further = 2 * (end - stop)
            going = reached & (stop + further < known)
            next_end = np.where(going, stop + further, next_end)
            next_stop = np.where(going, stop, next_stop)
            next_end = np.where(reached & ~going, known - 1, next_end)
            next_end = np.where(missed, end - 1, next_end)
            start = at - 1
            probing = short & (start + 2 < end)
            next_end = np.where(probing, start + 2, next_end)
            next_stop = np.where(probing, start, next_stop)
            next_known = np.where(probing, end, next_known)
            next_end = np.where(short & ~probing, end - 1, next_end)
            over = whole | (turn & (next_stop < 0) & (next_end < window))
            end, stop, known = next_end, next_stop, next_known
            at = np.where(turn, end, at)
            low, high = np.where(turn, 0, low), np.where(turn, self.size, high)
            if over.any():
                stay = ~over
                who, end, at, low, high, stop, known = (
                    x[stay] for x in (who, end, at, low, high, stop, known))
        return found
