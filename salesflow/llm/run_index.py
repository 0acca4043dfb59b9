"""A run-length compressed Burrows-Wheeler index of a small collection of byte strings.

The transform's equal neighbours are kept as runs, with the text positions at both ends of
every run sampled. Within a run the match of each suffix with its neighbour in suffix order
is one shorter than that of the suffix starting a byte before, so match lengths are known
at the samples alone: in a repetitive collection, few places. Streaming over the text from
sample to sample then gives every suffix's matching statistics against the rest.
"""

import numpy as np

from salesflow.llm.common import mixed

SEPARATOR = b"\xff"


def _words(text: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words at every position; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(len(text), ">u8", padded, strides=(1,)).astype(np.uint64)


def _eights(text: np.ndarray) -> np.ndarray:
    """The same of 64-bit elements: a hash of the 8 from every position."""
    padded = np.concatenate([text, np.zeros(8, np.uint64)])
    total = np.zeros(len(text), np.uint64)
    for i in range(8):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + padded[i : i + len(text)])
    return total


#: Bits of a place in texts so short that a sort key of two ranks has room for the place as well.
PLACE_BITS = 21


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the rank of each, by prefix doubling over those not yet apart."""
    n = len(text)
    packed = n < 1 << PLACE_BITS
    if text.dtype != np.uint8:
        key, width, order = text, 1, np.argsort(text)  # equal ones are told apart below
        key = key.take(order)
    elif packed:
        width = 5
        key, order = _sorted((_words(text) >> np.uint64(24)).view(np.int64))
    else:
        key, width = _words(text), 8
        order = np.argsort(key)
        key = key.take(order)
    heads = _heads(key)
    # one more than the rank; zeros follow the text
    rank = np.zeros(n + 1, np.int32)
    rank[order] = _ranks(heads, np.arange(1, n + 1, dtype=np.int32))
    slots = np.flatnonzero(~_alone(heads))
    while len(slots) and width < 2 * n:
        at = order.take(slots)
        by = rank.take(at).astype(np.int64)
        by <<= PLACE_BITS if packed else 32
        by += rank.take(at + width, mode="clip")
        if packed:
            by, new = _sorted(by)
        else:
            new = np.argsort(by)
            by = by.take(new)
        at = at.take(new)
        order[slots] = at
        heads = _heads(by)
        rank[at] = _ranks(heads, (slots + 1).astype(np.int32))
        slots = slots[~_alone(heads)]
        width *= 2
    return order, rank[:n] - 1


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order and where each was; sorting both in one number takes a third of ``argsort``."""
    both = key << PLACE_BITS
    both += np.arange(len(key))
    both.sort()
    return both >> PLACE_BITS, both & ((1 << PLACE_BITS) - 1)


def _heads(key: np.ndarray) -> np.ndarray:
    """Whether a place is the first of a group of equal keys."""
    return np.concatenate([[True], key[1:] != key[:-1]])


def _ranks(heads: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The place of the first of each group."""
    return np.maximum.accumulate(np.where(heads, places, 0))


def _alone(heads: np.ndarray) -> np.ndarray:
    """Whether a place is a group of its own."""
    return heads & np.concatenate([heads[1:], [True]])


#: Steps of 8 elements that all pairs take together, before long matches are followed one by one.
STEPS = 64


def _common(words: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``."""
    n, length = len(text), np.zeros(len(a), np.int64)
    active, ended = np.arange(len(a)), []
    for _ in range(STEPS):
        if not len(active):
            break
        i, j = a[active] + length[active], b[active] + length[active]
        inside = np.maximum(i, j) + 8 <= n
        same = np.zeros(len(active), bool)
        same[inside] = words[i[inside]] == words[j[inside]]
        length[active[same]] += 8
        ended.append(active[~same])
        active = active[same]
    for k in active.tolist():
        length[k] += _follow(text, int(a[k] + length[k]), int(b[k] + length[k]))
    last = np.concatenate(ended) if ended else active
    for _ in range(8):
        i, j = a[last] + length[last], b[last] + length[last]
        equal = np.maximum(i, j) < n
        equal[equal] = text[i[equal]] == text[j[equal]]
        last = last[equal]
        length[last] += 1
    return length


def _follow(text: np.ndarray, i: int, j: int) -> int:
    """Length of the common prefix of two suffixes, compared in pieces of doubling size."""
    done, piece, most = 0, 1024, len(text) - max(i, j)
    while done < most:
        size = min(piece, most - done)
        same = text[i + done : i + done + size] == text[j + done : j + done + size]
        if not same.all():
            return done + int(same.argmin())
        done, piece = done + size, 2 * piece
    return done


class RunIndex:
    """Index of ``strings`` of bytes, or of 64-bit elements (``unit`` 8; all places and lengths
    are then in elements). An element of bytes 0xFF follows each; UTF-8 has no such byte and
    elements stay below 2^63, so no match crosses from one string to another."""

    def __init__(self, strings: list[bytes], unit: int = 1):
        self.sizes = np.array([len(s) // unit for s in strings])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        separator = SEPARATOR * unit
        text = np.frombuffer(separator.join(strings) + separator, np.uint8 if unit == 1 else np.uint64)
        n = len(text)
        order, rank = suffix_array(text)
        transform = text[order - 1]
        change = np.concatenate([[True], transform[1:] != transform[:-1], [True]])
        change[rank[0] : rank[0] + 2] = True  # nothing is before the whole text: a run of its own
        first, last = change[:-1], change[1:]
        words = _words(text) if unit == 1 else _eights(text)
        self.runs = int(first.sum())
        self.n = n
        self.before = self._sampled(order, np.flatnonzero(first), -1, words, text)
        self.behind = self._sampled(order, np.flatnonzero(last), 1, words, text)

    @staticmethod
    def _sampled(order, slots, step, words, text):
        """(text positions, match lengths) of run ends and their neighbours, by position."""
        beside = slots + step
        real = (beside >= 0) & (beside < len(order))
        length = np.zeros(len(slots), np.int64)
        length[real] = _common(words, text, order[slots[real]], order[beside[real]])
        by = np.argsort(order[slots])
        return order[slots][by], length[by]

    def _stream(self, samples) -> np.ndarray:
        positions, lengths = samples
        at = np.zeros(self.n, np.int64)
        at[positions] = np.arange(len(positions))
        at = np.maximum.accumulate(at)
        return lengths[at] - (np.arange(self.n) - positions[at])

    def matching_statistics(self) -> np.ndarray:
        """At every position, the length of the longest match that also starts elsewhere, up
        to the end of its string."""
        ends = np.repeat(self.starts + self.sizes, self.sizes + 1)
        return np.minimum(np.maximum(self._stream(self.before), self._stream(self.behind)), ends - np.arange(self.n))

    def repeated(self, least: int) -> list[np.ndarray]:
        """For every string, the positions where a match of ``least`` bytes starts."""
        long = self.matching_statistics() >= least
        return [np.flatnonzero(long[a : a + size]) for a, size in zip(self.starts, self.sizes)]
