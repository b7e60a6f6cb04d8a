"""Words of many texts at once: places, hashes and remembered token ids, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together.
PART = 1 << 19
#: Words that a task remembers, and places where it finds most of them without a dictionary.
REMEMBERED, PLACES = 250_000, 1 << 19


def parts(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``PART`` characters."""
    held, length = [], 0
    for text in texts:
        held.append(text)
        length += len(text)
        if length >= PART:
            yield held
            held, length = [], 0
    if held:
        yield held


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, where its words start and end, and how many words the texts up to each have, from 0.

    Words are runs of anything but the ASCII space and U+0009 to U+000D.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    white = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, starts, ends, np.append(0, np.searchsorted(starts, upto))


def _powers(n: int, of: int) -> np.ndarray:
    """``of`` to the power 0, 1, ... modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    done, factor = 1, of
    while done < n:
        out[done:2 * done] = out[:min(done, n - done)] * np.uint64(factor)
        done, factor = 2 * done, factor * factor % (1 << 64)
    return out


class Hasher:
    """64-bit hashes of words in a buffer: sums of drawn numbers of their bytes times powers of an odd number."""

    FACTOR = 0x9E3779B97F4A7C15
    BYTES = np.random.default_rng(64).integers(1, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # so many bytes at a time, whole words
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PART, side="right")))
            low, n = int(starts[at]), int(ends[stop - 1] - starts[at])
            if n > len(self.up):
                self.up, self.down = _powers(max(n, PART), self.FACTOR), _powers(max(n, PART), pow(self.FACTOR, -1, 1 << 64))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.BYTES[data[low:low + n]] * self.up[:n], out=sums[1:])
            s, e = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = (sums[e] - sums[s]) * self.down[s]
            at = stop
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


class Growing:
    """An array that grows by doubling."""

    def __init__(self, dtype: type):
        self.room, self.values = np.zeros(1024, dtype), np.zeros(0, dtype)

    def add(self, more: np.ndarray) -> None:
        n = len(self.values)
        if n + len(more) > len(self.room):
            self.room = np.resize(self.room, 2 * (n + len(more)))
        self.room[n:n + len(more)] = more
        self.values = self.room[:n + len(more)]


class Lexicon:
    """Words by number: their hashes and token ids, for as many words as a task remembers.

    Subclasses say how words are spelled: ``_spell`` gives the ids of new words one after the other, and how many each has.
    """

    def __init__(self, limit: int = REMEMBERED):
        self.hasher, self.limit, self.forgotten = Hasher(), limit, -1
        self.forget()

    def forget(self) -> None:
        self.forgotten += 1
        self.number: dict[int, int] = {}
        self._hashes, self._starts, self._sizes, self._ids = Growing(np.int64), Growing(np.int64), Growing(np.int64), Growing(np.uint32)
        # the word last seen at each place, found without the dictionary
        self.place_hash, self.place_number = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int32)

    @property
    def hashes(self) -> np.ndarray:
        return self._hashes.values

    def full(self) -> bool:
        return len(self.number) > self.limit

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the words at these places of a buffer."""
        hashes = self.hasher(data, starts, ends)
        places = (hashes >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
        numbers = self.place_number[places].astype(np.int64)
        missed = np.flatnonzero(self.place_hash[places] != hashes)
        if len(missed):
            different, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            found = np.array([self.number.get(h, -1) for h in different.tolist()], np.int64)
            new = np.flatnonzero(found < 0)
            for at in range(0, len(new), 4096):
                some = new[at:at + 4096]
                words = [data[starts[i]:ends[i]].tobytes() for i in missed[first[some]].tolist()]
                # white space beyond ASCII might go with the space between words
                alone = np.array([not w.isascii() and any(map(str.isspace, w.decode("utf-8", "replace"))) for w in words], bool)
                for group in [np.flatnonzero(~alone), *np.flatnonzero(alone)[:, None]]:
                    if len(group):
                        ids, sizes = self._spell([words[j] for j in group.tolist()])
                        found[some[group]] = self._add(different[some[group]], ids, sizes)
            numbers[missed] = found[back]
            at = places[missed[first]]
            self.place_hash[at], self.place_number[at] = different, found
        return numbers

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        numbers = np.arange(len(self.number), len(self.number) + len(hashes))
        self.number.update(zip(hashes.tolist(), numbers.tolist()))
        self._hashes.add(hashes.view(np.int64))
        self._starts.add(len(self._ids.values) + np.cumsum(sizes) - sizes)
        self._sizes.add(sizes)
        self._ids.add(ids)
        return numbers

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        sizes = self._sizes.values[numbers]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self._starts.values[numbers] - before, sizes) + np.arange(int(sizes.sum()))
        return self._ids.values[at], sizes
