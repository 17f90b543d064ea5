"""Literal matching of many secret values in texts, by rolling fingerprints and salted digests.

A dictionary is held without its values: for each value a fingerprint of its leading window, its length in bytes and a
keyed digest. Every window of a text is fingerprinted by doubling (a window of 2g bytes from two of g), looked up in a
bit table, then in the sorted fingerprints; where one is found, a digest of as many bytes as some value of that window
has decides. So the cost of a text does not grow with the number of values, and a prefix that all keys of a vendor share
costs one digest per length where it occurs. Matches are exact up to a collision of 128 keyed bits. UTF-8 keeps
characters apart, so matches of bytes are matches of characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

#: Window sizes in bytes: a value is looked for by the largest that it fills.
WINDOWS = (1, 2, 4, 8, 16, 32)
#: Bytes of text that are fingerprinted at once.
BLOCK = 1 << 20


def window_of(length: int) -> int:
    return max(w for w in WINDOWS if w <= length)


def digest(value: bytes, salt: bytes) -> bytes:
    return hashlib.blake2b(value, key=salt, digest_size=16).digest()


def _mixers(salt: bytes) -> tuple[np.ndarray, list[np.uint64]]:
    """A random number for each byte, and an odd factor for each doubling, drawn from the salt."""
    r = np.random.default_rng(int.from_bytes(salt, "big"))
    table = r.integers(0, 1 << 64, 256, dtype=np.uint64)
    return table, [np.uint64(x | 1) for x in r.integers(0, 1 << 64, len(WINDOWS), dtype=np.uint64)]


class Fingerprints:
    """Rolling fingerprints of all windows of each size."""

    def __init__(self, salt: bytes):
        self.table, self.factors = _mixers(salt)

    def windows(self, raw: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each size asked for, ascending: the fingerprint of the window at each place where one fits."""
        now, size, k = self.table[raw], 1, 0
        while True:
            if size in sizes:
                yield size, now
            if size >= max(sizes) or len(now) <= size:
                return
            now = (now[:-size] * self.factors[k]) ^ now[size:]
            now ^= now >> np.uint64(29)
            size, k = 2 * size, k + 1

    def many(self, values: Sequence[bytes]) -> np.ndarray:
        """The fingerprint of each value's leading window."""
        out, sizes = np.zeros(len(values), np.uint64), np.array([window_of(len(v)) for v in values])
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            now, k = self.table[np.frombuffer(b"".join(values[i][:size] for i in at.tolist()), np.uint8).reshape(-1, size)], 0
            while now.shape[1] > 1:
                now = (now[:, 0::2] * self.factors[k]) ^ now[:, 1::2]
                now ^= now >> np.uint64(29)
                k += 1
            out[at] = now[:, 0]
        return out

    def one(self, value: bytes) -> int:
        """The fingerprint of a value's leading window."""
        size = window_of(len(value))
        (_, found), = (x for x in self.windows(np.frombuffer(value[:size], np.uint8), [size]))
        return int(found[0])


#: Odd factors that tell windows and lengths apart in the bit tables of a sieve.
_BY_WINDOW, _BY_LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def slots(prints: np.ndarray, windows: np.ndarray, lengths: np.ndarray | None, depth: int) -> np.ndarray:
    """Places in a table of 2^depth bits: of a leading window, or of one with the length of a whole value."""
    mixed = (prints ^ (np.atleast_1d(windows).astype(np.uint64) * _BY_LENGTH)) * _BY_WINDOW
    if lengths is not None:
        mixed = ((mixed ^ (mixed >> np.uint64(31))) + np.atleast_1d(lengths).astype(np.uint64)) * _BY_LENGTH
    return ((mixed ^ (mixed >> np.uint64(29))) * _BY_WINDOW) >> np.uint64(64 - depth)


@dataclass
class Sieve:
    """What a dictionary of any size may hold: two bit tables, and the lengths of values by window. No value passes through it."""

    salt: bytes
    depth: int
    first: np.ndarray
    second: np.ndarray
    lengths: dict[int, list[int]]

    def _in(self, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def candidates(self, raw: bytes, ends: Sequence[int]) -> set[tuple[int, bytes]]:
        """(length, digest) of every string in several texts that may be a value: all values that occur, and few others."""
        out: set[tuple[int, bytes]] = set()
        whole, sizes, stops, prints = np.frombuffer(raw, np.uint8), sorted(self.lengths), np.array(ends), Fingerprints(self.salt)
        if not sizes:
            return out
        for low in range(0, len(raw), BLOCK):
            part = whole[low : low + BLOCK + max(sizes) - 1]
            for size, found in prints.windows(part, sizes):
                found = found[:BLOCK]
                maybe = np.flatnonzero(self._in(self.first, slots(found, np.uint64(size), None, self.depth)))
                if not len(maybe):
                    continue
                until = stops[np.searchsorted(stops, maybe + low, side="right")]
                for length in self.lengths[size]:
                    fits = maybe[maybe + low + length <= until]
                    hit = self._in(self.second, slots(found[fits], np.uint64(size), np.uint64(length), self.depth))
                    places = (fits[hit] + low).tolist()
                    out.update((length, digest(v, self.salt)) for v in {raw[p : p + length] for p in places})
        return out


@dataclass
class _Class:
    """Values of one window size."""

    prints: np.ndarray
    bits: np.ndarray
    shift: np.uint64
    lengths: dict[int, list[int]]


@dataclass
class Index:
    """A dictionary as tasks hold it. ``entries``: (fingerprint, length in bytes, digest, name), in order of replacement."""

    salt: bytes
    entries: list[tuple[int, int, bytes, str]]
    classes: dict[int, _Class] = field(init=False)
    by_digest: dict[tuple[int, bytes], list[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.prints = Fingerprints(self.salt)
        self.by_digest = {}
        grouped: dict[int, dict[int, set[int]]] = {}
        for i, (fingerprint, length, keyed, _) in enumerate(self.entries):
            self.by_digest.setdefault((length, keyed), []).append(i)
            grouped.setdefault(window_of(length), {}).setdefault(fingerprint, set()).add(length)
        self.classes = {}
        for size, lengths in sorted(grouped.items()):
            prints = np.array(sorted(lengths), np.uint64)
            depth = min(26, max(12, (64 * len(prints) - 1).bit_length()))
            shift = np.uint64(64 - depth)
            bits = np.zeros(1 << depth, bool)
            bits[prints >> shift] = True
            self.classes[size] = _Class(prints, bits, shift, {f: sorted(v) for f, v in lengths.items()})

    def matches(self, raw: bytes, ends: Sequence[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(place, length, entry) of every occurrence, overlapping ones too, in no order. With ``ends``, ``raw`` is
        several texts and these are the places where they end: no match crosses one."""
        if not self.classes or not raw:
            return
        whole, sizes = np.frombuffer(raw, np.uint8), list(self.classes)
        stops = np.array([len(raw)] if ends is None else ends)
        for low in range(0, len(raw), BLOCK):
            part = whole[low : low + BLOCK + max(sizes) - 1]
            for size, found in self.prints.windows(part, sizes):
                c = self.classes[size]
                found = found[:BLOCK]
                maybe = np.flatnonzero(c.bits[found >> c.shift])
                if not len(maybe):
                    continue
                prints = found[maybe]
                at = np.searchsorted(c.prints, prints)
                hit = c.prints[np.minimum(at, len(c.prints) - 1)] == prints
                places = maybe[hit] + low
                until = stops[np.searchsorted(stops, places, side="right")]
                for place, stop, fingerprint in zip(places.tolist(), until.tolist(), prints[hit].tolist()):
                    for length in c.lengths[fingerprint]:
                        if place + length <= stop:
                            for i in self.by_digest.get((length, digest(raw[place : place + length], self.salt)), ()):
                                yield place, length, i

    def counts(self, raw: bytes, ends: Sequence[int]) -> list[dict[str, int]]:
        """For each of several texts: non-overlapping occurrences by name."""
        found: list[dict[int, list[tuple[int, int]]]] = [{} for _ in ends]
        stops = np.array(ends)
        for place, length, i in self.matches(raw, ends):
            text = int(np.searchsorted(stops, place, side="right"))
            found[text].setdefault(i, []).append((place, length))
        out: list[dict[str, int]] = []
        for by_entry in found:
            names: dict[str, int] = {}
            for i, spans in by_entry.items():
                n, free = 0, 0
                for place, length in sorted(spans):
                    if place >= free:
                        n, free = n + 1, place + length
                name = self.entries[i][3]
                names[name] = names.get(name, 0) + n
            out.append(names)
        return out

    def redacted(self, raw: bytes, seen: Callable[[bytes], None] | None = None) -> bytes:
        """Each value in turn replaced by its marker, as if one after the other over the whole text; only values that
        occur are looked at. A replacement is followed by a new search, since later values may match inside a marker.
        ``seen`` gets the text as it is before each search."""
        done = -1
        while True:
            if seen is not None:
                seen(raw)
            due = min(((i, raw[place : place + length]) for place, length, i in self.matches(raw) if i > done), default=None)
            if due is None:
                return raw
            done, value = due
            raw = raw.replace(value, f"***REDACTED({self.entries[done][3]})***".encode())
