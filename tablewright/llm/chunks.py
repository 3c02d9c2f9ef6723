"""Token ids of whole texts from the ids of their distinct chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tablewright.llm.common import WordHasher, release, separators, text_blocks

# Bytes of text whose distinct chunks are encoded together.
UNIT_BYTES = 1 << 22
# Chunks whose ids a Python worker keeps from unit to unit, about 32 bytes each.
KEPT_CHUNKS = 250_000


# Unicode white space beyond ASCII, in UTF-8.
WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def white_space(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 text whether it is part of a white space character."""
    found = separators("space")[data]
    for lead in {w[0] for w in WIDE_SPACE}:
        at = np.flatnonzero(data == lead)
        for w in WIDE_SPACE:
            if w[0] == lead and len(at):
                own = at[at + len(w) <= len(data)]
                for k in range(1, len(w)):
                    own = own[data[own + k] == w[k]]
                for k in range(len(w)):
                    found[own + k] = True
    return found


class ChunkIds:
    """Ids of texts, each distinct chunk of a unit encoded once by ``encode_new``.

    A text is cut before each run of white space, which no token may cross from a character that
    is none, so the chunks' ids, one after another, are the text's. A text with the string of a
    special token is one chunk. Chunks are told apart by 64-bit hashes. ``encode_new`` gets
    chunks, and whether each begins with white space and ends otherwise, without special tokens.
    """

    def __init__(
        self,
        special: list[str],
        encode_new: Callable[[list[bytes], np.ndarray], list[np.ndarray]],
        unit: int = UNIT_BYTES,
        kept: int = KEPT_CHUNKS,
    ) -> None:
        self.special = [s.encode() for s in special]
        self.encode_new, self.unit, self.kept = encode_new, unit, kept
        self.hasher = WordHasher(fold=False)
        self._clear()

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end byte of each chunk, and whether it can stand among others."""
        white = white_space(data)
        first = white.copy()
        first[1:] &= ~white[:-1]
        raw = data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                text = np.searchsorted(bounds, at, side="right") - 1
                first[bounds[text] : bounds[text + 1]] = False
                at = raw.find(special, bounds[text + 1])
        first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        inner = white[starts] & ~white[ends - 1]
        for special in self.special:
            if special in raw:
                inner &= ends - starts < len(special)
        return starts, ends, inner

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which chunks have ids kept; when too many are, only this unit's stay."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        if len(self.keys) > self.kept:
            used = at[hit]
            own = [self.flat[a : a + n] for a, n in zip(self.place[used].tolist(), self.sizes[used].tolist(), strict=True)]
            keys = self.keys[used]
            self._clear()
            self.keep(keys, own)
        return hit

    def keep(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        place = np.cumsum(sizes) - sizes + len(self.flat)
        self.flat = np.concatenate([self.flat, *ids])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.place, self.sizes = np.concatenate([self.place, place])[order], np.concatenate([self.sizes, sizes])[order]

    def _clear(self) -> None:
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.place = self.sizes = np.zeros(0, np.int64)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of texts: the first row, all their ids, and where each text's ids begin."""
        for low, _, data, bounds in text_blocks(column, self.unit):
            parts = []
            for a, b, own, own_bounds in text_blocks(column[low : low + len(bounds) - 1]):
                starts, ends, inner = self._cuts(own, own_bounds)
                hashes = self.hasher.spans(own, starts, [ends])[0]
                parts.append((a, np.searchsorted(starts, own_bounds), hashes, starts + bounds[a], ends + bounds[a], inner))
            hashes, starts, ends, inner = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5))
            each, one, which = np.unique(hashes, return_index=True, return_inverse=True)
            new = np.flatnonzero(~self.known(each))
            raw = data.tobytes()
            chunks = [raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)]
            found = self.encode_new(chunks, inner[one[new]])
            self.keep(each[new], found)
            at = np.searchsorted(self.keys, each)
            place, sizes, flat = self.place[at], self.sizes[at], self.flat
            done = 0
            for a, text_first, own_hashes, *_ in parts:
                own = which[done : done + len(own_hashes)]
                done += len(own_hashes)
                n = sizes[own]
                ends_ = np.cumsum(n)
                take = np.repeat(place[own] - (ends_ - n), n) + np.arange(ends_[-1] if len(n) else 0)
                yield low + a, flat[take], np.concatenate([[0], ends_])[text_first]
            release()
