"""Minimal perfect hashing of 64-bit key hashes, by levels of collision-free bits.

On each level every key still without a place hashes to one bit; the bits that exactly one key hit are kept, the other
keys go on to the next level. A key's number is the rank of its bit among all kept bits, so n keys get the numbers
0 to n - 1. About 1.5 levels are read on average; nothing of the keys themselves is stored, so callers store a
fingerprint (or the key) under each number to tell strangers apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

GAMMA = 2.0
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits, another for each seed."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((seed + 1) * int(_MULT) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class MinimalPerfectHash:
    n: int = 0
    sizes: list[int] = field(default_factory=list)
    ranks: list[np.ndarray] = field(default_factory=list)  #: for each bit of a level the key's number, or -1

    @classmethod
    def build(cls, hashes: np.ndarray) -> MinimalPerfectHash:
        """hashes: distinct unsigned 64-bit integers; raises ValueError if two are equal."""
        left = np.asarray(hashes, np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("two keys have the same 64-bit hash")
        out = cls(len(left))
        given = 0
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = (mix(left, len(out.sizes)) % np.uint64(size)).astype(np.int64)
            kept = np.bincount(at, minlength=size) == 1
            rank = np.where(kept, np.cumsum(kept) - 1 + given, -1).astype(np.int64 if given + len(left) > 2**31 - 1 else np.int32)
            out.sizes.append(size)
            out.ranks.append(rank)
            given += int(kept.sum())
            left = left[~kept[at]]
        return out

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for what wasn't a key."""
        hashes = np.asarray(hashes, np.uint64)
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, (size, rank) in enumerate(zip(self.sizes, self.ranks)):
            if not len(todo):
                break
            found = rank[(mix(hashes[todo], level) % np.uint64(size)).astype(np.int64)]
            out[todo] = found
            todo = todo[found < 0]
        return out

    def to_arrays(self) -> dict[str, np.ndarray]:
        return {"n": np.array([self.n], np.int64), "sizes": np.array(self.sizes, np.int64), "ranks": np.concatenate(self.ranks) if self.ranks else np.zeros(0, np.int32)}

    @classmethod
    def from_arrays(cls, arrays) -> MinimalPerfectHash:
        sizes = [int(s) for s in arrays["sizes"]]
        cuts = np.cumsum([0, *sizes])
        return cls(int(arrays["n"][0]), sizes, [arrays["ranks"][a:b] for a, b in zip(cuts, cuts[1:])])
