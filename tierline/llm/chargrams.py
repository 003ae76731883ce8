"""Hashed character n-grams of whole texts, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PIECE = 1 << 20
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x165667B1, 0x27D4EB2F))


def grams(text: str, orders: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Buckets (a power of two) of all n-grams of the given orders, repeats
    included.  A long text comes in pieces that overlap by one order less."""
    reach = max(orders) - 1
    for at in range(0, max(1, len(text)), _PIECE):
        lead = min(reach, at)
        c = np.frombuffer(text[at - lead:at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        out = []
        for n in orders:
            skip = max(0, lead - n + 1)
            m = len(c) - skip - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
            for k in range(n):
                h += c[skip + k:skip + k + m]
                h *= _FACTORS[k]
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(buckets - 1))
        if out:
            yield np.concatenate(out)
