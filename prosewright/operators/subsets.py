"""Choosing parts by size: the subset of a multiset of sizes whose total is closest to a target."""

from __future__ import annotations

import math


def closest_counts(sizes: dict[int, int], targets: list[float], max_bits: int = 1 << 26) -> list[dict[int, int]]:
    """For each target in turn, how many components of each size to take, so that their total is closest to it.

    sizes: size -> how many components have it. Subset sums are bits of one integer; multiplicities are entered in
    binary pieces. Pieces are measured in units of more than 1 only where all sizes together exceed max_bits; what rounding
    then leaves is made up from sizes that fit. Of the bitsets on the way, one in about the square root of the pieces is
    kept, and those between are made again on the way back.
    """
    left = {s: n for s, n in sizes.items() if s > 0 and n > 0}
    unit = max(1, -(-sum(s * n for s, n in left.items()) // max_bits))
    out = []
    for target in targets:
        goal = max(0, round(target / unit))
        pieces: list[tuple[int, int]] = []
        for s, n in sorted(left.items(), reverse=True):
            k = 1
            while n > 0:
                take = min(k, n)
                pieces.append((s, take))
                n -= take
                k *= 2
        limit = (1 << (2 * goal + 2)) - 1
        reach, kept, step = 1, [], math.isqrt(len(pieces)) + 1
        for i, (s, k) in enumerate(pieces):
            if i % step == 0:
                kept.append(reach)
            reach = (reach | (reach << round(s * k / unit))) & limit
        below = reach & ((1 << (goal + 1)) - 1)
        low = below.bit_length() - 1
        above = reach >> (goal + 1)
        at = low
        if above and low >= 0:
            high = goal + 1 + ((above & -above).bit_length() - 1)
            at = high if high - goal < goal - low else low
        taken: dict[int, int] = {}
        while kept:
            trail, block = [kept.pop()], pieces[step * len(kept) : step * (len(kept) + 1)]
            for s, k in block[:-1]:
                trail.append((trail[-1] | (trail[-1] << round(s * k / unit))) & limit)
            for (s, k), before in zip(reversed(block), reversed(trail)):
                if at >= 0 and (before >> at) & 1:
                    continue
                taken[s] = taken.get(s, 0) + k
                at -= round(s * k / unit)
        for s, k in taken.items():
            left[s] -= k
        if unit > 1:
            off = round(target) - sum(s * k for s, k in taken.items())
            for s in sorted(left, reverse=True):
                k = min(left[s], off // s) if off > 0 else -min(taken.get(s, 0), -off // s)
                if k:
                    taken[s], left[s], off = taken.get(s, 0) + k, left[s] - k, off - s * k
        out.append(taken)
    return out
