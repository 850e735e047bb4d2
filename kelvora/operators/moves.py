"""Move sets: which cells are one step away, how far, and which cells a long step passes over."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

CLASSIC = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c)
LEVELS = {8: 0, 16: 1, 32: 2, 64: 3, 128: 4}


@dataclass(frozen=True)
class Move:
    k: int
    dr: int
    dc: int
    dist: float
    #: For a long move: (step, row and column offset of the sample's upper left cell, row and column share), without the last step.
    samples: tuple[tuple[int, int, int, float, float], ...] = ()
    sweep: tuple[tuple[int, int], ...] = field(default=())

    @property
    def steps(self) -> int:
        return 2 * max(abs(self.dr), abs(self.dc)) if self.is_long else 1

    @property
    def is_long(self) -> bool:
        return max(abs(self.dr), abs(self.dc)) > 1


def directions(n_dirs: int) -> list[tuple[int, int]]:
    """4, 8, 16, 32, 64 or 128 directions: mediants refine the octant between (1, 0) and (1, 1), and symmetry gives the rest."""
    if n_dirs == 4:
        return [(-1, 0), (0, -1), (0, 1), (1, 0)]
    if n_dirs not in LEVELS:
        raise ValueError(f"n_dirs must be 4 or one of {sorted(LEVELS)}")
    octant = [(1, 0), (1, 1)]
    for _ in range(LEVELS[n_dirs]):
        between = [(a + c, b + d) for (a, b), (c, d) in zip(octant, octant[1:], strict=False)]
        octant = [x for pair in zip(octant, between, strict=False) for x in pair] + octant[-1:]
    out = dict.fromkeys(CLASSIC)
    for a, b in octant:
        out |= dict.fromkeys((r * x, c * y) for x, y in ((a, b), (b, a)) for r in (1, -1) for c in (1, -1))
    return list(out)


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def build_moves(n_dirs: int = 8, dx: float = 30.0, dy: float = 30.0) -> list[Move]:
    out = []
    for k, (dr, dc) in enumerate(directions(n_dirs)):
        dist = dx * abs(dc) if dr == 0 else dy * abs(dr) if dc == 0 else math.hypot(dr * dy, dc * dx)
        n = 2 * max(abs(dr), abs(dc))
        if n == 2:
            out.append(Move(k, dr, dc, dist))
            continue
        at = [(dr * s / n, dc * s / n) for s in range(1, n)]
        samples = tuple((s, math.floor(r), math.floor(c), r - math.floor(r), c - math.floor(c)) for s, (r, c) in enumerate(at, 1))
        near = dict.fromkeys((_half_up(r), _half_up(c)) for r, c in at)
        out.append(Move(k, dr, dc, dist, samples, tuple(x for x in near if x not in ((0, 0), (dr, dc)))))
    return out
