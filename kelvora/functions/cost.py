"""The cost model: physics folded into six coefficients, and the directed cost of an edge as a Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.81


@dataclass(frozen=True)
class Cost:
    """kJ per metre and per metre climbed; see ``derive``."""

    a_roll: float
    a_aero: float
    beta: float
    climb_thr: float
    ab_ratio: float
    eps_offset: float = 0.13


def flat_speed(power: float, mass: float, crr: float, cda: float, rho: float, keff: float) -> float:
    """The speed on the flat that the power holds: the root of (crr m g + rho CdA v^2 / 2) v = keff P in [0, 40], bisected."""
    low, high = 0.0, 40.0
    for _ in range(60):
        v = (low + high) / 2
        if (crr * mass * GRAVITY + 0.5 * rho * cda * v * v) * v < keff * power:
            low = v
        else:
            high = v
    return (low + high) / 2


def derive(mass: float = 75.0, crr: float = 0.008, cda: float = 0.45, rho: float = 1.1, keff: float = 0.97, p_flat: float = 80.0, climb_thr_pct: float = 2.0, k_smooth: float = 1.0) -> Cost:
    """Physics to coefficients, with every parameter held in its range. k_smooth scales climbing only."""
    mass, crr, cda, rho = max(1.0, mass), max(0.0, crr), max(0.0, cda), max(0.0, rho)
    keff, p_flat = min(1.0, max(0.1, keff)), max(1.0, p_flat)
    v = flat_speed(p_flat, mass, crr, cda, rho, keff)
    weight, drag = mass * GRAVITY, 0.5 * rho * cda * v * v
    return Cost(
        a_roll=weight * crr / keff / 1000,
        a_aero=drag / keff / 1000,
        beta=weight * min(1.0, max(0.0, k_smooth)) / keff / 1000,
        climb_thr=max(0.0, climb_thr_pct) / 100,
        ab_ratio=crr + drag / weight,
    )


def recovery(dist: Column, drop: Column, cost: Cost) -> Column:
    """The share of a drop's energy that isn't braked away."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(cost.ab_ratio) * dist / drop) - F.lit(cost.eps_offset))


def edge_cost(dist: Column, dh: Column, cost: Cost) -> Column:
    """kJ over dist metres with a rise of dh. Climbs above the threshold grade ride too slowly for drag."""
    up = F.lit(cost.a_roll) * dist + F.when(dh < F.lit(cost.climb_thr) * dist, F.lit(cost.a_aero) * dist).otherwise(F.lit(0.0)) + F.lit(cost.beta) * dh
    down = F.lit(cost.a_roll) * dist + F.lit(cost.a_aero) * dist - recovery(dist, -dh, cost) * F.lit(cost.beta) * (-dh)
    return F.when(dh >= 0, up).otherwise(F.greatest(F.lit(0.0), down))


def edge_cost_of(dist: float, dh: float, cost: Cost) -> float:
    """The same for numbers."""
    if dh >= 0:
        return cost.a_roll * dist + (cost.a_aero * dist if dh < cost.climb_thr * dist else 0.0) + cost.beta * dh
    eps = max(0.0, min(1.0, cost.ab_ratio * dist / -dh) - cost.eps_offset)
    return max(0.0, cost.a_roll * dist + cost.a_aero * dist - eps * cost.beta * -dh)


def max_edge_cost(cost: Cost, dx: float, dy: float, low: float, high: float) -> float:
    """A bound for unit moves on ground between low and high."""
    import math

    return ((cost.a_roll + cost.a_aero) * math.hypot(dx, dy) + cost.beta * max(high - low, 1e-6)) * 1.001


DEFAULT = derive()
