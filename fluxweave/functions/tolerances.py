"""Numerical tolerances and enumerations of the remap stages."""

from __future__ import annotations

import sys
from dataclasses import dataclass

EPS = sys.float_info.epsilon

LIMITERS = ("nolimiter", "barth_jespersen")
BOUNDARY_LIMITERS = ("bnd_nolimiter", "bnd_zero_gradient", "bnd_barth_jespersen")
PARTIAL_FIXUPS = ("constant", "locally_conservative", "globally_conservative")
EMPTY_FIXUPS = ("leave_empty", "extrapolate", "fill")
#: Older names that job files still use.
ALIASES = {"shifted_conservative": "globally_conservative"}


def one_of(value: str, allowed: tuple[str, ...]) -> str:
    value = ALIASES.get(value.lower(), value.lower())
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


@dataclass(frozen=True)
class Tolerances:
    """Fixed default values: overlap, distance, conservation and iteration limits."""

    min_intersection_volume: float = -1e-14
    min_absolute_volume: float = EPS
    conservation: float = 100 * EPS
    volume_difference: float = 100 * EPS
    max_fixup_iterations: int = 5

    @staticmethod
    def min_absolute_distance(dim: int) -> float:
        return dim**0.5 * EPS
