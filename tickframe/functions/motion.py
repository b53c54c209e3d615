"""Small dynamics: clamped moves, kinetics and fixed-step integration inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def move_toward(position: Column, target: Column, speed, low=None, high=None) -> Column:
    """A step of at most ``speed`` to the target, kept within [low, high]."""
    gap = target - position
    moved = position + F.signum(gap) * F.least(F.abs(gap), F.lit(speed))
    if low is not None:
        moved = F.greatest(F.lit(low), moved)
    return moved if high is None else F.least(F.lit(high), moved)


def hill_repression(x: Column, vmax: float, k: float, n: float) -> Column:
    return F.lit(vmax) / (1 + F.pow(x / k, F.lit(n)))


def exponential_draw(rate: Column, seed: int) -> Column:
    """A seeded waiting time with this rate."""
    return -F.ln(1 - F.rand(seed)) / rate


def integrate(initial: Column, rate: Callable[[Column, Column], Column], end: float, steps: int) -> Column:
    """dx/dt = rate(x, t) from 0 to ``end`` by classical Runge-Kutta steps, as one fold per row."""
    h = end / steps

    def step(x, i):
        t = (i - 1) * h

        def let(value, body):
            return F.element_at(F.transform(F.array(value), body), 1)

        return let(rate(x, t), lambda a: let(rate(x + a * (h / 2), t + h / 2), lambda b: let(rate(x + b * (h / 2), t + h / 2), lambda c: x + (a + b * 2 + c * 2 + rate(x + c * h, t + h)) * (h / 6))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), initial.cast("double"), step)
