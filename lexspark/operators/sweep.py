"""Sweeps over settings: trials in order, at most so many, ended by the first that meets its target."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice


def sweep(grid: Iterable[tuple], score: Callable[[tuple], float], target: float | None = None, max_trials: int | None = None) -> list[tuple[tuple, float, bool]]:
    """[(setting, score, target met)] of the trials that ran. A trial is one distributed job; only scores come back."""
    done = []
    for setting in islice(grid, max_trials):
        s = score(setting)
        met = target is not None and s >= target
        done.append((setting, s, met))
        if met:
            break
    return done


def exit_code(trials: list[tuple[tuple, float, bool]], strict: bool = True) -> int:
    """2 where the target had to be met and was not, else 0."""
    return 2 if strict and not any(met for *_, met in trials) else 0
