"""Set-based precision, recall and F1 over array columns, in the reference's two conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prf(truth: Column, guess: Column) -> tuple[Column, Column, Column]:
    """Both empty: 1, 1, 1; exactly one empty: 0. Arrays must hold no repeats."""
    hit, t, g = F.size(F.array_intersect(truth, guess)), F.size(truth), F.size(guess)
    none = (t == 0) & (g == 0)
    p = F.when(none, 1.0).when(g == 0, 0.0).otherwise(hit / g)
    r = F.when(none, 1.0).when(t == 0, 0.0).otherwise(hit / t)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def prf_zero(truth: Column, guess: Column) -> tuple[Column, Column, Column]:
    """Empty denominators give 0, also where both sides are empty; rounded to six places."""
    tp, fp, fn = F.size(F.array_intersect(truth, guess)), F.size(F.array_except(guess, truth)), F.size(F.array_except(truth, guess))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.round(p, 6), F.round(r, 6), F.round(f, 6)


def text_of(c: Column) -> Column:
    """A set as one sorted text, for reports."""
    return F.array_join(F.array_sort(c), "|")
