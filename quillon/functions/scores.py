"""Arithmetic of learnability, policy losses and budgets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def learnability(p: Column) -> Column:
    """M1: 4p(1-p); a rate outside 0 to 1 or NaN fails the query."""
    bad = F.isnan(p) | (p < 0) | (p > 1)
    return F.when(F.assert_true(~bad, "a pass rate must lie in 0 to 1").isNull(), 4 * p * (1 - p))


def progress_signal(slow: Column, fast: Column, stagnant: Column, patience: int = 3, scale: float = 0.25) -> Column:
    """M2."""
    signal = learnability(fast) * F.greatest(F.lit(0.0), fast - slow)
    return F.when(stagnant >= patience, signal * scale).otherwise(signal)


def min_max(c: Column, over=None) -> Column:
    """M3: scaled to 0..1 over the window; 0.5 for all where they hardly differ."""
    w = over or W.partitionBy()
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(c.isNull(), None).when(high - low < 1e-12, 0.5).otherwise((c - low) / (high - low))


def sample_weight(value: Column, blend: float = 0.5, least: float = 0.5, most: float = 2.0, over=None) -> Column:
    """M5: value is the mean of a prompt's observed categories, null where none is; 1 for all until one is above 0."""
    w = over or W.partitionBy()
    known = F.max(value).over(w)
    inside = F.greatest(F.lit(least), F.least(F.lit(most), (1 - blend) + blend * min_max(value, w)))
    return F.when(F.coalesce(known, F.lit(0.0)) <= 1e-12, 1.0).when(value.isNull(), 1.0).otherwise(inside)


def clip_higher(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.28) -> Column:
    """M6."""
    clipped = F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    return -F.least(ratio * advantage, clipped * advantage)


def soft_overlong(n: Column, most: int, buffer: int) -> Column:
    """M7: 0 up to most - buffer tokens, then down to -1 at most."""
    start = max(0, most - max(0, buffer))
    return F.when(n <= start, 0.0).otherwise(-F.least((n - start) / max(buffer, 1), F.lit(1.0)))


def idf_score(n_docs: Column, df: Column, term: Column, known: Column) -> Column:
    """M8."""
    return F.log((n_docs + 1) / (df + 1)) + 0.15 * F.length(term) + F.when(known, 2.0).otherwise(0.0)


def interpolated_budget(p: Column, easy: int = 128, medium: int = 256, hard: int = 512, step: int = 32) -> Column:
    """Linear between the anchors at 0, 0.5 and 1, rounded up to a multiple of step, within the anchors."""
    if not 0 < easy <= medium <= hard or step <= 0:
        raise ValueError("anchors must be positive and ascend, the step positive")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    raw = F.when(p <= 0.5, easy + (medium - easy) * p * 2).otherwise(medium + (hard - medium) * (p - 0.5) * 2)
    return F.greatest(F.lit(easy), F.least(F.lit(hard), (F.ceil(raw / step) * step).cast("int")))


def band(p: Column) -> Column:
    """X6."""
    return F.when(p < 1 / 3, "easy").when(p < 2 / 3, "medium").otherwise("hard")


def structural_score(n_constraints: Column, n_turns: Column, n_categories: Column) -> Column:
    """X4."""
    one_less = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(1)) - 1)
    return F.coalesce(n_constraints, F.lit(0)) + one_less(n_turns) + one_less(n_categories)


def difficulty(n_constraints: Column, n_turns: Column, n_categories: Column, first_pass: Column, attempts: Column) -> Column:
    """X3."""
    score = structural_score(n_constraints, n_turns, n_categories) + F.when(~first_pass, 1).otherwise(0) + F.least(F.coalesce(attempts, F.lit(0)), F.lit(2))
    return F.when(score <= 2, "easy").when(score <= 4, "medium").otherwise("hard")
