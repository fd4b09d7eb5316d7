"""Scores as column expressions. Times are epoch milliseconds and `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
K1, B = 1.2, 0.75
HEAT_TAU = DECAY_TAU = 7 * DAY
SUPERSEDED_PENALTY, SEMANTIC_WEIGHT, FUZZY_WEIGHT, GRAPH_WEIGHT, INFER_WEIGHT, VECTOR_WEIGHT = 0.5, 0.3, 0.5, 0.35, 0.25, 0.30
COVERAGE, PRESCREEN, SAMPLE, RRF_K = 0.45, 0.30, 16, 60
#: Weight of each kind, and of an explicit source.
KIND_WEIGHT, EXPLICIT = {"instruction": 1.25, "preference": 1.15, "decision": 1.05, "fact": 1.0, "generic": 0.95}, 1.1


def idf(n: Column, df: Column) -> Column:
    total = F.greatest(F.lit(1), n)
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def tf_saturation(tf: Column, length: Column, mean_length: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def decay(updated_at: Column, now: int, tau: float = DECAY_TAU) -> Column:
    """exp(-age / tau): an e-folding time, not a half-life; 1 for the future."""
    age = F.lit(now) - updated_at
    return F.when(age <= 0, F.lit(1.0)).otherwise(F.exp(-age / tau))


def heat(access_count: Column, last_access_at: Column, now: int | None = None, tau: float = HEAT_TAU) -> Column:
    warm = F.log1p(access_count) * 0.1
    if now is not None:
        warm = F.when(last_access_at.isNull(), warm).otherwise(warm * F.exp(-F.greatest(F.lit(0), F.lit(now) - last_access_at) / tau))
    return F.when(access_count <= 0, F.lit(1.0)).otherwise(1 + warm)


def significance(kind: Column, source: Column) -> Column:
    base = F.lit(1.0)
    for k, w in KIND_WEIGHT.items():
        base = F.when(kind == k, F.lit(w)).otherwise(base)
    return base * F.when(source == "explicit", EXPLICIT).otherwise(1.0)


def strength(access_count: Column) -> Column:
    """min(4, 1 + sum over i = 1..n of 0.5 * 0.5 ^ (ceil(i / 3) - 1)), in closed form."""
    full = F.floor(access_count / 3)
    return F.least(F.lit(4.0), 1 + 3 * (1 - F.pow(F.lit(0.5), full)) + 0.5 * (access_count % 3) * F.pow(F.lit(0.5), full))


def last_touch() -> Column:
    return F.greatest(F.coalesce("last_access_at", F.lit(0)), F.col("updated_at"), F.col("created_at"))


def retrievability(now: int) -> Column:
    s = strength(F.col("access_count"))
    return s * F.exp(-(F.greatest(F.lit(0), F.lit(now) - last_touch())) / (HEAT_TAU * s))


def currentness(updated_at: Column, now: int, tau: float = 90 * DAY) -> Column:
    return F.exp(-F.greatest(F.lit(0), F.lit(now) - updated_at) / tau)
