"""Expressions on an array of class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import VIRAL_NAMES
from .dna import _col, let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(x: Column) -> Column:
    """Stable on both sides: the exponent is never positive."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def log_sum_exp(scores: Column) -> Column:
    return let(
        F.array_max(scores),
        lambda top: top + F.ln(total(F.transform(scores, lambda x: F.exp(x - top)))),
    )


def log_softmax(scores: Column) -> Column:
    return let(log_sum_exp(scores), lambda norm: F.transform(scores, lambda x: x - norm))


def softmax(scores: Column) -> Column:
    weights = let(
        F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top))
    )
    return let(
        weights, lambda w: let(total(w), lambda norm: F.transform(w, lambda x: x / norm))
    )


def binary_entropy(p: Column) -> Column:
    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))

    a, b = clip(p), clip(1.0 - p)
    return -(a * F.log2(a) + b * F.log2(b))


def softmax_entropy(p: Column) -> Column:
    """Entropy in bits of values clipped to [1e-12, 1]; the values are taken as given."""
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))
    return -total(F.transform(clipped, lambda x: x * F.log2(x)))


def present_entropy(p: Column) -> Column:
    """Entropy in bits over the elements above 1e-10."""
    return -total(F.transform(p, lambda x: F.when(x > 1e-10, x * F.log2(x)).otherwise(0.0)))


def soft_plus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def energy(scores: Column) -> Column:
    """Two classes: -logsumexp. One logit or more than two: mean of -log(1 + e^x)."""
    return F.when(F.size(scores) == 2, -log_sum_exp(scores)).otherwise(
        -total(F.transform(scores, soft_plus)) / F.size(scores)
    )


def zscore(values: Column) -> Column:
    def scaled(centred: Column) -> Column:
        return let(
            F.sqrt(dot(centred, centred) / F.size(values)),
            lambda s: F.transform(
                centred, lambda x: F.coalesce(F.try_divide(x, s), F.lit(0.0))
            ),
        )

    centred = let(
        total(values) / F.size(values), lambda mean: F.transform(values, lambda x: x - mean)
    )
    return let(centred, scaled)


def zscore_with(values: Column, mean: Column, spread: Column) -> Column:
    """Scaled by stored per-element means and deviations."""
    centred = F.zip_with(values, mean, lambda x, m: x - m)
    return F.zip_with(centred, spread, lambda x, s: F.coalesce(F.try_divide(x, s), F.lit(0.0)))


def l2_normalize(values: Column) -> Column:
    return let(
        F.sqrt(dot(values, values)),
        lambda norm: F.transform(
            values, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))
        ),
    )


def top_index(scores: Column) -> Column:
    """0-based position of the largest score, the first on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def without(scores: Column, index: Column) -> Column:
    return let(
        index,
        lambda at: F.transform(
            scores, lambda x, i: F.when(i == at, F.lit(None).cast("double")).otherwise(x)
        ),
    )


def second_index(scores: Column) -> Column:
    return let(without(scores, top_index(scores)), top_index)


def names_of(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def top2(scores: Column | str, classes: list[str]) -> dict[str, Column]:
    """The decision features of a score array; ties go to the lower index."""
    scores = _col(scores)
    names = names_of(classes)
    rest = without(scores, top_index(scores))
    top, second = F.array_max(scores), F.array_max(rest)
    p = softmax(scores)
    return {
        "top_score": top,
        "second_score": second,
        "margin": top - second,
        "top_prob": F.array_max(p),
        "entropy": -total(F.transform(p, lambda x: x * F.ln(x + 1e-12))),
        "top_class": F.get(names, top_index(scores)),
        "second_class": F.get(names, second_index(scores)),
    }


def window_letter(label: Column, viral: tuple[str, ...] = VIRAL_NAMES) -> Column:
    """First letter of a class name: upper case for viral classes, lower case otherwise."""
    first = F.substring(label, 1, 1)
    return F.when(F.lower(label).isin(*viral), F.upper(first)).otherwise(F.lower(first))


def ood_signals(scores: Column | str, which: list[str], nmd: Column | None = None) -> dict:
    """Out-of-distribution signals of a score array, by name."""
    scores = _col(scores)
    p = softmax(scores)
    known = {
        "max_prob": F.array_max(p),
        "entropy": -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(1e-10))))),
        "energy": log_sum_exp(scores),
        "margin": F.array_max(p) - F.array_max(without(p, top_index(p))),
    }
    if nmd is not None:
        known["nmd_norm"] = F.sqrt(dot(nmd, nmd))
    unknown = [w for w in which if w not in known]
    if unknown:
        raise ValueError(f"unknown signals: {unknown}")
    return {w: known[w] for w in which}


def logistic_ood(values: Column, weights: list[float], bias: float, positive: bool = True):
    """Logistic score of row-scaled values; the sign of the exponent is the caller's."""
    z = dot(zscore(values), F.array(*[F.lit(float(w)) for w in weights])) + F.lit(bias)
    return sigmoid(z if positive else -z)
