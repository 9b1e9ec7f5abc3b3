"""Scalar expressions of the audit, as plain column functions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The clamp of probabilities, the offset of standard deviations, the offset of geometric means.
EPS, EPS_META = 1e-16, 1e-10
#: Closeness of a probability to zero, and tolerances of row equality.
NEAR_ZERO, ATOL, RTOL = 1e-8, 1e-8, 1e-5


def logit(p: Column) -> Column:
    """ln(p / (1 - p)) with p held in [EPS, 1 - EPS]; null stays null."""
    held = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return F.when(p.isNotNull(), F.log(held / (1 - held)))


def class_prob(probs: Column, y: Column) -> Column:
    """The probability of class position y, null outside the array."""
    return F.get(probs, y.cast("int"))


def hinge(probs: Column, y: Column) -> Column:
    """logit of the true class less the largest logit of the others; null with fewer than two classes."""
    # the logit grows with the probability, so the largest logit is that of the largest probability
    others = logit(F.array_max(F.filter(probs, lambda p, i: i != y.cast("int"))))
    return F.when(F.size(probs) >= 2, logit(class_prob(probs, y)) - others)


def loss(probs: Column, y: Column) -> Column:
    return 1 - class_prob(probs, y)


def argmax(values: Column) -> Column:
    """The first position of the largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sorted_probs(probs: Column, correct: Column | None = None) -> Column:
    """Probabilities from the largest down; the flag of a correct prediction goes last."""
    down = F.sort_array(probs, asc=False)
    return down if correct is None else F.concat(down, F.array(correct.cast("double")))


def margin_columns(margin: Column) -> tuple[Column, Column]:
    """Non-member and member score of a margin, without squashing."""
    return -margin, margin


def safe_div(x: Column, y: Column, default: float = 0.0) -> Column:
    """x / y to 8 digits, or the default."""
    return F.when(y != 0, F.bround(x / F.when(y != 0, y), 8)).otherwise(F.lit(float(default)))


def ratio(x: Column, y: Column) -> Column:
    """x / y to 8 digits, null if y is 0."""
    return F.bround(x / F.when(y != 0, y), 8)


def near_zero(probs: Column) -> Column:
    return F.exists(probs, lambda p: F.abs(p) <= NEAR_ZERO)


def row_close(a: Column, b: Column, atol: float = ATOL, rtol: float = RTOL) -> Column:
    """Equal lengths and |a - b| <= atol + rtol |b| everywhere."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))), lambda t: t)


def clip01(score: Column) -> Column:
    """Score held in [0, 1]; NaN becomes 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def unique_max(values: Column, threshold: float = 0.0) -> Column:
    """The largest value reaches the threshold and occurs once."""
    top = F.array_max(values)
    return (top >= threshold) & (F.size(F.filter(values, lambda v: v == top)) == 1)


def linspace(low: Column, high: Column, n: int = 100) -> Column:
    """n equally spaced points, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, high).otherwise(low + i * (high - low) / F.lit(float(n - 1))))


def one_hot(position: Column, size: int) -> Column:
    """An array of zeros with a one at the position (from 0)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == position, 1.0).otherwise(0.0))


def is_categorical(encoding: Column) -> Column:
    """Encodings of the feature dictionary that count as categorical."""
    return F.substring(encoding, 1, 3).isin("str", "int") | (F.substring(encoding, 1, 6) == "onehot")


def finite_or_null(c: Column) -> Column:
    """Null for NaN and infinities, as the JSON of a report has it."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def softmax(values: Column) -> Column:
    """Probabilities of an array of scores; maximum and total are bound once, not sought again for every element."""
    bound = lambda value, then: F.transform(F.array(value), then)[0]
    total = lambda shifted: F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    shifted = bound(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return bound(shifted, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t)))
