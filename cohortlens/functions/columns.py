"""Column expressions shared by the operators; all of them stay JVM-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000


def json_scalar(col: Column, path: str, dtype: str = "string", strict: bool = False) -> Column:
    """Scalar at a JSON path: NULL for objects, arrays, JSON null and broken text.

    Text that fails the cast to ``dtype`` gives NULL, or an error if ``strict``.
    """
    text = F.get_json_object(col, path)
    # get_json_object returns the text of objects and arrays; only text that
    # looks like one is parsed a second time to tell it from a plain string
    node = F.try_variant_get(F.try_parse_json(col), path, "variant")
    nested = F.schema_of_variant(node).rlike("^(OBJECT|ARRAY)")
    scalar = F.when(
        text.startswith("{") | text.startswith("["), F.when(~nested, text)
    ).otherwise(text)
    if dtype == "string":
        return scalar
    return scalar.cast(dtype) if strict else scalar.try_cast(dtype)


def day_diff(later: Column, earlier: Column) -> Column:
    """Whole 24-hour intervals between two TIMESTAMPs, truncated towards zero.

    23 hours before gives 0 and 25 hours before gives -1, in every time zone.
    """
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.call_function("div", micros, F.lit(MICROS_PER_DAY))


def in_window(days: Column, lo: int, hi: int) -> Column:
    """Entity-relative window predicate, both ends included."""
    return days.between(lo, hi)


def ratio(numerator: Column, denominator: Column, fallback: Column | float = 0.0) -> Column:
    """``numerator / denominator`` where the denominator is positive, else the fallback."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(denominator > 0, numerator / denominator).otherwise(other.cast("double"))


def finite_or_zero(col: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    value = col.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def percent(part: Column, whole: Column, digits: int | None = None, half_even: bool = False) -> Column:
    """100 * part / whole, NULL for an empty whole, optionally rounded."""
    value = part * F.lit(100.0) / F.nullif(whole, F.lit(0))
    if digits is None:
        return value
    return (F.bround if half_even else F.round)(value, digits)


# Activity levels of the published report, right-closed.
ACTIVITY_BOUNDS = (0, 10, 50, 100, 500, float("inf"))
ACTIVITY_LABELS = (
    "Very Low (1-10)",
    "Low (11-50)",
    "Medium (51-100)",
    "High (101-500)",
    "Very High (500+)",
)


def activity_level(
    col: Column,
    bounds: Sequence[float] = ACTIVITY_BOUNDS,
    labels: Sequence[str] = ACTIVITY_LABELS,
) -> Column:
    """Label of the right-closed interval ``(bounds[i], bounds[i+1]]``, NULL outside."""
    if len(bounds) != len(labels) + 1:
        raise ValueError("one label per interval")
    level = F.when(col <= bounds[0], F.lit(None).cast("string"))
    for upper, label in zip(bounds[1:], labels):
        level = level.when(col <= upper, F.lit(label))
    return level


def map_values(col: Column, mapping: Mapping) -> Column:
    """Value lookup in a literal mapping, NULL for unknown values."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), col)
