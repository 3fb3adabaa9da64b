from cohortlens.functions.columns import (
    activity_level,
    day_diff,
    finite_or_zero,
    in_window,
    json_scalar,
    map_values,
    percent,
    ratio,
)

__all__ = [
    "activity_level",
    "day_diff",
    "finite_or_zero",
    "in_window",
    "json_scalar",
    "map_values",
    "percent",
    "ratio",
]
