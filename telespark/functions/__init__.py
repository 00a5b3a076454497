"""Column-level helpers: R-style null semantics, time arithmetic, scalars."""

from telespark.functions.nulls import (any_true, count_if, exact_seconds_sum, in_set, mean_narm,
                                       strict_mean, strict_sum)
from telespark.functions.scalars import (concat_label, euclid_distance, if_else,
                                         make_point, n_clip, null_to_zero, t_color)
from telespark.functions.time import (add_seconds, cast_integer, cast_integer_num, cast_numeric,
                                      duration_seconds, format_time, parse_timestamp,
                                      trunc_unit, unit_chunk)

__all__ = [
    "any_true", "count_if", "exact_seconds_sum", "in_set", "mean_narm", "strict_mean", "strict_sum",
    "concat_label", "euclid_distance", "if_else", "make_point", "n_clip",
    "null_to_zero", "t_color", "add_seconds", "cast_integer", "cast_numeric",
    "cast_integer_num", "duration_seconds", "format_time", "parse_timestamp", "trunc_unit", "unit_chunk",
]
