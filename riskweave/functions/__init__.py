from .amounts import parse_amount, parse_time, pick_amount, first_filled
from .scalar import (
    clip,
    contains_url,
    duration_us,
    finite_or_zero,
    nan_to_null,
    safe_div,
    shannon_entropy,
)

__all__ = [
    "clip",
    "contains_url",
    "duration_us",
    "finite_or_zero",
    "first_filled",
    "nan_to_null",
    "parse_amount",
    "parse_time",
    "pick_amount",
    "safe_div",
    "shannon_entropy",
]
