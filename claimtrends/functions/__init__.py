from .scalar import (
    calendar_quarter_end,
    digits_padded,
    flag,
    next_quarter_start,
    quarter_index,
    quarter_start,
    ratio,
    ratio_or_zero,
    round_to,
    to_number,
    to_whole,
)

__all__ = [
    "calendar_quarter_end", "digits_padded", "flag", "next_quarter_start", "quarter_index",
    "quarter_start", "ratio", "ratio_or_zero", "round_to", "to_number", "to_whole",
]
