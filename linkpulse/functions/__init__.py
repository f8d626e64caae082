"""Column expressions shared by the operators."""

from .numbers import mean_dp, plain_number, round_dp, row_count
from .text import canon_router_id, is_blank, strip
from .times import at_or_after, iso_text, parse_time, time_literal

__all__ = [
    "at_or_after",
    "canon_router_id",
    "is_blank",
    "iso_text",
    "mean_dp",
    "parse_time",
    "plain_number",
    "round_dp",
    "row_count",
    "strip",
    "time_literal",
]
