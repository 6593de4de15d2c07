"""Popular search queries, ranked by distinct sources over a hopping time window, on Spark."""

from hopboard.params import BoardParams, parse_top_limit

__all__ = ["BoardParams", "parse_top_limit"]
