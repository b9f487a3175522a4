"""Skew-safe building blocks: group statistics, exact quantiles, distributed numbering."""
