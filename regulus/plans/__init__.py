"""Reusable physical patterns: tiled scans, value-ordered tables, binned joins, greedy walks."""
