"""Reusable building blocks: expressions, ordered scans, as-of joins, ranks and quantiles."""
