"""Spark operators for sparse measurement tables: counts, groups, tests, graphs, reads and intervals."""
