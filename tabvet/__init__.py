"""tabvet: Spark-native quality checks for real versus synthetic tables.

Everything is a DataFrame operator: profiles, constraint mining, two-sample
distribution tests, dependency measures, privacy distances, splits, utility
models, sequence windows, text checks, gates and selection.  The driver only
ever holds O(columns^2) facts (kinds, correlation matrices, rule lists).
"""

from tabvet.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
