"""Structured Streaming entry points.

The reference is batch-only (no watermarks, windows over event time, state
or late data), so no streaming operator is added.  What a Spark user does
need is to run the existing batch checks on synthetic rows that arrive
incrementally; ``foreach_batch_checks`` applies the constraint check (C2)
to every micro-batch and appends the counts to a table.
"""

from tabvet.streaming.checks import foreach_batch_checks  # noqa: F401
