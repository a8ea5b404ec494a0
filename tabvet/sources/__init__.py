"""Table sources and sinks (survey S1-S12)."""

from tabvet.sources.io import (  # noqa: F401
    dataset_fingerprint,
    load_table,
    preview,
    read_table,
    run_log_append,
    run_log_latest,
    run_log_list,
    run_log_recover,
    validate_table,
    write_run_record,
    write_table,
)
