"""Column-expression helpers shared by every operator (all JVM-side)."""

from tabvet.functions.exprs import (  # noqa: F401
    as_category,
    box_muller,
    isclose,
    norm_cdf,
    probit,
    r6,
    row_key,
    safe_div,
    seeded_uniform,
    stable_value,
)
