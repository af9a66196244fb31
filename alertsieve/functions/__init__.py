"""Column-expression helpers (all Catalyst built-ins, codegen friendly)."""

from alertsieve.functions.columns import (  # noqa: F401
    available,
    clip,
    clip_nullable,
    flag,
    in_range_flag,
    in_set_flag,
    popstd,
    strip_unicode,
    word_count,
)
