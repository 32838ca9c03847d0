from lakeward.functions.scalars import (  # noqa: F401
    contains_ci,
    ms_to_seconds,
    outcome_flag,
    runtime_rule,
    year_bounds,
    year_partition,
)
from lakeward.functions.keyed import first_per_key, last_per_key, null_safe_join  # noqa: F401
