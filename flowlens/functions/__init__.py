"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from flowlens.functions.numeric import (  # noqa: F401
    coerce_double, fill_zero, inf_to_null_expr, is_infinite, is_missing, round6,
)
from flowlens.functions.labels import is_benign, normalize_label  # noqa: F401
from flowlens.functions.levels import intensity_level, threat_level  # noqa: F401
from flowlens.functions.digest import draw_rank, order_digest  # noqa: F401
from flowlens.functions.timefn import epoch_ms  # noqa: F401
