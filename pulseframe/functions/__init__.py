"""Column expressions (JVM-side, whole-stage-codegen friendly)."""

from pulseframe.functions.casting import to_number, to_timestamp_or_null, iso_text, cast_activity  # noqa: F401
from pulseframe.functions.text import normalize_query, query_shape, QUERY_FLAG_PATTERNS  # noqa: F401
from pulseframe.functions.sizes import parse_size_mb, format_bytes  # noqa: F401
from pulseframe.functions.metrics import metric_ratios, wait_flags, time_features  # noqa: F401
from pulseframe.functions.labels import anomaly_labels, LABEL_RULES  # noqa: F401
