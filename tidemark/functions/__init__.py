"""Column expressions: log positions, segment names, payload values, text and arithmetic."""

from tidemark.functions.arithmetic import (  # noqa: F401
    fleet_sizing, retry_delay_doubling_ms, retry_delay_ms, safe_ratio, shared_buffers_mb,
)
from tidemark.functions.lines import clip_line, parse_pg_log_prefix, utf8_lossy  # noqa: F401
from tidemark.functions.lsn import (  # noqa: F401
    lsn_diff, lsn_format, lsn_from_bytes, lsn_ge, lsn_parse, lsn_to_bytes,
    pg_micros_to_ts, ts_to_pg_micros,
)
from tidemark.functions.payload import (  # noqa: F401
    coerce_pg, event_json, json_quote, json_value, row_image_json, typed_view,
)
from tidemark.functions.segments import (  # noqa: F401
    SEGMENT_BYTES, is_history, is_partial, is_segment, parse_segment_name, segment_name,
    segment_name_of,
)
