"""Column-expression building blocks (no Python UDFs)."""
from logcase.functions.display import args_preview, confidence_band, confidence_pct, msg_short
from logcase.functions.jsonvals import first_truthy, first_truthy_text, strict_object, truthy, vtext, vtype
from logcase.functions.redact import SECRET_PATTERNS, redact, redaction_audit
from logcase.functions.timestamps import (ISO_TS, epoch_ms_to_ts, parse_iso_ts, to_utc_datetime,
                                         to_utc_timestamp_literal)

__all__ = [
    "SECRET_PATTERNS", "ISO_TS", "redact", "redaction_audit", "parse_iso_ts", "epoch_ms_to_ts",
    "to_utc_timestamp_literal", "to_utc_datetime", "strict_object", "truthy", "vtext", "vtype", "first_truthy",
    "first_truthy_text", "msg_short", "confidence_band", "confidence_pct", "args_preview",
]
