"""Display helpers re-aimed from the reference's text output and viewer (Q6, V6, V7)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message cut-off per query before an ellipsis is appended.
MSG_SHORT = {"top_errors": 60, "search": 80, "around": 80, "trace": 100}


def msg_short(msg: Column, k: int) -> Column:
    """``msg[:k] + '…'`` when longer than ``k`` characters, else ``msg``."""
    return F.when(F.length(msg) > k, F.concat(F.substring(msg, 1, k), F.lit("…"))).otherwise(msg)


def confidence_band(conf: Column) -> Column:
    """'ok' from 0.8, 'warn' from 0.5, else 'err' (viewer colour band)."""
    return F.when(conf >= 0.8, "ok").when(conf >= 0.5, "warn").otherwise("err")


def confidence_pct(conf: Column) -> Column:
    return F.round(conf * 100).cast("int")


def args_preview(args_variant: Column) -> Column:
    """Step arguments as ``k=v`` joined by blanks (keys in sorted order)."""
    m = F.try_variant_get(args_variant, "$", "map<string,string>")
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
