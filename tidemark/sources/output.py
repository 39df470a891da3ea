"""Query results as JSON values."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from tidemark.model import Rejected


def json_rows(df: DataFrame, limit: int = 10_000) -> list[dict[str, Any]]:
    """At most ``limit`` rows as objects, nulls included.

    Decimals, and with them all counts beyond 64 bits, are exact strings at the top and numbers within nested values; times and
    binary values are strings; numbers that JSON lacks are refused.
    """
    odd = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    shown = [F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    bad = F.lit(False)
    for name in odd:
        c = F.col(f"`{name}`")
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    text = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    rows = df.limit(limit + 1).select(text.alias("row"), bad.alias("bad")).collect()
    if len(rows) > limit:
        raise Rejected("the result has too many rows")
    if any(r["bad"] for r in rows):
        raise Rejected("a number is not finite")
    return [json.loads(r["row"]) for r in rows]
