"""Schemas, table settings and the rules that rows and names obey."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StringType, StructField, StructType

US = 1
SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

MEASUREMENT = StructType(
    [
        StructField("timestamp_us", LongType(), False),
        StructField("tenant", StringType(), False),
        StructField("series", StringType(), False),
        StructField("value", DoubleType(), False),
        StructField("tags", MapType(StringType(), StringType()), True),
    ]
)

#: Raw rows as stored and as seen by SQL: tags are canonical JSON text.
STORED = StructType(
    [
        StructField("timestamp_us", LongType()),
        StructField("tenant", StringType()),
        StructField("series", StringType()),
        StructField("value", DoubleType()),
        StructField("tags", StringType()),
        StructField("sequence", LongType()),
        StructField("ordinal", LongType()),
    ]
)

ROLLUP_KEY = ("width_us", "bucket_us", "tenant", "series", "tags")
ROLLUP_STATE = (
    ("count", "long"), ("sum", "double"), ("min", "double"), ("max", "double"), ("first", "double"), ("last", "double"),
    ("first_timestamp_us", "long"), ("last_timestamp_us", "long"), ("first_sequence", "long"), ("first_ordinal", "long"), ("last_sequence", "long"), ("last_ordinal", "long"),
)

NAME = re.compile(r"[a-z][a-z0-9_]{0,62}")
MAX_WIDTHS = 16
MAX_SHARDS = 1024
MAX_TAGS = 32
TENANT_BYTES, SERIES_BYTES, TAG_KEY_BYTES, TAG_VALUE_BYTES, REQUEST_BYTES = 256, 1024, 128, 1024, 256


class Rejected(ValueError):
    """An operation that the rules refuse; nothing has changed."""


def check_name(name: str) -> str:
    if not NAME.fullmatch(name) or "__" in name:
        raise Rejected(f"invalid name: {name!r}")
    return name


def check_request_id(request_id: str) -> str:
    if not 1 <= len(request_id.encode()) <= REQUEST_BYTES or "\0" in request_id:
        raise Rejected("invalid request id")
    return request_id


def _known(cls: type, values: dict[str, Any]) -> dict[str, Any]:
    unknown = values.keys() - cls.__dataclass_fields__.keys()
    if unknown:
        raise Rejected(f"unknown settings: {sorted(unknown)}")
    return values


@dataclass
class Policy:
    """Lifecycle settings, all optional, in microseconds."""

    late_after_us: int | None = None
    retention_us: int | None = None
    archive_after_us: int | None = None
    rollup_retention_us: int | None = None
    idempotency_window_us: int | None = None

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if value is not None and value <= 0:
                raise Rejected(f"{name} must be positive")

    @classmethod
    def of(cls, values: dict[str, Any]) -> Policy:
        return cls(**_known(cls, values))


@dataclass
class TableConfig:
    shards: int = 8
    window_us: int = HOUR_US
    rollup_widths_us: list[int] = field(default_factory=lambda: [MINUTE_US])
    policy: Policy = field(default_factory=Policy)

    def __post_init__(self) -> None:
        if isinstance(self.policy, dict):
            self.policy = Policy.of(self.policy)
        if not 1 <= self.shards <= MAX_SHARDS:
            raise Rejected("shards must be from 1 to 1024")
        if self.window_us <= 0:
            raise Rejected("window_us must be positive")
        widths = self.rollup_widths_us
        if len(widths) > MAX_WIDTHS or len(set(widths)) != len(widths) or any(w <= 0 for w in widths):
            raise Rejected("rollup widths must be positive, distinct and at most 16")

    @classmethod
    def of(cls, values: dict[str, Any]) -> TableConfig:
        return cls(**_known(cls, values))


def _text_ok(c: Column, limit: int) -> Column:
    return c.isNotNull() & F.octet_length(c).between(1, limit) & ~F.contains(c, F.lit("\0"))


def row_problem() -> Column:
    """Why a measurement row is refused; null if it isn't."""
    tags = F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))
    tag_ok = F.forall(
        F.map_entries(tags),
        lambda e: _text_ok(e["key"], TAG_KEY_BYTES) & e["value"].isNotNull() & (F.octet_length(e["value"]) <= TAG_VALUE_BYTES) & ~F.contains(e["value"], F.lit("\0")),
    )
    value = F.col("value")
    return (
        F.when(F.col("timestamp_us").isNull(), "timestamp")
        .when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "value")
        .when(~_text_ok(F.col("tenant"), TENANT_BYTES), "tenant")
        .when(~_text_ok(F.col("series"), SERIES_BYTES), "series")
        .when((F.size(tags) > MAX_TAGS) | ~tag_ok, "tags")
    )
