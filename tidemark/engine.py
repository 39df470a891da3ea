"""A database of append-only tables in one folder: atomic batches, rollups, retention, compaction, jobs and SQL.

Everything that a commit adds is written under names of its own first; then one new manifest, created under the next number and
only if that number is free, makes it all visible at once.  Readers use the files that one
manifest names, so they see whole commits only, and lost executors or a failed job leave
nothing but files that no manifest names (``collect_garbage``).

A table's rows are hot files, one folder a commit, until a checkpoint deals them into segments by shard and
event window.  Rollups are states that merge (see ``operators.rollup``): each commit
adds a delta, and maintenance merges deltas.
"""

from __future__ import annotations

import copy
import json
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.exprs import tags_json
from tidemark.model import MAX_WIDTHS, MEASUREMENT, MINUTE_US, ROLLUP_KEY, ROLLUP_STATE, STORED, Policy, Rejected, TableConfig, check_name, check_request_id, row_problem
from tidemark.operators import rollup as rollups
from tidemark.plans.guard import OWN_FUNCTIONS, Token, by_name_parts, check_plan, check_query, check_reads, is_call, parse_call, spark_text, translated
from tidemark.plans.prune import Bounds, bounds_of, shard_of, wanted
from tidemark.sources import segments as seg
from tidemark.sources.files import Store
from tidemark.sources.output import json_rows

STATE = StructType().add("width_us", "long").add("bucket_us", "long").add("tenant", "string").add("series", "string").add("tags", "string")
for _name, _type in ROLLUP_STATE:
    STATE = STATE.add(_name, _type)

CLOCK_SKEW_US = 300_000_000
JOB_KINDS = ("checkpoint", "compact", "ship", "maintain", "vacuum_remote")
MAINTENANCE = "maintenance"
REMOTE_LOCK = "lock.json"
GARBAGE_AGE_S = 3600.0
#: No bucket's sum can pass the largest number while the sizes of all values of a table add up to less.
SAFE_WEIGHT = 1e308
#: Rows, each counted once for every width, that one task sorts at most: some hundred MB.
TASK_ROWS = 1_000_000
MAX_ATTEMPTS, BACKOFF_US, MAX_ERROR = 5, 1_000_000, 2_048

CATALOG: dict[str, str] = {
    "ts_tables": "name string, shards decimal(20,0), window_us bigint, created_sequence decimal(20,0)",
    "ts_policies": "table_name string, late_after_us bigint, retention_us bigint, archive_after_us bigint, rollup_retention_us bigint, idempotency_window_us bigint, idempotency_floor_us bigint",
    "ts_continuous_aggregates": "name string, source string, width_us bigint, created_sequence decimal(20,0)",
    "ts_jobs": "name string, kind string, interval_us bigint, paused boolean, next_run_us bigint, running boolean, attempts decimal(20,0), latest_run_id decimal(20,0), latest_success boolean, latest_error string",
    "ts_status": "database_id string, sequence decimal(20,0), checkpoint_sequence decimal(20,0), remote_sequence decimal(20,0), unshipped_batches decimal(20,0), hot_rows decimal(20,0), hot_bytes decimal(20,0), "
    "wal_bytes decimal(20,0), metadata_bytes decimal(20,0), tables decimal(20,0), continuous_aggregates decimal(20,0), jobs decimal(20,0), healthy boolean",
}


@dataclass(frozen=True)
class Part:
    """Rows that a commit has written: a folder, their number, least and greatest time, and bytes."""

    file: str
    rows: int
    min_us: int
    max_us: int
    bytes: int


class Database:
    """Tables below a folder.  Times come from the caller, so that every rule can be tested and repeated."""

    def __init__(self, spark: SparkSession, root: str, *, segment_rows: int = 1_000_000, compact_min_segments: int = 4, max_batch_rows: int = 10_000) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.segment_rows, self.compact_min_segments, self.max_batch_rows = segment_rows, compact_min_segments, max_batch_rows
        self.running: set[str] = set()
        self.counters = dict.fromkeys(("batches", "rows", "duplicates", "refused", "queries", "checkpoints", "compactions", "shipped_files", "archived_files", "deleted_files"), 0)
        versions = [int(n.split(".")[0]) for n in self.store.names("manifest") if n.endswith(".json")]
        if versions:
            self.version = max(versions)
            self.state: dict[str, Any] = json.loads(self.store.read(f"manifest/{self.version:012d}.json"))
        else:
            self.version = 0
            self.state = {"id": uuid.uuid4().hex, "sequence": 0, "checkpoint_sequence": 0, "remote_sequence": 0, "tables": {}, "aggregates": {}, "jobs": {}}
            self.state["jobs"][MAINTENANCE] = _job("maintain", MINUTE_US, 0, builtin=True)
            self._publish(self.state)

    # -- manifests ------------------------------------------------------------------------------------------------

    def _publish(self, state: dict[str, Any]) -> None:
        if not self.store.put_new(f"manifest/{self.version + 1:012d}.json", json.dumps(state)):
            raise Rejected("another writer has published; open the database again")
        self.version, self.state = self.version + 1, state

    def _draft(self) -> dict[str, Any]:
        return copy.deepcopy(self.state)

    def _table(self, name: str, state: dict[str, Any] | None = None) -> dict[str, Any]:
        try:
            return (state or self.state)["tables"][name]
        except KeyError:
            raise Rejected(f"no table {name}") from None

    @property
    def sequence(self) -> int:
        return self.state["sequence"]

    # -- tables and policies --------------------------------------------------------------------------------------

    def create_table(self, name: str, config: TableConfig | dict[str, Any] | None = None) -> int:
        """The table's sequence; creating it again with the same settings gives the first one."""
        check_name(name)
        config = TableConfig.of(config) if isinstance(config, dict) else config or TableConfig()
        settings = asdict(config)
        if old := self.state["tables"].get(name):
            if old["created_with"] != settings:
                raise Rejected(f"{name} exists with other settings")
            return old["created"]
        self._free(name)
        state = self._draft()
        state["sequence"] += 1
        state["tables"][name] = {
            "created": state["sequence"], "created_with": settings, "shards": config.shards, "window_us": config.window_us, "widths": list(config.rollup_widths_us),
            "policy": asdict(config.policy), "floor_us": None, "raw_cutoff_us": None, "rollup_cutoff_us": None, "hot": [], "segments": [], "deltas": [], "receipts": {},
        }
        self._publish(state)
        return state["sequence"]

    def _free(self, name: str) -> None:
        if name in self.state["tables"] or name in self.state["aggregates"] or name in self.state["jobs"]:
            raise Rejected(f"{name} is taken")

    def policy(self, table: str) -> Policy:
        return Policy.of(self._table(table)["policy"])

    def set_policy(self, table: str, policy: Policy | dict[str, Any], now_us: int = 0) -> int:
        """Replaces all settings.  A window for request ids, once set, stays set."""
        policy = Policy.of(policy) if isinstance(policy, dict) else policy
        state = self._draft()
        t = self._table(table, state)
        if t["policy"]["idempotency_window_us"] is not None and policy.idempotency_window_us is None:
            raise Rejected("timed request ids can't be turned off")
        t["policy"] = asdict(policy)
        t["floor_us"] = _floor(t, now_us)
        state["sequence"] += 1
        self._publish(state)
        return state["sequence"]

    def idempotency_floor_us(self, table: str, now_us: int) -> int | None:
        return _floor(self._table(table), now_us)

    # -- writes ---------------------------------------------------------------------------------------------------

    def write(self, table: str, request_id: str, rows: DataFrame | Iterable[Any], now_us: int) -> dict[str, Any]:
        """One atomic batch; a repeated request gives its first receipt as a duplicate."""
        result = self.write_group([(table, request_id, rows)], now_us)[0]
        if isinstance(result, Rejected):
            raise result
        return result

    def write_group(self, requests: list[tuple[str, str, DataFrame | Iterable[Any]]], now_us: int) -> list[dict[str, Any] | Rejected]:
        """Batches under one sequence: each is accepted or refused on its own, ordinals run on over the accepted ones."""
        state, results = self._draft(), []
        accepted: dict[str, list[Part]] = {}
        sequence = state["sequence"] + 1
        ordinal = 0
        for table, request_id, rows in requests:
            try:
                receipt, part, places = self._admit(state, table, request_id, rows, now_us, sequence, ordinal, accepted.get(table, []))
                if part is not None:
                    accepted.setdefault(table, []).append(part)
                    ordinal += places
                results.append(receipt)
                self.counters["duplicates"] += receipt["duplicate"]
            except Rejected as refused:
                results.append(refused)
                self.counters["refused"] += 1
        if accepted:
            state["sequence"] = sequence
            for table, parts in accepted.items():
                self._add_commit(self._table(table, state), table, parts)
            self._publish(state)
            for parts in accepted.values():
                self.counters["batches"] += len(parts)
                self.counters["rows"] += sum(p.rows for p in parts)
        return results

    def _frame(self, rows: DataFrame | Iterable[Any]) -> DataFrame:
        """MEASUREMENT rows with their places: of a list the index, of a frame numbers that are distinct and follow its partitions."""
        if isinstance(rows, DataFrame):
            return rows.select(*MEASUREMENT.names, F.monotonically_increasing_id().alias("place"))
        listed = [tuple(r[n] if isinstance(r, dict) and n in r else None for n in MEASUREMENT.names) if isinstance(r, dict) else tuple(r) for r in rows]
        if any(isinstance(r, dict) and r.keys() - set(MEASUREMENT.names) for r in rows if isinstance(r, dict)):
            raise Rejected("unknown fields in a row")
        schema = _nullable(StructType([*MEASUREMENT.fields, *StructType().add("place", "long").fields]))
        return self.spark.createDataFrame([(*r, i) for i, r in enumerate(listed)], schema)

    def _admit(self, state: dict, table: str, request_id: str, rows: Any, now_us: int, sequence: int, ordinal: int, same_group: list[Part]) -> tuple[dict[str, Any], Part | None, int]:
        """The receipt; what was stored, and its ordinals.  Rows are written in the one pass that checks them; of a refused batch the file goes."""
        check_request_id(request_id)
        t = self._table(table, state)
        rows = rows if isinstance(rows, DataFrame) else list(rows)
        if not isinstance(rows, DataFrame) and len(rows) > self.max_batch_rows:
            raise Rejected("the batch has too many rows")
        frame = self._frame(rows).withColumn("text", tags_json(F.col("tags")))
        row = F.struct(F.col("timestamp_us"), F.col("tenant"), F.col("series"), F.col("value"), F.col("text").alias("tags"), *([] if isinstance(rows, DataFrame) else [F.col("place")]))
        checks = [
            F.count(F.lit(1)).alias("rows"),
            F.min("timestamp_us").alias("least"),
            F.max("timestamp_us").alias("most"),
            F.max("place").alias("places"),
            F.min(row_problem()).alias("problem"),
            F.sum(F.abs("value")).alias("weight"),
            F.bit_xor(F.xxhash64(row)).alias("x"),
            F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)")).alias("s"),
        ]
        if request_id in t["receipts"]:
            checked, name = frame.agg(*checks).first().asDict(), None
        else:
            seen = Observation()
            stored = frame.observe(seen, *checks).select(
                "timestamp_us", "tenant", "series", "value", F.col("text").alias("tags"),
                F.lit(sequence).cast("bigint").alias("sequence"), (F.col("place") + ordinal).alias("ordinal"),
            )
            name = f"hot/{table}/{sequence:020d}-{uuid.uuid4().hex[:8]}"
            stored.write.option("compression", "zstd").option("parquet.block.size", seg.BLOCK).parquet(self.store.at(name))
            checked = seen.get
        try:
            if not checked["rows"]:
                raise Rejected("the batch is empty")
            if checked["problem"] is not None:
                raise Rejected(f"a row's {checked['problem']} is invalid")
            digest = f"{checked['rows']}:{checked['x']}:{checked['s']}"
            issued = self._issued(t, request_id, now_us)
            if old := t["receipts"].get(request_id):
                if old["digest"] != digest:
                    raise Rejected("the request id was used for other rows")
                return {"sequence": old["sequence"], "rows": old["rows"], "duplicate": True}, None, 0
            late = t["policy"]["late_after_us"]
            if late is not None and checked["least"] < now_us - late:
                raise Rejected("a row is too late")
            if t["raw_cutoff_us"] is not None and checked["least"] < t["raw_cutoff_us"]:
                raise Rejected("a row is older than what is kept")
            part = Part(name, checked["rows"], checked["least"], checked["most"], sum(b for _, b in self.store.files(name)))
            weight = t.get("weight", 0.0) + checked["weight"]
            if not weight < SAFE_WEIGHT:
                self._check_sums(t, part, same_group)
            t["weight"] = min(weight, SAFE_WEIGHT)
        except Rejected:
            if name is not None:
                self.store.delete(name)
            raise
        t["receipts"][request_id] = {"sequence": sequence, "rows": checked["rows"], "digest": digest, "issued_us": issued}
        receipt = {"sequence": sequence, "rows": checked["rows"], "duplicate": False}
        return receipt, part, checked["places"] + 1

    def _issued(self, t: dict[str, Any], request_id: str, now_us: int) -> int | None:
        """The time in a timed id, once the table asks for one."""
        floor = _floor(t, now_us)
        if floor is None:
            return None
        parts = request_id.split(":", 2)
        if len(parts) != 3 or parts[0] != "v1" or not parts[1].lstrip("-").isdigit() or not parts[2]:
            raise Rejected("expected a request id v1:<issued_us>:<nonce>")
        issued = int(parts[1])
        if issued < floor:
            raise Rejected("the request id has expired")
        if request_id not in t["receipts"] and issued > now_us + CLOCK_SKEW_US:
            raise Rejected("the request id is from the future")
        return issued

    def _read(self, files: list[dict[str, Any]], copies: int = 1) -> DataFrame:
        """Stored rows of files, in a session whose tasks hold some TASK_ROWS rows, each copied so often, before and after a shuffle: files are too well
        compressed for their bytes to bound what a task sorts."""
        rows, size = sum(f["rows"] for f in files) * copies, sum(f["bytes"] for f in files)
        session = type(self.spark)(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        if rows > TASK_ROWS:
            conf = self.spark._jsparkSession.sessionState().conf()
            session.conf.set("spark.sql.files.maxPartitionBytes", min(conf.filesMaxPartitionBytes(), max(size * TASK_ROWS // rows, 1 << 16)))
            session.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(conf.numShufflePartitions(), -(-rows // TASK_ROWS)))
        return seg.read_files(session, [self._place(f) for f in files])

    def _part_states(self, t: dict[str, Any], parts: list[Part]) -> DataFrame:
        return rollups.rollup(self._read([asdict(p) for p in parts], len(t["widths"])), t["widths"], t["rollup_cutoff_us"])

    def _check_sums(self, t: dict[str, Any], part: Part, same_group: list[Part]) -> None:
        """Refuses rows that would make a rollup's sum infinite.  Needed only once the sum of all values' sizes is near the largest number."""
        if not t["widths"]:
            return
        delta = self._part_states(t, [*same_group, part])
        reach = max(t["widths"])
        touched = self._states(t, part.min_us - reach, max(p.max_us for p in [*same_group, part])).join(delta.select(*ROLLUP_KEY), list(ROLLUP_KEY), "left_semi")
        if rollups.not_finite(rollups.merge(touched.select(*STATE.names).unionByName(delta))).limit(1).count():
            raise Rejected("a rollup's sum is no longer finite")

    def _add_commit(self, t: dict[str, Any], table: str, parts: list[Part]) -> None:
        t["hot"] += [{"file": p.file, "shard": None, "window": None, "rows": p.rows, "min_us": p.min_us, "max_us": p.max_us, "bytes": p.bytes} for p in parts]
        if t["widths"]:
            self._add_states(t, table, self._part_states(t, parts), min(p.min_us for p in parts), max(p.max_us for p in parts))

    def _add_states(self, t: dict[str, Any], table: str, states: DataFrame, min_us: int, max_us: int, *, widths: list[int] | None = None, replace: bool = False) -> None:
        """A delta, of one state for each key, of rows from min_us to max_us.  Partitions are those that the states were made in, which follow size, so one width can fill many tasks."""
        name = f"rollup/{table}/{uuid.uuid4().hex}"
        dealt = states.select(*STATE.names).sortWithinPartitions(*ROLLUP_KEY)
        dealt.write.partitionBy("width_us").option("compression", "zstd").parquet(self.store.at(name))
        delta = {"file": name, "min_us": min_us, "max_us": max_us, "widths": sorted(t["widths"] if widths is None else widths)}
        t["deltas"] = [delta] if replace else [*t["deltas"], delta]

    def _merge_states(self, t: dict[str, Any], table: str, states: DataFrame) -> None:
        """States, which hold all that is kept, as the only delta."""
        if t["deltas"]:
            self._add_states(t, table, states, min(d["min_us"] for d in t["deltas"]), max(d["max_us"] for d in t["deltas"]), replace=True)

    def _deltas(self, t: dict[str, Any], start_us: int | None = None, end_us: int | None = None, width_us: int | None = None) -> list[dict[str, Any]]:
        """Deltas that can hold states of a width, of buckets from start_us to end_us."""
        reach = max(t["widths"], default=0)
        low, high = rollups.LOW if start_us is None else start_us, rollups.HIGH if end_us is None else end_us
        return [d for d in t["deltas"] if d["min_us"] - reach < high and d["max_us"] >= low and (width_us is None or width_us in d["widths"])]

    def _alone(self, deltas: list[dict[str, Any]]) -> bool:
        """Whether no key repeats: keys do only where two deltas hold a width.  The states stand as they are then, without a shuffle."""
        return sum(len(d["widths"]) for d in deltas) == len({w for d in deltas for w in d["widths"]})

    def _states(self, t: dict[str, Any], start_us: int | None = None, end_us: int | None = None, width_us: int | None = None) -> DataFrame:
        """States, which may repeat keys where several deltas hold them: all, or those of a width, of buckets from start_us to end_us."""
        deltas = self._deltas(t, start_us, end_us, width_us)
        if not deltas:
            return self.spark.createDataFrame([], STATE)
        parts = [self.spark.read.schema(STATE).parquet(self.store.at(d["file"])).select(*STATE.names) for d in deltas]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        for wanted_rows in ([] if start_us is None else [F.col("bucket_us") >= start_us]) + ([] if end_us is None else [F.col("bucket_us") <= end_us]) + ([] if width_us is None else [F.col("width_us") == width_us]):
            out = out.where(wanted_rows)
        return out

    # -- reads ----------------------------------------------------------------------------------------------------

    def rows(self, table: str, bounds: Bounds = Bounds()) -> DataFrame:
        """Raw rows that are kept, from the files that bounds need."""
        t = self._table(table)
        shard = shard_of(bounds.tenant, bounds.series, t["shards"]) if bounds.tenant is not None and bounds.series is not None else None
        files = [self._place(s) for s in wanted([*t["hot"], *t["segments"]], bounds, shard)]
        out = seg.read_files(self.spark, files)
        return out if t["raw_cutoff_us"] is None else out.where(F.col("timestamp_us") >= t["raw_cutoff_us"])

    def _place(self, s: dict[str, Any]) -> str:
        """Where a file is: in an archive, or here."""
        return f"{s['archive']}/{s['file']}" if s.get("archive") else self.store.at(s["file"])

    def segments(self, table: str) -> list[dict[str, Any]]:
        """What the manifest says of a table's segments."""
        return copy.deepcopy(self._table(table)["segments"])

    def scan(self, table: str, start_us: int | None = None, end_us: int | None = None, tenant: str | None = None, series: str | None = None, *, ordered: bool = True) -> DataFrame:
        """Rows with start <= time < end of a tenant and series, in total order unless that isn't needed."""
        if start_us is not None and end_us is not None and start_us > end_us:
            raise Rejected("the range ends before it starts")
        out = self.rows(table, Bounds(start_us, end_us, tenant, series))
        for name, value in (("tenant", tenant), ("series", series)):
            out = out if value is None else out.where(F.col(name) == value)
        out = out if start_us is None else out.where(F.col("timestamp_us") >= start_us)
        out = out if end_us is None else out.where(F.col("timestamp_us") < end_us)
        return out.orderBy(*seg.SORT) if ordered else out

    def rollups(self, table: str, *, width_us: int | None = None, tenant: str | None = None, series: str | None = None, start_us: int | None = None, end_us: int | None = None, ordered: bool = False) -> DataFrame:
        """The rollup relation, by width, tenant, series and start <= bucket < end; in the order of its key if asked."""
        if start_us is not None and end_us is not None and start_us > end_us:
            raise Rejected("the range ends before it starts")
        t, last = self._table(table), None if end_us is None else end_us - 1
        out = self._states(t, start_us, last, width_us)
        for name, value in (("tenant", tenant), ("series", series)):
            out = out if value is None else out.where(F.col(name) == value)
        out = rollups.view(out if self._alone(self._deltas(t, start_us, last, width_us)) else rollups.merge(out))
        return out.orderBy(*ROLLUP_KEY) if ordered else out

    def catalog(self, name: str, now_us: int = 0) -> DataFrame:
        return self.spark.createDataFrame(getattr(self, f"_{name}")(now_us), CATALOG[name])

    def _ts_tables(self, now_us: int) -> list[tuple]:
        return [(n, _d(t["shards"]), t["window_us"], _d(t["created"])) for n, t in sorted(self.state["tables"].items())]

    def _ts_policies(self, now_us: int) -> list[tuple]:
        names = ("late_after_us", "retention_us", "archive_after_us", "rollup_retention_us", "idempotency_window_us")
        return [(n, *[t["policy"][p] for p in names], t["floor_us"]) for n, t in sorted(self.state["tables"].items())]

    def _ts_continuous_aggregates(self, now_us: int) -> list[tuple]:
        return [(n, a["source"], a["width_us"], _d(a["created"])) for n, a in sorted(self.state["aggregates"].items())]

    def _ts_jobs(self, now_us: int) -> list[tuple]:
        return [
            (n, j["kind"], j["interval_us"], j["paused"], j["next_run_us"], n in self.running, _d(j["attempts"]), None if j["run_id"] is None else _d(j["run_id"]), j["success"], j["error"])
            for n, j in sorted(self.state["jobs"].items())
        ]

    def _ts_status(self, now_us: int) -> list[tuple]:
        s, hot = self.state, [h for t in self.state["tables"].values() for h in t["hot"]]
        counts = [s["sequence"], s["checkpoint_sequence"], s["remote_sequence"], s["sequence"] - s["remote_sequence"], sum(h["rows"] for h in hot), sum(h["bytes"] for h in hot), self.store.size("manifest"), len(json.dumps(s)), len(s["tables"]), len(s["aggregates"]), len(s["jobs"])]
        return [(s["id"], *map(_d, counts), self.is_head())]

    def is_head(self) -> bool:
        """Whether nobody else has published since."""
        return not self.store.exists(f"manifest/{self.version + 1:012d}.json")

    def status(self) -> dict[str, Any]:
        return self.catalog("ts_status").first().asDict()

    def query(self, sql: str, now_us: int = 0) -> DataFrame:
        """Rows of one reading statement over tables, ``<table>__rollup``, aggregates and catalog relations; of a CALL; or a plan, of EXPLAIN."""
        if is_call(sql):
            return self.spark.createDataFrame([(self.call(sql, now_us),)], "sequence bigint")
        self.counters["queries"] += 1
        found = check_query(sql)
        if found[0][1].upper() == "EXPLAIN":
            return self._explained(found[1:], now_us)
        return self._queried(found, now_us)

    def _explained(self, found: list[Token], now_us: int) -> DataFrame:
        """The plan as one text: Spark's, or with FORMAT JSON as JSON."""
        mode = "simple"
        while found and found[0][1].upper() not in ("SELECT", "WITH"):
            word = found[0][1].upper()
            if found[0] == ("sign", "(") and ("sign", ")") in found:
                options = [t.upper() for _, t in found[1 : found.index(("sign", ")"))]]
                mode = "json" if options[:2] == ["FORMAT", "JSON"] else mode
                found = found[found.index(("sign", ")")) + 1 :]
                continue
            if word not in ("ANALYZE", "FORMATTED", "EXTENDED", "COST"):
                raise Rejected(f"EXPLAIN {word} is not allowed")
            mode = {"ANALYZE": "formatted"}.get(word, word.lower())
            found = found[1:]
        execution = self._queried(found, now_us)._jdf.queryExecution()
        text = execution.executedPlan().toJSON() if mode == "json" else execution.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return self.spark.createDataFrame([(text,)], "plan string")

    def _queried(self, found: list[Token], now_us: int) -> DataFrame:
        if parts := by_name_parts(found):
            left, all_rows, right = parts
            both = self._queried(left, now_us).unionByName(self._queried(right, now_us), allowMissingColumns=True)
            return both if all_rows else both.distinct()
        found = translated(found, set(CATALOG))
        text = spark_text(found)
        words = {t.lower() for k, t in found if k in ("word", "name")}
        sources = {a: d["source"] for a, d in self.state["aggregates"].items() if a in words}
        tables = [n for n in self.state["tables"] if n in words or f"{n}__rollup" in words or n in sources.values()]
        catalogs = [n for n in CATALOG if n in words]
        session = self._session()
        for name in words & OWN_FUNCTIONS.keys():
            session.sql(f"CREATE TEMPORARY FUNCTION {name}{OWN_FUNCTIONS[name]}")
        check_plan(session, text, {*tables, *(f"{n}__rollup" for n in tables), *sources, *catalogs})
        for name in tables:
            _view(session, self.rows(name), name)
            if f"{name}__rollup" in words or name in sources.values():
                _view(session, self.rollups(name), f"{name}__rollup")
        for name, source in sources.items():
            width = self.state["aggregates"][name]["width_us"]
            _view(session, rollups.named(self.rollups(source, width_us=width), width), name)
        for name in catalogs:
            _view(session, self.catalog(name, now_us), name)
        df = session.sql(text)
        check_reads(df)
        raw = [n for n in tables if n in words]
        bounds = bounds_of(df, "ordinal") if len(raw) == 1 else Bounds()
        if bounds == Bounds():
            return df
        _view(session, self.rows(raw[0], bounds), raw[0])
        return session.sql(text)

    def _session(self) -> SparkSession:
        session = self.spark.newSession()
        session.conf.set("spark.sql.runSQLOnFiles", "false")
        session.conf.set("spark.sql.session.timeZone", "UTC")
        return session

    def fetch(self, sql: str, now_us: int = 0, *, max_rows: int = 10_000, max_bytes: int = 16 << 20, timeout_s: float = 30.0) -> list[dict[str, Any]]:
        """A statement's rows as JSON values, within limits; a statement over time is cancelled."""
        context, group = self.spark.sparkContext, f"query-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(timeout_s, stop)
        context.setJobGroup(group, "a statement with a time limit", interruptOnCancel=True)
        timer.start()
        try:
            rows = json_rows(self.query(sql, now_us), max_rows)
        except Exception:
            if late.is_set():
                raise Rejected("the statement took too long") from None
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if late.is_set():
            raise Rejected("the statement took too long")
        if len(json.dumps(rows, ensure_ascii=False).encode()) > max_bytes:
            raise Rejected("the result has too many bytes")
        return rows

    # -- continuous aggregates ------------------------------------------------------------------------------------

    def create_continuous_aggregate(self, name: str, source: str, width_us: int) -> int:
        """A name for a width of a table's rollup; a new width is filled from the rows that are kept."""
        check_name(name)
        t0 = self._table(source)
        if old := self.state["aggregates"].get(name):
            if (old["source"], old["width_us"]) != (source, width_us):
                raise Rejected(f"{name} exists with other settings")
            return old["created"]
        self._free(name)
        if width_us <= 0:
            raise Rejected("width_us must be positive")
        if width_us not in t0["widths"] and len(t0["widths"]) >= MAX_WIDTHS:
            raise Rejected("a table has at most 16 widths")
        state = self._draft()
        t = self._table(source, state)
        state["sequence"] += 1
        state["aggregates"][name] = {"source": source, "width_us": width_us, "created": state["sequence"]}
        if width_us not in t["widths"]:
            kept = [*t["hot"], *t["segments"]]
            if kept:
                rows = self._read(kept)
                rows = rows if t["raw_cutoff_us"] is None else rows.where(F.col("timestamp_us") >= t["raw_cutoff_us"])
                states = rollups.rollup(rows, [width_us], t["rollup_cutoff_us"])
                if not t.get("weight", SAFE_WEIGHT) < SAFE_WEIGHT and rollups.not_finite(states).limit(1).count():
                    raise Rejected("a rollup's sum is not finite")
                self._add_states(t, source, states, min(s["min_us"] for s in kept), max(s["max_us"] for s in kept), widths=[width_us])
            t["widths"].append(width_us)
        self._publish(state)
        return state["sequence"]

    def drop_continuous_aggregate(self, name: str) -> int:
        """The width goes with its last name, unless the table was created with it."""
        state = self._draft()
        try:
            gone = state["aggregates"].pop(name)
        except KeyError:
            raise Rejected(f"no aggregate {name}") from None
        t = self._table(gone["source"], state)
        width = gone["width_us"]
        shared = any(a["source"] == gone["source"] and a["width_us"] == width for a in state["aggregates"].values())
        state["sequence"] += 1
        if not shared and width not in t["created_with"]["rollup_widths_us"]:
            t["widths"].remove(width)
            self._merge_states(t, gone["source"], rollups.merge(self._states(t).where(F.col("width_us") != width)))
        self._publish(state)
        return state["sequence"]

    # -- lifecycle ------------------------------------------------------------------------------------------------

    def checkpoint(self) -> int:
        """Deals hot rows into segments; the number of tables that had any."""
        state = self._draft()
        done = 0
        for name, t in state["tables"].items():
            if t["hot"]:
                rows = self._read(t["hot"])
                if t["raw_cutoff_us"] is not None:
                    rows = rows.where(F.col("timestamp_us") >= t["raw_cutoff_us"])
                many = sum(h["rows"] for h in t["hot"]) > self.segment_rows
                t["segments"] += self._segments(name, t, rows, seg.count_groups(rows, t["shards"], t["window_us"], self.segment_rows) if many else {})
                t["hot"] = []
                if not self._alone(t["deltas"]):
                    self._merge_states(t, name, rollups.merge(self._states(t)))
                done += 1
        if done:
            state["checkpoint_sequence"] = state["sequence"]
            self._publish(state)
            self.counters["checkpoints"] += 1
        return done

    def _segments(self, table: str, t: dict[str, Any], rows: DataFrame, large: dict[tuple[int, int], int]) -> list[dict[str, Any]]:
        """Writes rows as new segments and describes them.  large: rows of the shards and windows that need several."""
        name = f"segments/{table}/{uuid.uuid4().hex}"
        seg.write_segments(rows, self.store.at(name), t["shards"], t["window_us"], self.segment_rows, large)
        sizes = dict(self.store.files(name))
        if not sizes:
            return []
        found = seg.describe(self.spark, self.store.root, list(sizes)).collect()
        out = []
        for r in found:
            file = f"{name}/{r['file'].split(f'/{name}/', 1)[1]}"
            out.append({"file": file, "shard": r["shard"], "window": r["window"], "rows": r["rows"], "min_us": r["min_us"], "max_us": r["max_us"], "bytes": sizes[file]})
        return sorted(out, key=lambda s: s["file"])

    def maintain(self, now_us: int, remote_root: str | None = None) -> dict[str, int | None]:
        """Floors, checkpoint, retention of rows and rollups, one round of compaction; with a remote store then ship, archive and vacuum; garbage last.

        Cutoffs never go back.
        """
        report: dict[str, Any] = {"checkpointed": self.checkpoint(), "expired_rows": 0, "expired_rollups": 0, "compacted": 0, "shipped_sequence": None, "evicted_files": 0, "vacuumed_files": 0, "reclaimed_files": 0}
        state = self._draft()
        for name, t in state["tables"].items():
            t["floor_us"] = _floor(t, now_us)
            if t["floor_us"] is not None:
                t["receipts"] = {k: r for k, r in t["receipts"].items() if r["issued_us"] is None or r["issued_us"] >= t["floor_us"]}
            if (keep := t["policy"]["retention_us"]) is not None:
                cutoff = max(now_us - keep, t["raw_cutoff_us"] if t["raw_cutoff_us"] is not None else now_us - keep)
                report["expired_rows"] += self._expire_rows(name, t, cutoff)
                t["raw_cutoff_us"] = cutoff
            if (keep := t["policy"]["rollup_retention_us"]) is not None:
                cutoff = max(now_us - keep, t["rollup_cutoff_us"] if t["rollup_cutoff_us"] is not None else now_us - keep)
                states = rollups.merge(self._states(t)).cache()
                kept = states.where(F.col("bucket_us") + F.col("width_us") > cutoff)
                gone = states.count() - kept.count()
                if gone:
                    self._merge_states(t, name, kept)
                states.unpersist()
                report["expired_rollups"] += gone
                t["rollup_cutoff_us"] = cutoff
        if state != self.state:
            self._publish(state)
        report["compacted"] = self.compact()
        if remote_root is not None:
            report["shipped_sequence"] = self.ship(remote_root)
            report["evicted_files"] = self.archive(now_us, remote_root)
            report["vacuumed_files"] = self.vacuum_remote(remote_root)
        report["reclaimed_files"] = self.collect_garbage()
        return report

    def _expire_rows(self, name: str, t: dict[str, Any], cutoff: int) -> int:
        """Drops segments before the cutoff, and writes those across it again without what is older."""
        old = [s for s in t["segments"] if s["max_us"] < cutoff]
        across = [s for s in t["segments"] if s["min_us"] < cutoff <= s["max_us"]]
        before = sum(s["rows"] for s in t["segments"])
        gone = {s["file"] for s in [*old, *across]}
        t["segments"] = [s for s in t["segments"] if s["file"] not in gone]
        if across:
            t["segments"] += self._segments(name, t, self._read(across).where(F.col("timestamp_us") >= cutoff), _group_rows(across))
        return before - sum(s["rows"] for s in t["segments"])

    def verify(self, table: str) -> list[str]:
        """What is wrong with a table's segments, here or archived: missing files, other columns or types, nulls, other rows or times than the manifest says."""
        known = {self._place(s): s for s in self._table(table)["segments"]}
        problems, there = [], []
        for path, s in known.items():
            store = Store(self.spark, s["archive"]) if s.get("archive") else self.store
            if not store.exists(s["file"]):
                problems.append(f"{s['file']}: missing")
            elif store.length(s["file"]) != s["bytes"]:
                problems.append(f"{s['file']}: {store.length(s['file'])} bytes instead of {s['bytes']}")
            else:
                there.append(path)
        if there:
            problems += seg.faults(self.spark, {p: known[p] for p in there})
        return sorted(problems)

    def compaction_groups(self, table: str) -> list[list[dict[str, Any]]]:
        """Small segments of a shard and window that one rewrite would make fewer."""
        groups: dict[tuple, list[dict[str, Any]]] = {}
        for s in self._table(table)["segments"]:
            if s["rows"] < self.segment_rows and not s.get("archive"):
                groups.setdefault((s["shard"], s["window"]), []).append(s)
        enough = [g for g in groups.values() if len(g) >= self.compact_min_segments]
        return [g for g in enough if -(-sum(s["rows"] for s in g) // self.segment_rows) < len(g)]

    def compact(self) -> int:
        """Merges small segments, all groups of a table in one job; the number of groups."""
        state = self._draft()
        done = 0
        for name, t in state["tables"].items():
            groups = self.compaction_groups(name)
            if groups:
                old = [s for g in groups for s in g]
                gone = {s["file"] for s in old}
                merged = self._segments(name, t, self._read(old), _group_rows(old))
                t["segments"] = [s for s in t["segments"] if s["file"] not in gone] + merged
                done += len(groups)
        if done:
            self._publish(state)
            self.counters["compactions"] += done
        return done

    def archive_candidates(self, table: str, now_us: int) -> list[str]:
        """Segments old enough to be kept in the remote store alone."""
        t = self._table(table)
        age = t["policy"]["archive_after_us"]
        return [] if age is None else [s["file"] for s in t["segments"] if s["max_us"] < now_us - age]

    def archive(self, now_us: int, remote_root: str) -> int:
        """Moves old segments to the remote store, where scans read them from then on; the number of segments."""
        remote, state, moved = Store(self.spark, remote_root), self._draft(), 0
        for name, t in state["tables"].items():
            old = set(self.archive_candidates(name, now_us))
            for s in t["segments"]:
                if s["file"] in old and not s.get("archive"):
                    remote.copied_from(self.store, [s["file"]])
                    s["archive"] = remote.root
                    moved += 1
        if moved:
            self._publish(state)
            self.counters["archived_files"] += moved
        return moved

    def _named_files(self) -> list[str]:
        names: list[str] = []
        for t in self.state["tables"].values():
            for folder in [*[h["file"] for h in t["hot"]], *[d["file"] for d in t["deltas"]]]:
                names += [n for n, _ in self.store.files(folder)]
            names += [s["file"] for s in t["segments"] if not s.get("archive")]
        return names

    @contextmanager
    def _remote_lock(self, remote: Store, kind: str) -> Iterator[None]:
        """One operation on a remote store at a time, whoever does it; a lock that a dead owner has left is named in the refusal."""
        token = uuid.uuid4().hex
        if not remote.put_new(REMOTE_LOCK, json.dumps({"kind": kind, "owner": self.state["id"], "token": token})):
            raise Rejected(f"the remote store is locked: {remote.read(REMOTE_LOCK)}")
        try:
            yield
        finally:
            if remote.exists(REMOTE_LOCK) and json.loads(remote.read(REMOTE_LOCK))["token"] == token:
                remote.delete(REMOTE_LOCK)

    def recover_remote_lock(self, remote_root: str, token: str) -> bool:
        """Removes the lock with this token, of an owner that is known to be dead; an operation that wakes up later finds the head moved or its lock gone."""
        remote = Store(self.spark, remote_root)
        if not remote.exists(REMOTE_LOCK):
            return False
        if json.loads(remote.read(REMOTE_LOCK))["token"] != token:
            raise Rejected("the remote lock has another token")
        remote.delete(REMOTE_LOCK)
        return True

    def ship(self, remote_root: str) -> int:
        """Copies what the manifest names, then sets the remote head if nobody else has; the sequence shipped."""
        remote = Store(self.spark, remote_root)
        with self._remote_lock(remote, "ship"):
            copied = remote.copied_from(self.store, self._named_files())
            state = self._draft()
            state["remote_sequence"] = state["sequence"]
            if not remote.put_new(f"manifest/{self.version + 1:012d}.json", json.dumps(state)):
                raise Rejected("the remote head has moved")
            self.counters["shipped_files"] += copied
            self._publish(state)
        return state["sequence"]

    @classmethod
    def restore(cls, spark: SparkSession, remote_root: str, root: str, **settings: Any) -> Database:
        """A new database folder from the remote head."""
        remote, local = Store(spark, remote_root), Store(spark, root)
        if local.names("manifest"):
            raise Rejected("the folder already holds a database")
        heads = [n for n in remote.names("manifest") if n.endswith(".json")]
        if not heads:
            raise Rejected("nothing to restore")
        source = cls(spark, remote_root, **settings)
        local.copied_from(remote, source._named_files())
        remote.copy_to(f"manifest/{max(heads)}", local)
        return cls(spark, root, **settings)

    def collect_garbage(self, older_than_s: float = GARBAGE_AGE_S) -> int:
        """Deletes data files that the manifest doesn't name and that are older than that: commits in flight, and readers of a manifest just replaced, keep theirs."""
        named, gone = set(self._named_files()), 0
        for folder in ("hot", "segments", "rollup"):
            for name, _ in self.store.files(folder, older_than_s):
                if name not in named:
                    self.store.delete(name)
                    gone += 1
        self.counters["deleted_files"] += gone
        return gone

    def vacuum_remote(self, remote_root: str, older_than_s: float = GARBAGE_AGE_S) -> int:
        """Deletes old remote data files that neither the remote head nor this database's archived segments name."""
        remote = Store(self.spark, remote_root)
        with self._remote_lock(remote, "vacuum"):
            head = Database(self.spark, remote_root)
            kept = {s["file"] for t in self.state["tables"].values() for s in t["segments"]}
            gone = 0
            named = set(head._named_files()) | kept | {s["file"] for t in head.state["tables"].values() for s in t["segments"]}
            for folder in ("hot", "segments", "rollup"):
                for name, _ in remote.files(folder, older_than_s):
                    if name not in named:
                        remote.delete(name)
                        gone += 1
        return gone

    def performance(self) -> dict[str, int]:
        """What this object has done since it was opened."""
        return dict(self.counters)

    def metrics(self) -> str:
        """The status and the counters as lines that scrapers of metrics read."""
        numbers = {k: v for k, v in self.status().items() if k not in ("database_id", "healthy")} | {"healthy": int(self.is_head())} | self.counters
        return "".join(f"tidemark_{k} {v}\n" for k, v in sorted(numbers.items()))

    # -- jobs -----------------------------------------------------------------------------------------------------

    def create_job(self, name: str, kind: str, interval_us: int, now_us: int) -> int:
        check_name(name)
        self._free(name)
        if kind not in JOB_KINDS or interval_us <= 0:
            raise Rejected("unknown kind of job or no interval")
        return self._change_jobs(lambda jobs: jobs.update({name: _job(kind, interval_us, now_us + interval_us)}))

    def alter_job(self, name: str, interval_us: int, now_us: int) -> int:
        if interval_us <= 0:
            raise Rejected("no interval")
        return self._change_jobs(lambda jobs: _get(jobs, name).update(interval_us=interval_us, next_run_us=now_us + interval_us))

    def pause_job(self, name: str) -> int:
        return self._change_jobs(lambda jobs: _get(jobs, name).update(paused=True))

    def resume_job(self, name: str, now_us: int) -> int:
        return self._change_jobs(lambda jobs: _get(jobs, name).update(paused=False, next_run_us=now_us))

    def drop_job(self, name: str) -> int:
        if _get(self.state["jobs"], name)["builtin"]:
            raise Rejected("a built-in job can't be dropped")
        return self._change_jobs(lambda jobs: jobs.pop(name))

    def _change_jobs(self, change: Callable[[dict], Any]) -> int:
        state = self._draft()
        change(state["jobs"])
        state["sequence"] += 1
        self._publish(state)
        return state["sequence"]

    def jobs(self) -> dict[str, dict[str, Any]]:
        return copy.deepcopy(self.state["jobs"])

    def tick(self, now_us: int, remote_root: str | None = None) -> list[str]:
        """Runs the jobs that are due; their names."""
        due = [n for n, j in sorted(self.state["jobs"].items()) if not j["paused"] and j["next_run_us"] <= now_us]
        for name in due:
            self.run_job_now(name, now_us, remote_root)
        return due

    def run_job_now(self, name: str, now_us: int, remote_root: str | None = None) -> bool:
        """Runs a job, paused or not.  After a failure it is tried again after a wait that doubles, up to its interval."""
        job = _get(self.state["jobs"], name)
        self.running.add(name)
        try:
            self._run(job["kind"], now_us, remote_root)
            error = None
        except Exception as failed:  # noqa: BLE001 - whatever it is, the job's record keeps it
            error = str(failed)[:MAX_ERROR] or type(failed).__name__
        finally:
            self.running.discard(name)
        attempts = 0 if error is None else job["attempts"] + 1
        wait = job["interval_us"]
        if error is not None and attempts < MAX_ATTEMPTS:
            wait = min(wait, BACKOFF_US * 2 ** (attempts - 1))
        state = self._draft()
        run_id = (state["jobs"][name]["run_id"] or 0) + 1
        state["jobs"][name].update(attempts=attempts, run_id=run_id, success=error is None, error=error, next_run_us=now_us + wait)
        self._publish(state)
        return error is None

    def _run(self, kind: str, now_us: int, remote_root: str | None) -> None:
        if kind in ("ship", "vacuum_remote") and remote_root is None:
            raise Rejected("no remote store is set")
        {
            "checkpoint": self.checkpoint,
            "compact": self.compact,
            "maintain": lambda: self.maintain(now_us, remote_root),
            "ship": lambda: self.ship(str(remote_root)),
            "vacuum_remote": lambda: self.vacuum_remote(str(remote_root)),
        }[kind]()

    # -- CALL -----------------------------------------------------------------------------------------------------

    def call(self, sql: str, now_us: int = 0) -> int:
        """One control statement with literal arguments; the sequence after it."""
        name, args = parse_call(sql)
        forms: dict[str, tuple[int, Callable[..., int]]] = {
            "ts_set_policy": (2, lambda table, settings: self.set_policy(table, json.loads(settings), now_us)),
            "ts_create_continuous_aggregate": (3, self.create_continuous_aggregate),
            "ts_drop_continuous_aggregate": (1, self.drop_continuous_aggregate),
            "ts_create_job": (3, lambda job, kind, interval: self.create_job(job, kind, interval, now_us)),
            "ts_alter_job": (2, lambda job, interval: self.alter_job(job, interval, now_us)),
            "ts_pause_job": (1, self.pause_job),
            "ts_resume_job": (1, lambda job: self.resume_job(job, now_us)),
            "ts_drop_job": (1, self.drop_job),
            "ts_run_job": (1, lambda job: (self.run_job_now(job, now_us), self.sequence)[1]),
        }
        if name not in forms or len(args) != forms[name][0]:
            raise Rejected(f"no control statement {name} with {len(args)} arguments")
        return forms[name][1](*args)


def _d(n: int) -> Decimal:
    return Decimal(n)


def _nullable(schema: StructType) -> StructType:
    out = StructType()
    for f in schema.fields:
        out = out.add(f.name, f.dataType, True)
    return out


def _view(session: SparkSession, df: DataFrame, name: str) -> None:
    """df as a view of another session of the same context."""
    plan = df._jdf.queryExecution().logical()
    session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan).createOrReplaceTempView(name)


def _floor(t: dict[str, Any], now_us: int) -> int | None:
    """The oldest time of a request id; it only rises."""
    window = t["policy"]["idempotency_window_us"]
    if window is None:
        return None
    return now_us - window if t["floor_us"] is None else max(t["floor_us"], now_us - window)


def _group_rows(segments: list[dict[str, Any]]) -> dict[tuple[int, int], int]:
    """Rows of each shard and window."""
    out: dict[tuple[int, int], int] = {}
    for s in segments:
        out[s["shard"], s["window"]] = out.get((s["shard"], s["window"]), 0) + s["rows"]
    return out


def _job(kind: str, interval_us: int, next_run_us: int, *, builtin: bool = False) -> dict[str, Any]:
    return {"kind": kind, "interval_us": interval_us, "paused": False, "next_run_us": next_run_us, "attempts": 0, "run_id": None, "success": None, "error": None, "builtin": builtin}


def _get(jobs: dict[str, dict], name: str) -> dict:
    try:
        return jobs[name]
    except KeyError:
        raise Rejected(f"no job {name}") from None
