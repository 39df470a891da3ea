"""Commands over a database folder: python -m tidemark.cli --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from tidemark.engine import Database
from tidemark.sources.output import json_rows


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    top.add_argument("--root", required=True, help="the database's folder, in any store that Spark reads")
    top.add_argument("--now-us", type=int, help="the time to go by; the clock's otherwise")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, **arguments: dict[str, Any]) -> None:
        p = sub.add_parser(name)
        for a, settings in arguments.items():
            p.add_argument(a if settings.pop("place", False) else f"--{a}", **settings)

    for name in ("init", "status", "checkpoint", "maintain", "compact", "remote-head"):
        command(name, **({"remote": {"required": name == "remote-head"}} if name in ("maintain", "remote-head") else {}))
    command("create", table={"place": True}, config={"help": "a JSON file of settings"})
    command("write", document={"place": True, "help": "a JSON file {table, request_id, rows}"})
    command("query", sql={"place": True})
    command("scan", table={"place": True}, start={"type": int}, end={"type": int}, tenant={}, series={})
    command("rollups", table={"place": True}, width={"type": int}, start={"type": int}, end={"type": int}, tenant={}, series={})
    for name in ("ship", "restore", "vacuum-remote"):
        command(name, remote={"required": True})
    command("recover-remote-lock", remote={"required": True}, token={"required": True})
    command("metrics")
    return top


def run(spark: SparkSession, argv: list[str]) -> Any:
    """What a command prints, as JSON values."""
    a = parser().parse_args(argv)
    now = a.now_us if a.now_us is not None else time.time_ns() // 1000
    rows = json_rows
    if a.command == "restore":
        return Database.restore(spark, a.remote, a.root).status()
    db = Database(spark, a.root)
    match a.command:
        case "init" | "status":
            return db.status()
        case "create":
            return {"sequence": db.create_table(a.table, json.loads(Path(a.config).read_text()) if a.config else {})}
        case "write":
            document = json.loads(Path(a.document).read_text())
            return db.write(document["table"], document["request_id"], document["rows"], now)
        case "query":
            return db.fetch(a.sql, now)
        case "scan":
            return rows(db.scan(a.table, a.start, a.end, a.tenant, a.series))
        case "rollups":
            return rows(db.rollups(a.table, width_us=a.width, tenant=a.tenant, series=a.series, start_us=a.start, end_us=a.end, ordered=True))
        case "checkpoint":
            return {"tables": db.checkpoint()}
        case "maintain":
            return db.maintain(now, a.remote)
        case "compact":
            return {"groups": db.compact()}
        case "ship":
            return {"sequence": db.ship(a.remote)}
        case "vacuum-remote":
            return {"deleted": db.vacuum_remote(a.remote)}
        case "recover-remote-lock":
            return {"recovered": db.recover_remote_lock(a.remote, a.token)}
        case "metrics":
            return db.metrics()
        case "remote-head":
            return Database(spark, a.remote).status()


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(run(session, sys.argv[1:]), default=str))
