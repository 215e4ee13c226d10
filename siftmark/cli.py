"""sync, scan, list and clear from a shell: python -m siftmark.cli --db FOLDER COMMAND. A server is the folder of its store."""

from __future__ import annotations

import argparse
import json
import socket
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import library, scanning
from .operators.store import Store
from .sources.files import read_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftmark")
    p.add_argument("--db", default="siftmark_db", help="folder of this host's store")
    commands = p.add_subparsers(dest="command", required=True)
    sync = commands.add_parser("sync", help="fetch rules, fingerprints and labels")
    sync.add_argument("--server", required=True)
    scan = commands.add_parser("scan", help="scan a folder or a file")
    scan.add_argument("--path", required=True)
    scan.add_argument("--server")
    scan.add_argument("--no-sync", action="store_true")
    scan.add_argument("--json", action="store_true")
    scan.add_argument("--report", action="store_true")
    scan.add_argument("--host-id", default=socket.gethostname())
    tags = commands.add_parser("list", help="show tags")
    tags.add_argument("--sensitive-only", action="store_true")
    tags.add_argument("--json", action="store_true")
    commands.add_parser("clear", help="remove all tags")
    return p


def sync(local: Store, server: Store) -> dict:
    """Brings a host's copy to the server's version: what the answer deletes goes, what it has replaces rows of the same key. Returns what came."""
    snap = local.manifest()
    got = server.sync(snap["version"])
    full = got["full_sync"]
    tables = {"rules": library.apply(local.table("rules", snap), got["rules"], got["deleted"], full)}
    for name in ("fingerprints", "features"):
        new = got[name]
        tables[name] = new if full else local.table(name, snap).join(new, "sensitive_file_id", "left_anti").unionByName(new)
    counts = {"rules_count": got["rules"].count(), "deleted_rules_count": got["deleted"].count(), "fingerprints_count": got["fingerprints"].count(), "semantic_labels_count": got["features"].count()}
    updated = full or any(counts.values()) or got["version"] > snap["version"] or got["config"] != snap["config"]
    version = local.commit(snap, tables, "sync", library_version=got["version"], config=got["config"]) if updated else snap["version"]
    return {"version": version, "updated": updated} | counts


def library_of(store: Store) -> scanning.Library:
    """What a host scans with, of one snapshot of its store."""
    snap = store.manifest()
    live, config = store.table("rules", snap).where("enabled AND NOT deleted"), snap["config"]
    return scanning.Library(scanning.rule_list(live), store.table("fingerprints", snap), store.table("features", snap), config["simhash_threshold"], config["semantic_label_hints"])


def shown(rows: DataFrame, as_json: bool) -> None:
    """Prints row by row, without holding all of them."""
    if not as_json:
        rows.select("file_path", "confidence_level", "match_score", "risk_level", "sensitive_type").show(50, 60)
        return
    for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(r.j)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs one command and returns its counts."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("siftmark").getOrCreate()
    local = Store(spark, a.db)
    if a.command == "sync":
        counts = sync(local, Store(spark, a.server))
        print(json.dumps(counts))
        return counts
    if a.command == "list":
        shown(local.list_tags(a.sensitive_only), a.json)
        return {}
    if a.command == "clear":
        local.clear_tags()
        return {}
    server = Store(spark, a.server) if a.server else None
    if server and not a.no_sync:
        sync(local, server)
    found = scanning.scan_files(read_tree(spark, a.path), library_of(local)).withColumnRenamed("path", "file_path")
    staged = f"{local.root}/_staged/{uuid.uuid4().hex}"
    found.write.parquet(staged)  # read by the tags, the report and the screen
    found = spark.read.parquet(staged)
    local.tag(found)
    shown(found, a.json)
    if a.report and server:
        server.report(found, a.host_id, a.path, datetime.now(UTC).isoformat(timespec="seconds"))
    counts = scanning.summary(found).first().asDict()
    print(json.dumps(counts))
    local.fs.delete(local._path(staged), True)
    return counts


if __name__ == "__main__":
    main()
