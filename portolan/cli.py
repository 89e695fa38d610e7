"""Command line: scan, audit, copy, stats, flush, mirror, search-indexes, create-database."""

from __future__ import annotations

import argparse
import json
import sys

from .session import session


def _spec(path: str):
    from .plans.tables import ColumnSpec, TableSpec

    with open(path) as f:
        tables = json.load(f)
    return [TableSpec(t["name"], tuple(ColumnSpec(**c) for c in t.get("columns", [])), tuple(t.get("key", [])), tuple(map(tuple, t.get("unique", []))), tuple(map(tuple, t.get("references", [])))) for t in tables]


def _mirror(spark, args) -> tuple[list[dict], bool]:
    from pyspark.sql import functions as F

    from .operators import quality
    from .operators.mirror import Mirror, MirrorSpec
    from .sources.store import SnapshotStore

    with open(args.spec) as f:
        given = json.load(f)
    if given.get("keep"):
        given["keep"] = F.expr(given["keep"])
    store, spec = SnapshotStore(spark, args.store), MirrorSpec(**given)
    mirror = Mirror(spec, store, lambda: store.read(spec.owner))
    rows, failed = [], False
    if args.action == "flush":
        mirror.flush()
        return [{"mirror": spec.mirror, "status": "flushed"}], False
    if args.action in ("schema", "sync"):
        plan = spec.schema_plan(store.read(spec.owner), store.read(spec.mirror).schema if store.exists(spec.mirror) else None)
        plan.apply(store)
        rows += [{"schema": x} for x in [*plan.sql(), *plan.notes]]
    if args.action in ("data", "sync"):
        written, removed = mirror.backfill(args.since)
        mirror.prune()
        rows.append({"written": written, "removed": removed})
    if args.action in ("stats", "sync"):
        owner = spec.shaped(store.read(spec.owner) if spec.keep is None else store.read(spec.owner).where(spec.keep))
        found, failed = quality.report(owner, mirror.read(), spec.key)
        rows += [r.asDict() for r in found.collect()]
    return rows, failed


def _search_indexes(spark, args) -> list[dict]:
    from .sources.search_index import FullTextIndexes
    from .sources.store import SnapshotStore

    indexes = FullTextIndexes(SnapshotStore(spark, args.store))
    rows = []
    for columns in (c.split(",") for c in args.columns):
        there = [i for i in indexes.of(args.table) if {*i.columns} == {*columns}]
        status = "ok" if there else "missing"
        if there and args.rebuild:
            indexes.rebuild(there[0].name)
            status = "rebuilt"
        elif not there and args.apply:
            there, status = [indexes.create(args.table, args.key, columns)], "made"
        rows.append({"table": args.table, "columns": ",".join(columns), "index": there[0].name if there else None, "status": status})
    listed = {r["index"] for r in rows}
    return rows + [{"table": args.table, "columns": ",".join(i.columns), "index": i.name, "status": "other"} for i in indexes.of(args.table) if i.name not in listed]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="portolan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", help="find database-specific SQL in source code")
    one.add_argument("paths", nargs="+")
    one.add_argument("--target", action="append", default=[])
    one = commands.add_parser("audit", help="check a store's data against table specifications")
    one.add_argument("source")
    one.add_argument("spec")
    one = commands.add_parser("copy", help="copy tables between stores")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("spec")
    one.add_argument("--sample", type=int)
    one.add_argument("--resume", action="store_true")
    one.add_argument("--dry-run", action="store_true")
    one = commands.add_parser("stats", help="compare a table of two stores")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("table")
    one.add_argument("--key", default="id")
    one = commands.add_parser("flush", help="empty a table of a store")
    one.add_argument("store")
    one.add_argument("table")
    one = commands.add_parser("mirror", help="schema, data, stats or all of them (sync) of a mirror")
    one.add_argument("action", choices=["schema", "data", "stats", "sync", "flush"])
    one.add_argument("store")
    one.add_argument("spec", help="JSON of owner, mirror, key, owner_key, version and keep (an SQL predicate)")
    one.add_argument("--since")
    one = commands.add_parser("search-indexes", help="full-text indexes of a store's table: those there, and those to be made")
    one.add_argument("store")
    one.add_argument("table")
    one.add_argument("--key", default="id")
    one.add_argument("--columns", action="append", default=[], help="comma-separated columns to be searched together")
    one.add_argument("--apply", action="store_true")
    one.add_argument("--rebuild", action="store_true")
    one = commands.add_parser("create-database")
    one.add_argument("name")
    for p in commands.choices.values():
        p.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    spark = session()
    from .operators import quality, scanner
    from .sources import scans
    from .sources.store import SnapshotStore

    failed = False
    if args.command == "scan":
        rows = [r.asDict() for r in scanner.scan(spark, args.paths, tuple(args.target)).orderBy("file", "line").collect()]
        failed = bool(rows)
    elif args.command == "audit":
        store, specs = SnapshotStore(spark, args.source), _spec(args.spec)
        found = quality.audit(spark, {s.name: store.read(s.name) for s in specs if store.exists(s.name)}, {s.name: s for s in specs})
        rows = [r.asDict() for r in found.orderBy("table", "column").collect()]
        failed = bool(rows)
    elif args.command == "copy":
        results = scans.copy(SnapshotStore(spark, args.source), SnapshotStore(spark, args.target), _spec(args.spec), sample=args.sample, resume=args.resume, dry_run=args.dry_run)
        rows = [r.__dict__ for r in results]
        failed = any(r.status.startswith(("failed", "incomplete")) for r in results)
    elif args.command == "stats":
        found, failed = quality.report(SnapshotStore(spark, args.source).read(args.table), SnapshotStore(spark, args.target).read(args.table), args.key)
        rows = [r.asDict() for r in found.collect()]
    elif args.command == "mirror":
        rows, failed = _mirror(spark, args)
    elif args.command == "search-indexes":
        rows = _search_indexes(spark, args)
        failed = any(r["status"] == "missing" for r in rows)
    elif args.command == "flush":
        SnapshotStore(spark, args.store).flush(args.table)
        rows = [{"table": args.table, "status": "flushed"}]
    else:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{args.name.replace('`', '``')}`")
        rows = [{"database": args.name, "status": "created"}]
    if args.json:
        print(json.dumps(rows, indent=2, default=str, ensure_ascii=False))
    else:
        for r in rows:
            print("  ".join(f"{k}={v}" for k, v in r.items()))
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
