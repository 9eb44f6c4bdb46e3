"""Command line: init, capture, inspect, dev, test.  Errors end with the exit code of their class."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from ..errors import CaptureError, ConfigError, InputOutputError
from . import config as settings
from . import inspect

FIXTURES = ".millrace/fixtures"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--log-level", default="info")
    p.add_argument("--log-format", default="json", choices=["json", "text"])
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init", help="make a project folder")
    init.add_argument("--output", default=".")
    init.add_argument("--force", action="store_true")
    for name in ("host", "dbname", "user", "password", "slot", "publication"):
        init.add_argument(f"--{name}")
    init.add_argument("--port", type=int)
    init.add_argument("--tables", nargs="*", default=[])
    for name in ("capture", "dev"):
        c = sub.add_parser(name, help="snapshot tables of a folder of Parquet files and follow payloads" if name == "capture" else "the same, printing events")
        c.add_argument("--config", default=".millrace/config.toml")
        c.add_argument("--data", help="folder of Parquet tables, one each")
        c.add_argument("--keys", default="{}", help='JSON: table -> list of key columns')
        c.add_argument("--payloads", help="folder of payload files (slot, seq, payload)")
        c.add_argument("--output", help="folder for the events")
        c.add_argument("--from-lsn")
        c.add_argument("--no-snapshot", action="store_true")
        c.add_argument("--ts-ms", type=int, default=0)
    i = sub.add_parser("inspect", help="types of tables")
    i.add_argument("--data", required=True)
    i.add_argument("--tables", nargs="*", default=[])
    i.add_argument("--format", choices=["typescript", "json"], default="typescript")
    i.add_argument("--output", default="-")
    t = sub.add_parser("test", help="check fixture files")
    t.add_argument("--list", action="store_true")
    t.add_argument("--file")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def tables_in(spark, data: str, names: list[str]) -> dict:
    """Frames of the folder's tables, by name."""
    from ..sources.snapshot import select_tables

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))
    missing = sorted(set(n.split(".")[-1] for n in names) - set(known))
    if missing:
        raise ConfigError(f"no such tables: {', '.join(missing)}")
    return {n: spark.read.parquet(f"{data}/{n.split('.')[-1]}.parquet") for n in select_tables(names, known)}


def init(args) -> None:
    root = Path(args.output) / ".millrace"
    for folder in (root, root / "types", root / "fixtures"):
        folder.mkdir(parents=True, exist_ok=True)
    source = settings.section(settings.Source, {k: v for k, v in {"host": args.host, "port": args.port, "dbname": args.dbname, "user": args.user, "password": args.password, "slotName": args.slot, "publication": args.publication, "tables": args.tables}.items() if v})
    made = settings.Config(source, *(kind() for kind in settings.SECTIONS.values()))
    path = root / "config.toml"
    if path.exists() and not args.force:
        raise ConfigError(f"{path} already exists. Use --force to overwrite.")
    path.write_text(settings.as_toml(made))
    os.chmod(path, 0o600)
    for name, text in (("schema.py", BOILERPLATE), (".gitignore", "config.toml\nstate/\n")):
        if args.force or not (root / name).exists():
            (root / name).write_text(text)
    print(f"Project made in {root}")


BOILERPLATE = '''"""Where a capture begins: see millrace.streaming.capture."""

from millrace.operators.predicates import op_is_not
from millrace.operators.transforms import Filter, Pipeline

pipeline = Pipeline([Filter(op_is_not("d"))])
'''


def located(path: str) -> str:
    """A path for Spark: one without a scheme is of this process's folder."""
    return path if "://" in path else os.path.abspath(path)


def capture(args, show: bool = False) -> None:
    from ..operators.pgoutput import decode
    from ..sources.files import read_payloads
    from ..sources.snapshot import snapshot_tables
    from ..streaming.state import StateStore, start_position

    made = settings.load(args.config)
    spark, output = session(), located(args.output or "events")
    store = StateStore(spark, located(made.state.path))
    last = store.last_offset()
    start = start_position(args.from_lsn or made.capture.from_lsn, last["lsn"] if last else None)
    if args.data and made.capture.snapshot and not args.no_snapshot:
        names = made.snapshot.tables or made.source.tables
        frames, keys = tables_in(spark, args.data, names), json.loads(args.keys)
        left = store.tables_to_read(list(frames))
        for name in left:
            events = snapshot_tables({name: (frames[name], keys.get(name, []))}, made.source.dbname, args.ts_ms, start)
            events.show(20, truncate=100) if show else events.write.mode("append").parquet(output)
            store.write_progress(name, None, frames[name].count(), True)
    if args.payloads:
        events = decode(read_payloads(spark, args.payloads), made.source.dbname)
        events.show(20, truncate=100) if show else events.write.mode("append").parquet(f"{output}-stream")
        end = events.filter("error is null").agg({"lsn": "max"}).first()[0]
        store.write_offset(end or start, is_final=True, adapter="pgoutput")


def run(args) -> None:
    if args.command == "init":
        init(args)
    elif args.command in ("capture", "dev"):
        capture(args, show=args.command == "dev")
    elif args.command == "inspect":
        from ..streaming.sinks import write_text

        tables = {n: inspect.columns_of(df.schema) for n, df in tables_in(session(), args.data, args.tables).items()}
        write_text(inspect.typescript(tables) if args.format == "typescript" else inspect.json_schema_text(tables), args.output)
    elif args.command == "test":
        from ..sources.files import check_fixture

        if args.list:
            folder = Path(FIXTURES)
            for path in sorted(folder.glob("*.json")) if folder.exists() else []:
                print(f"{path.name} ({path.stat().st_size} bytes)")
        elif args.file:
            event = check_fixture(args.file)
            s = event["source"]
            print(f"{args.file}: op={event['op']}, table={s['schema']}.{s['table']}, lsn={s.get('lsn') or 'N/A'}")
        else:
            print("millrace test --list | --file PATH")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args)
    except CaptureError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    except OSError as e:
        print(InputOutputError(str(e)), file=sys.stderr)
        return InputOutputError.exit_code
    return 0
