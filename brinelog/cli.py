"""Command line of a store: ``python -m brinelog.cli COMMAND``.

Exit code 2 for arguments that can't be used, 1 for other errors.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from . import config, errors
from .sources import runs
from .store import Log, Store, Trace


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("brinelog").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brinelog")
    p.add_argument("--config", default="config/default.json")
    p.add_argument("--log-level", choices=sorted(config.LEVELS))
    p.add_argument("--data-dir")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, **options: dict) -> None:
        c = commands.add_parser(name, help=about)
        for flag, how in options.items():
            c.add_argument(f"--{flag.replace('_', '-')}", **how)

    need, number = {"required": True}, {"type": int}
    add("init", "make the folders and show the settings")
    add("put", "write a key", key=need, value=need)
    add("get", "read a key", key=need)
    add("del", "delete a key", key=need)
    add("scan", "list live keys in order", low={"default": ""}, high={"default": "\U0010ffff"}, limit=number | {"default": 20})
    add("probe", "read one key, or absent keys, again and again", key={}, repeat=number | {"default": 1}, absent=number)
    add("stats", "what the store holds", json={"action": "store_true"}, full={"action": "store_true"})
    add("metrics", "counters and gauges as text")
    add("manifest-info", "epoch and live runs")
    add("version-info", "the current version")
    add("list-sst", "live runs")
    add("sst-info", "facts about one run", file=need)
    add("verify-sst", "check one run, or all", file={})
    add("flush-now", "write memory as runs")
    add("compaction-run", "compact runs the picker, or you, choose", files={})
    add("compaction-stats", "backlog and last job")
    add("compaction-pause", "no more compactions of its own accord")
    add("compaction-resume", "allow them again")
    add("wal-verify", "read the log without changing it")
    add("wal-truncate", "cut a log segment", segment=number | need, offset=number | need)
    add("bg-status", "workers and queues")
    add("stress", "random reads and writes", threads=number | {"default": 4}, ops=number | {"default": 50}, read_pct=number | {"default": 50})
    add("doctor", "collect a bundle for support", bundle={"default": "doctor.zip"})
    add("serve", "read commands from stdin and answer HTTP", addr={})
    add("repl", "read commands from stdin")
    add("close", "open and close cleanly")
    add("shutdown", "finish work, or stop at once", fast={"action": "store_true"})
    return p


def run_id(text: str) -> int:
    """101, 000101 and 000101.sst all mean run 101."""
    try:
        return int(text.strip().removesuffix(".sst"))
    except ValueError as e:
        raise errors.InvalidArgument(f"{text!r} is no run") from e


def show(data: dict) -> None:
    for k, v in data.items():
        print(f"{k}: {v}")


def http_answer(store: Store, path: str) -> tuple[int, str]:
    """Status and body of a GET request."""
    if path == "/healthz":
        return 200, "ok"
    if path == "/readyz":
        ready = store.is_open and store.worker is not None
        return (200, "ready") if ready else (503, "not ready")
    if path == "/metrics" and store.config.metrics_enabled:
        return 200, store.metrics()
    if path == "/stats":
        return 200, json.dumps(store.stats())
    return 404, "not found"


def serve(store: Store, addr: str) -> ThreadingHTTPServer:
    host, _, port = addr.rpartition(":")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = http_answer(store, self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host or "127.0.0.1", int(port)), Handler)


def bundle(store: Store, path: str) -> None:
    """Settings, manifest, statistics and the end of the log, zipped."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("config.txt", store.config.text())
        z.writestr("stats.json", json.dumps(store.stats(), indent=1))
        z.writestr("metrics.txt", store.metrics())
        if os.path.exists(store.config.manifest_file):
            z.write(store.config.manifest_file, "manifest.json")
        for n in store.wal.segments()[-1:]:
            with open(store.wal.name(n), "rb") as f:
                f.seek(max(0, os.path.getsize(store.wal.name(n)) - (64 << 10)))
                z.writestr("log_tail.bin", f.read())


def repl(store: Store) -> None:
    """put KEY VALUE, get KEY, del KEY, flush, compact, stats, quit."""
    for line in sys.stdin:
        words = line.split()
        if not words:
            continue
        try:
            match words:
                case ["put", key, value]:
                    print(store.put(key, value))
                case ["get", key]:
                    print(store.get(key) or "NOT FOUND")
                case ["del", key]:
                    print(store.delete(key))
                case ["flush"]:
                    print(store.flush())
                case ["compact"]:
                    print(store.compact())
                case ["stats"]:
                    show(store.stats())
                case ["quit" | "exit"]:
                    return
                case _:
                    print("put KEY VALUE | get KEY | del KEY | flush | compact | stats | quit")
        except errors.StoreError as e:
            print(f"{type(e).__name__}: {e}")


def act(args: argparse.Namespace, store: Store) -> None:
    c = args.command
    match c:
        case "init":
            print(store.config.text())
        case "put":
            print(f"seqno {store.put(args.key, args.value)}")
        case "get":
            trace = Trace()
            value = store.get(args.key, trace)
            logging.getLogger("brinelog").debug("%s", trace)
            print("NOT FOUND" if value is None else value)
        case "del":
            print(f"seqno {store.delete(args.key)}")
        case "scan":
            for r in store.scan(args.low, args.high, args.limit).toLocalIterator():
                print(r["key"], r["value"], sep="\t")
        case "probe":
            if args.absent:
                keys = store.spark.range(args.absent).selectExpr("concat('absent-', id, '-', hash(id)) AS key")
                print(f"probed {args.absent}, found {store.multi_get(keys).where('found').count()}")
            elif args.key:
                for _ in range(args.repeat):
                    value = store.get(args.key)
                print(f"probed {args.key} {args.repeat} times: {'NOT FOUND' if value is None else value}")
            else:
                raise errors.InvalidArgument("probe needs --key or --absent")
        case "stats":
            s = store.stats()
            print(json.dumps(s)) if args.json else show(s if args.full else dict(list(s.items())[:10]))
        case "metrics":
            print(store.metrics(), end="")
        case "manifest-info" | "version-info" | "list-sst":
            if c != "list-sst":
                print(f"epoch {store.version.epoch}, version {store.version_id}, next run {store.version.next_id}, waiting memtables {len(store.queue)}")
            for r in store.version.runs:
                print(f"{r.file_name}: {r.entries} entries, {r.file_size} bytes, keys {r.min_key!r} to {r.max_key!r}, seqno {r.min_seqno} to {r.max_seqno}")
        case "sst-info":
            path = os.path.join(store.config.runs_dir, f"{run_id(args.file):06d}.sst")
            for r in runs.inspect_run(store.spark, path).toLocalIterator():
                show(r.asDict())
        case "verify-sst":
            if args.file:
                print(f"OK, {runs.verify_run(store.spark, os.path.join(store.config.runs_dir, f'{run_id(args.file):06d}.sst'))} entries")
            else:
                show(store.verify())
        case "flush-now":
            print(f"runs {store.flush()}")
        case "compaction-run":
            job = store.compact([run_id(x) for x in args.files.split(",")] if args.files else None)
            print("nothing to compact") if job is None else show(job)
        case "compaction-stats":
            show({"backlog_bytes": store.stats()["compaction_backlog_bytes"], "paused": store.version.paused, "last_job": store.version.last_job})
        case "compaction-pause" | "compaction-resume":
            store.pause(c == "compaction-pause")
        case "bg-status":
            s = store.stats()
            show({k: s[k] for k in ("workers_running", "immutables", "compaction_backlog_bytes", "flushes", "compactions", "versions", "stalls", "compaction_paused")})
        case "stress":
            store.start_background()
            show(store.stress(args.threads, args.ops, args.read_pct))
        case "doctor":
            bundle(store, args.bundle)
            print(args.bundle)
        case "serve" | "repl":
            store.start_background()
            server = serve(store, args.addr or store.config.http_listen_addr) if c == "serve" else None
            if server:
                import threading

                threading.Thread(target=server.serve_forever, daemon=True).start()
            repl(store)
            if server:
                server.shutdown()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    explicit = {k: v for k, v in (("data_dir", args.data_dir), ("log_level", args.log_level)) if v}
    try:
        settings = config.load(args.config, **explicit)
        logging.basicConfig(level=settings.log_level.upper().replace("WARN", "WARNING"))
        if args.command == "wal-verify":
            os.makedirs(settings.log_dir, exist_ok=True)
            show(Log(settings.log_dir, 1, 1, lambda p: None).recover(repair=False)[1])
            return 0
        if args.command == "wal-truncate":
            path = os.path.join(settings.log_dir, f"{args.segment:06d}.wal")
            if not os.path.exists(path) or not 0 <= args.offset <= os.path.getsize(path):
                raise errors.InvalidArgument("no such segment, or the offset lies outside it")
            os.truncate(path, args.offset)
            return 0
        store = Store(session(), settings)
        report = store.open()
        if args.command in ("init", "stats"):
            logging.getLogger("brinelog").info("recovered %s", report)
        try:
            act(args, store)
        finally:
            store.close(graceful=args.command in ("close", "shutdown", "stress", "serve", "repl") and not getattr(args, "fast", False))
    except errors.InvalidArgument as e:
        print(f"InvalidArgument: {e}", file=sys.stderr)
        return 2
    except errors.StoreError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
