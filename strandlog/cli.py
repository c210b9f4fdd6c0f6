"""Command line: info, topics, publish, subscribe, ack, trim."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from strandlog import __version__, errors
from strandlog import model as M
from strandlog.config import duration_ms, load
from strandlog.workspace import new_path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlog")
    p.add_argument("--config", help="a JSON or YAML file")
    p.add_argument("--version", action="version", version=f"strandlog {__version__}")
    p.add_argument("--data-dir")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("info")
    topics = commands.add_parser("topics").add_subparsers(dest="action", required=True)
    create = topics.add_parser("create")
    create.add_argument("topic")
    create.add_argument("--max-message-bytes", type=int, default=0)
    create.add_argument("--retention", default="0")
    create.add_argument("--retention-bytes", type=int, default=0)
    create.add_argument("--cleanup", default="delete")
    topics.add_parser("list")
    topics.add_parser("delete").add_argument("topic")
    publish = commands.add_parser("publish")
    publish.add_argument("topic")
    publish.add_argument("-m", "--message", action="append")
    publish.add_argument("-k", "--key", default="")
    subscribe = commands.add_parser("subscribe")
    subscribe.add_argument("topic")
    subscribe.add_argument("--consumer", default="")
    subscribe.add_argument("--start", type=int)
    subscribe.add_argument("--limit", type=int, default=0)
    subscribe.add_argument("--follow", action="store_true", help="go on as records are published")
    subscribe.add_argument("--timeout", default="0", help="with --follow: end after this time; 0 never does")
    subscribe.add_argument("--checkpoint", help="with --follow: where progress is kept, to go on from there")
    ack = commands.add_parser("ack")
    for name in ("consumer", "topic"):
        ack.add_argument(name)
    ack.add_argument("offset", type=int)
    commands.add_parser("trim").add_argument("topic")
    return p


def lines(rows):
    """Offset, time and payload of each record, by tabs."""
    for r in rows.orderBy("offset").toLocalIterator():
        at = datetime.fromtimestamp(r["timestamp_ms"] / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        yield f"{r['offset']}\t{at}\t{bytes(r['payload']).decode(errors='replace')}"


def run(argv: list[str], spark=None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    from strandlog.engine import Engine

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("strandlog").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        config = load(args.config)
        engine = Engine(spark, args.data_dir or config.data_dir, config).start()
        say = lambda *x: print(*x, file=out)
        if args.command == "info":
            for k, v in engine.info().first().asDict().items():
                say(f"{k}\t{v}")
        elif args.command == "topics" and args.action == "create":
            say(engine.create_topic(args.topic, M.TopicConfig(args.max_message_bytes, int(duration_ms(args.retention)), args.retention_bytes, args.cleanup)).name)
        elif args.command == "topics" and args.action == "list":
            for r in engine.topics().collect():
                say(r["name"])
        elif args.command == "topics":
            engine.delete_topic(args.topic)
        elif args.command == "publish":
            bodies = args.message or ([sys.stdin.read()] if not sys.stdin.isatty() else [])
            first, end = engine.publish(args.topic, [{"key": args.key, "payload": b} for b in bodies])
            say(*range(first, end))
        elif args.command == "subscribe" and args.follow:
            emit = lambda rows, _: [print(line, file=out, flush=True) for line in lines(rows)]
            query = engine.subscribe(args.topic, emit, args.checkpoint or new_path(spark, "progress"), args.consumer, args.start, follow=True)
            try:
                query.awaitTermination(*([duration_ms(args.timeout) / 1000] if duration_ms(args.timeout) > 0 else []))
            finally:
                query.stop()
        elif args.command == "subscribe":
            for line in lines(engine.read(args.topic, engine.start_position(args.topic, args.consumer, args.start), args.limit)):
                say(line)
        elif args.command == "ack":
            say(engine.ack(args.consumer, args.topic, args.offset))
        elif args.command == "trim":
            done = engine.trim(args.topic)
            say(done.segments, done.bytes)
        engine.stop()
        return 0
    except Exception as error:
        print("%s: %s" % errors.status_of(error), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
