"""Command line over a store's files: python -m sigloom ls, cp, mv, ln, mirror, ringbuffer or watch."""

from __future__ import annotations

import argparse
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.timebase import EPOCH, parse_time
from sigloom.operators import catalog, watching
from sigloom.session import prepare


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sigloom", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb in ("ls", "cp", "mv", "ln", "mirror", "ringbuffer", "watch"):
        v = verbs.add_parser(verb)
        v.add_argument("root")
        if verb in ("cp", "mv", "ln", "mirror"):
            v.add_argument("target")
        v.add_argument("--channel", help="files of one channel")
        v.add_argument("--start", help="first time: UTC seconds, ISO-8601 or now")
        v.add_argument("--end", help="last time, included")
        for kind in ("data", "metadata", "properties"):
            v.add_argument(f"--no-{kind}", dest=kind, action="store_false")
        if verb == "ls":
            v.add_argument("--reverse", action="store_true", help="last first")
        if verb == "mirror":
            v.add_argument("--method", choices=("copy", "move", "link"), default="copy", help="for data files; others are copied")
            v.add_argument("--ignore-existing", action="store_true", help="send only properties and the metadata that still applies")
        if verb == "ringbuffer":
            v.add_argument("--count", type=int, help="files of a channel")
            v.add_argument("--duration", type=int, help="ms before a channel's newest file")
            v.add_argument("--size", type=int, help="bytes in all")
            v.add_argument("--dry-run", action="store_true", help="tell what would go")
        if verb == "watch":
            v.add_argument("--seconds", type=float, default=5.0, help="between two listings")
            v.add_argument("--rounds", type=int, help="listings to compare; without, until stopped")
            v.add_argument("--state", help="shared folder that keeps the last listing")
    return out


def _millis(text: str | None) -> int | None:
    at = parse_time(text)
    return None if at is None else int((at.replace(tzinfo=at.tzinfo or EPOCH.tzinfo) - EPOCH).total_seconds() * 1000)


def chosen(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The files that a command line's options name; those without a time pass its bounds."""
    files = catalog.of_kinds(listing(spark, a.root), a.data, a.metadata, a.properties)
    files = files if a.channel is None else files.where(F.col("grp") == a.channel)
    return catalog.in_time(files, _millis(a.start), _millis(a.end))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: spark.checkpoint.dir, or a local one where there is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sigloom-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All files under root, listed once."""
    return watching.walk(spark, root, scratch(spark))


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """The lines that a command prints. Listings reach the driver in pieces as they are printed; files stay with the executors."""
    a = parser().parse_args(argv)
    if a.verb == "ls":
        return [r["path"] for r in catalog.in_order(chosen(spark, a), a.reverse).select("path").toLocalIterator()]
    if a.verb in ("cp", "mv", "ln"):
        return [f"{catalog.transfer(chosen(spark, a), a.root, a.target, a.verb == 'mv', a.verb == 'ln')} files"]
    if a.verb == "mirror":
        return [f"{watching.mirror(chosen(spark, a), a.root, a.target, listing(spark, a.target), a.method, a.ignore_existing)} files"]
    if a.verb == "ringbuffer":
        a.properties = False
        files = chosen(spark, a).withColumn("grp", catalog.group_of(F.col("path")))
        gone = catalog.expired(files, a.count, a.duration, a.size)
        if a.dry_run:
            return [r["path"] for r in catalog.in_order(gone).select("path").toLocalIterator()]
        return [f"{catalog.remove(gone)} files"]
    return list(watch(spark, a))


def watch(spark: SparkSession, a: argparse.Namespace):
    """Lines (event, path) of what changes between one listing and the next; with --state it goes on where another run ended."""
    state, k = a.state or scratch(spark), 0
    watcher = watching.Watcher(spark, state, existing=False)
    while True:
        lines: list[str] = []

        def tell(told: DataFrame, lines: list[str] = lines) -> None:
            lines += [" ".join(filter(None, (r["event"], r["path"], r["dest"] and f"to {r['dest']}"))) for r in told.orderBy("path").toLocalIterator()]

        # a state keeps all files, so that other bounds do not look like deletions
        watcher.poll(listing(spark, a.root), lambda told, tell=tell: tell(watching.wanted(told, _millis(a.start), _millis(a.end), a.data, a.metadata, a.properties)))
        yield from lines
        k += 1
        if a.rounds is not None and k > a.rounds:
            return
        time.sleep(a.seconds)


def main(argv: list[str] | None = None) -> None:
    import sys

    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    spark = prepare(SparkSession.builder.appName("sigloom").getOrCreate())
    for line in watch(spark, a) if a.verb == "watch" else run(spark, argv):
        print(line, flush=True)


if __name__ == "__main__":
    main()
