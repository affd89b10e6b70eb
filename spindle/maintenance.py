"""When to build again: fingerprints of inputs, polling, and plug-ins that bring sources of their own."""

from __future__ import annotations

import time
from collections.abc import Callable
from importlib.metadata import entry_points
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Source = Callable[..., tuple[DataFrame, DataFrame]]
_sources: dict[str, Source] = {}


def fingerprint(spark: SparkSession, *folders: str) -> str:
    """SHA-256 over the sorted names and digests of all files below the folders; contents are hashed where they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders))
    each = files.select(F.concat_ws(" ", "path", F.sha2("content", 256)).alias("line"))
    # two levels: digests of buckets by name, then one line of them
    buckets = each.groupBy(F.pmod(F.xxhash64("line"), F.lit(256)).alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"))
    return buckets.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "bucket", "digest"))), "\n"), 256).alias("f")).first()["f"]


def up_to_date(spark: SparkSession, stamp: str, *folders: str) -> bool:
    """Whether the fingerprint stored in the file ``stamp`` is still the inputs' one."""
    path = Path(stamp)
    return path.exists() and path.read_text() == fingerprint(spark, *folders)


def mark(spark: SparkSession, stamp: str, *folders: str) -> None:
    Path(stamp).write_text(fingerprint(spark, *folders))


def watch(spark: SparkSession, stamp: str, folders: list[str], build: Callable[[], None], interval: float = 5.0, rounds: int | None = None) -> int:
    """Build whenever the inputs changed since the last time; returns how often that was. A build that fails is tried again next time."""
    built = 0
    while rounds is None or rounds > 0:
        if not up_to_date(spark, stamp, *folders):
            build()
            mark(spark, stamp, *folders)
            built += 1
        rounds = rounds - 1 if rounds is not None else None
        if rounds is None or rounds > 0:
            time.sleep(interval)
    return built


def install_hook(repository: str, command: str) -> Path:
    """A git hook that runs ``command`` after each commit; an existing one of another make is left alone."""
    path = Path(repository) / ".git" / "hooks" / "post-commit"
    if path.exists() and "# spindle" not in path.read_text():
        raise FileExistsError(path)
    path.write_text(f"#!/bin/sh\n# spindle\n{command}\n")
    path.chmod(0o755)
    return path


def register(name: str, source: Source) -> None:
    """A source of the user's own: a function from a session and options to (nodes, edges)."""
    _sources[name] = source


def plugins(group: str = "spindle.sources") -> dict[str, Source]:
    """Registered sources and those of installed packages; a package that can't be loaded is left out, the others still work."""
    out = dict(_sources)
    for point in entry_points(group=group):
        try:
            out.setdefault(point.name, point.load())
        except Exception:  # someone else's package: it must not take the rest with it
            continue
    return out


def run_source(spark: SparkSession, name: str, **options) -> tuple[DataFrame, DataFrame]:
    found = plugins()[name](spark, **options)
    if not (isinstance(found, tuple) and len(found) == 2 and all(isinstance(f, DataFrame) for f in found)):
        raise TypeError(f"source {name} has to return (nodes, edges)")
    return found
