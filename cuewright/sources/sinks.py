"""Named text files written by tasks, on any file system that Spark writes to.

The tasks write each file whole into a hidden folder beside the targets.  When all have, each file is
renamed to its name, so a task that fails leaves nothing.  On mounted file systems tasks rename, and the
manifest is a table; on other stores the driver renames and handles names and sizes, never texts.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.session import kept
from cuewright.sources.store import URI, Store, is_uri, joined, mounted

RENAMES_AT_ONCE = 16
MANIFEST = "ord long, path string, n long"


def write_files(rows: DataFrame, home: str) -> list[tuple[str, int]]:
    """As ``write_table``, with the manifest as a list of (path, bytes) by ord and path: for as many files as the driver may name."""
    return [(r.path, r.n) for r in sorted(write_table(rows, home).collect())]


def write_table(rows: DataFrame, home: str) -> DataFrame:
    """Write ``rows`` (ord, path, text) and return ord, path, n (bytes): the manifest of what was written.

    A text has to end with a line end, as the files do.  Of rows with one path the last counts.
    ``home`` is a folder on the file system of the paths; what is in work lies there in a hidden folder.
    """
    staging, spark, store = joined(mounted(home), f".part-{uuid.uuid4().hex}"), rows.sparkSession, Store(rows.sparkSession)
    last = rows.groupBy("path").agg(F.max("ord").alias("ord"), F.max_by("text", "ord").alias("text"))
    whole = F.when(F.endswith("text", F.lit("\n")), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no line end at the end of "), F.col("path"))))
    last = last.withColumn("text", whole)
    try:
        if not is_uri(staging):
            store.make(staging)
            return renamed_by_tasks(kept(staged_by_tasks(last, staging), "parts"))
        done = staged_by_writer(last, staging, store)
        for folder in {p.rpartition("/")[0] for _, p, _, _ in done}:
            store.make(folder)
        with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
            list(pool.map(lambda one: store.rename(one[3], one[1], "OVERWRITE"), done))
    finally:
        store.remove(staging)
    return spark.createDataFrame([one[:3] for one in done], MANIFEST)


def staged_by_writer(rows: DataFrame, staging: str, store: Store) -> list[tuple[int, str, int, str]]:
    """(ord, path, bytes, where it lies) of files written by Spark's own text sink, each in a folder of its own."""
    # the sink ends each row with a line end; tasks put their files there themselves when they end (version 2), as nobody reads the folder before all have
    out = rows.select(F.sha2("path", 256).alias("file"), F.expr("substring(text, 1, char_length(text) - 1)").alias("value")).write.partitionBy("file")
    out.option("compression", "none").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(staging)
    part_of = {p.rsplit("/", 2)[1].removeprefix("file="): p for p in store.found(joined(staging, "file=*", "part-*"))}
    return [(r.ord, r.path, r.n, part_of[hashlib.sha256(r.path.encode()).hexdigest()]) for r in rows.select("ord", "path", F.octet_length("text").alias("n")).toLocalIterator()]


def staged_by_tasks(rows: DataFrame, staging: str) -> DataFrame:
    """ord, path, n and part, where it lies: as ``staged_by_writer`` on a mounted file system, where tasks write the files themselves; Hadoop's local one starts a process for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, parts = [], []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                data = text.encode()
                parts.append(os.path.join(staging, f"{hashlib.sha256(path.encode()).hexdigest()}-{uuid.uuid4().hex}"))  # a task may run twice
                Path(parts[-1]).write_bytes(data)
                sizes.append(len(data))
            yield pd.DataFrame({"ord": frame["ord"], "path": frame["path"], "n": sizes, "part": parts})

    return rows.mapInPandas(run, f"{MANIFEST}, part string")


def renamed_by_tasks(parts: DataFrame) -> DataFrame:
    """The manifest, when each part has its name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for frame in frames:
            for path, part in zip(frame["path"], frame["part"], strict=True):
                if (folder := os.path.dirname(path)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                try:
                    os.replace(part, path)
                except FileNotFoundError:
                    if not os.path.exists(path):  # else an earlier run of the task has renamed it
                        raise
            yield frame[["ord", "path", "n"]]

    return kept(parts.mapInPandas(run, MANIFEST), "manifest")


def remove_files(paths: DataFrame, store: Store) -> None:
    """Remove the files of ``paths`` (path), by tasks where they are mounted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                Path(path).unlink(missing_ok=True)
            yield frame

    remote = F.col("path").rlike(f"^{URI}")
    for r in paths.filter(remote).toLocalIterator():
        store.remove(r.path)
    paths.filter(~remote).mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def copied_whole(source: str, target: str) -> bool:
    """Copy a local file beside its new place, then rename; False where there is none."""
    if not source or not os.path.isfile(source):
        return False
    part = Path(target).with_name(f".{Path(target).name}-{uuid.uuid4().hex}")
    part.parent.mkdir(parents=True, exist_ok=True)
    shutil.copy2(source, part)
    os.replace(part, target)
    return True


def copy_files(rows: DataFrame) -> DataFrame:
    """``rows`` (source, target) with copied: whether there was a file, whose bytes are now at its target.

    Tasks copy files of a mounted file system.  For other stores, whose bytes only the JVM reaches, the
    driver's streams them through, file by file.
    """
    spark, store = rows.sparkSession, Store(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(copied=[copied_whole(s, t) for s, t in zip(frame["source"], frame["target"], strict=True)])

    remote = F.col("source").rlike(f"^{URI}") | F.col("target").rlike(f"^{URI}")
    pairs = [(r.source, r.target) for r in rows.filter(remote).toLocalIterator()]

    def one(pair: tuple[str, str]) -> tuple[str, str, bool]:
        there = store.exists(pair[0])
        if there:
            store.copy(*pair)
        return *pair, there

    with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
        done = list(pool.map(one, pairs))
    schema = "source string, target string, copied boolean"
    return rows.filter(~F.coalesce(remote, F.lit(False))).mapInPandas(run, schema).unionByName(spark.createDataFrame(done, schema))
