"""Subtitle and normalised files as DataFrames, in a fixed order."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cuewright import schemas as S
from cuewright.functions import text as T
from cuewright.operators import cues
from cuewright.session import kept
from cuewright.sources.store import Located, Store, is_uri, joined, literal, mounted

SUBTITLE = re.compile(r"[^/]\.(?:srt|vtt|ass|ssa)$", re.IGNORECASE)
SUBTITLE_GLOB = "*.{[sS][rR][tT],[vV][tT][tT],[aA][sS][sS],[sS][sS][aA]}"
NORMALIZED_GLOB = "*.[nN][oO][rR][mM][aA][lL][iI][zZ][eE][dD]-[sS][uU][bB][tT][iI][tT][lL][eE]*.[jJ][sS][oO][nN]"
READ_BYTES = 32 << 20  # of a task's files
NAMES = 10_000  # of a batch
HELD_BYTES = 8 << 20  # of a batch's
NORMALIZED = re.compile(r"\.normalized-subtitle(?:\.[a-z]{2}(?:-[A-Za-z]+)?)?\.json$", re.IGNORECASE)


def read_manifest(path: str | Path, spark: SparkSession | None = None) -> list[str | Path]:
    """One path a line, relative to the manifest; blank lines and those that start with # don't count."""
    if is_uri(path):
        text, folder = Store(spark).read(path), str(path).rpartition("/")[0]
    else:
        path = Path(path).resolve()
        text, folder = path.read_text(encoding="utf-8"), path.parent
    lines = [line for line in map(str.strip, text.splitlines()) if line and not line.startswith("#")]
    return [line if is_uri(line) else joined(folder, line) if is_uri(path) else folder / line for line in lines]


def listed(folder: Path, recursive: bool, pattern: re.Pattern) -> list[Path]:
    out = []
    for entry in sorted(folder.iterdir(), key=lambda p: str(p).lower()):
        if entry.is_dir():
            out += listed(entry, recursive, pattern) if recursive else []
        elif pattern.search(str(entry)):
            out.append(entry.resolve())
    return out


def listed_in(store: Store, folder: str, recursive: bool, pattern: re.Pattern) -> list[Located]:
    """As ``listed``, of a folder on any file system."""
    out = []
    for name, is_folder in sorted(store.names(folder), key=lambda entry: entry[0].lower()):
        path = joined(folder, name)
        if is_folder:
            out += listed_in(store, path, recursive, pattern) if recursive else []
        elif pattern.search(path):
            out.append(Located(path))
    return out


def collect(inputs: list[str | Path], manifest: str | Path | None = None, recursive: bool = False, normalized: bool = False, spark: SparkSession | None = None) -> list[Path | Located]:
    """Input files, those of the manifest first, each once; a missing path is an error, other kinds of files are passed over.

    URIs, which need ``spark``, are listed by their file system.
    """
    pattern, out = NORMALIZED if normalized else SUBTITLE, {}
    for given in [*(read_manifest(manifest, spark) if manifest else []), *inputs]:
        if is_uri(given):
            store = Store(spark)
            path = store.full(given)
            there, folder = store.exists(path), store.is_folder(path)
        else:
            path = Path(given).resolve()
            there, folder = path.exists(), path.is_dir()
        if not there:
            raise FileNotFoundError(str(path))
        found = (listed_in(store, path, recursive, pattern) if is_uri(given) else listed(path, recursive, pattern)) if folder else [path] if pattern.search(str(path)) else []
        for file in found:
            out.setdefault(file)
    return list(out)


FILES = "file_ord int, path string, file_name string"


def plain(path: Column) -> Column:
    """A reader's path as ``collect`` gives it: local ones without a scheme."""
    return F.regexp_replace(path, "^file:(?://)?(?=/)", "")


def read_files(spark: SparkSession, paths: list[str | Path]) -> DataFrame:
    """file_ord, path, file_name, raw_text."""
    order = spark.createDataFrame([(k, str(p), p.name) for k, p in enumerate(paths)], FILES)
    if not paths:
        return order.withColumn("raw_text", F.lit(""))
    raw = spark.read.format("binaryFile").load([literal(p) for p in paths])
    return order.join(raw.select(plain(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("raw_text")), "path").select("file_ord", "path", "file_name", "raw_text")


def hidden(name: str) -> bool:
    """Whether Spark's readers pass a file or folder of this name over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def under(folder: str, pattern: re.Pattern, recursive: bool) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files of a mounted folder that the pattern finds, as readers list them."""
    for top, folders, names in os.walk(folder, followlinks=True):
        folders[:] = [f for f in folders if recursive and not hidden(f)]
        for name in names:
            path = os.path.join(top, name)
            if not hidden(name) and pattern.search(path):
                yield path, os.path.getsize(path)


@F.pandas_udf(BinaryType())
def content_of(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The bytes of mounted files."""
    for batch in paths:
        held, size = [], 0
        for path in batch:
            held.append(Path(path).read_bytes())
            size += len(held[-1])
            if size >= HELD_BYTES:
                yield pd.Series(held, dtype=object)
                held, size = [], 0
        if held:
            yield pd.Series(held, dtype=object)


def found_files(spark: SparkSession, folder: str | Path, pattern: re.Pattern, glob: str, recursive: bool = False) -> DataFrame:
    """path and content of the files of a folder.  Mounted ones are listed and read by tasks, so that the driver holds no name; others by the readers, with names that fit ``glob``."""
    if is_uri(mounted(folder)):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
        return reader.load(literal(folder)).select(plain(F.col("path")).alias("path"), "content").filter(F.col("path").rlike(f"(?i){pattern.pattern}"))
    names = names_under(spark, folder, pattern, recursive)
    total = names.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    return names.repartition(tasks, "path").select("path", content_of("path").alias("content"))


def names_under(spark: SparkSession, folder: str | Path, pattern: re.Pattern, recursive: bool = False) -> DataFrame:
    """path and bytes of the files of a mounted folder, listed by a task."""
    top = str(Path(mounted(folder)).resolve(strict=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for given in frame["folder"]:
                found = under(given, pattern, recursive)
                while rows := list(islice(found, NAMES)):
                    yield pd.DataFrame(rows, columns=["path", "bytes"])

    return kept(spark.createDataFrame([(top,)], "folder string").mapInPandas(run, "path string, bytes long"), "names")


def scan(spark: SparkSession, folders: list[str | Path], recursive: bool = False) -> DataFrame:
    """As ``read_files`` for all subtitle files in folders: no name comes to the driver's lists.

    Files of one folder share their file_ord.
    """
    parts = []
    for k, folder in enumerate(folders):
        found = found_files(spark, folder, SUBTITLE, SUBTITLE_GLOB, recursive)
        parts.append(found.select(F.lit(k).alias("file_ord"), "path", F.regexp_extract("path", "[^/]*$", 0).alias("file_name"), F.decode("content", "UTF-8").alias("raw_text")))
    return reduce(DataFrame.unionByName, parts) if parts else read_files(spark, [])


def scan_normalized(spark: SparkSession, folder: str | Path, recursive: bool = False) -> DataFrame:
    """As ``read_normalized`` for all normalised payloads in a folder, one in each file, with ``from_``, their path."""
    found = found_files(spark, folder, NORMALIZED, NORMALIZED_GLOB, recursive)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    return of_kind(found.select(F.col("path").alias("from_"), F.from_json(text, S.NORMALIZED).alias("payload")).select("payload.*", "from_"))


def described(files: DataFrame) -> DataFrame:
    """With source_id, stem, source_label and format.  Of files with one source_id the last counts."""
    named = files.withColumns({"source_id": T.source_id(F.col("file_name")), "stem": T.strip_subtitle_extension(F.col("file_name")), "format": cues.detect_format(F.col("raw_text"), F.col("file_name"))})
    labelled = named.withColumn("source_label", F.coalesce(F.nullif(T.ascii_label(F.col("stem")), F.lit("")), F.col("source_id")))
    # within a folder in order of its names, folders among them
    place = F.struct("file_ord", F.lower(F.translate("path", "/", "\x01")), "path")
    last = labelled.groupBy("source_id").agg(F.max(place)["path"].alias("path"))
    return labelled.join(last, ["source_id", "path"], "left_semi")


def read_normalized(spark: SparkSession, paths: list[Path]) -> DataFrame:
    """Normalised payloads by their schema; another kind is an error."""
    return of_kind(spark.read.schema(S.NORMALIZED).json([literal(p) for p in paths], multiLine=True))


def of_kind(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == S.NORMALIZED_KIND, F.col("kind")).otherwise(F.raise_error(F.lit("unsupported normalized payload")))
    return rows.withColumn("kind", kind)
