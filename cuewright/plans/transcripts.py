"""From files to documents: normalise, render, clean, and import into a learning root."""

from __future__ import annotations

import datetime as dt
import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuewright import schemas as S
from cuewright.functions import text as T
from cuewright.operators import contracts, folds
from cuewright.operators import profile as profile_lists
from cuewright.plans.state import State, fresh_id, now_iso, read_json, write_json
from cuewright.plans.writes import Change
from cuewright.session import kept
from cuewright.sources import subtitles
from cuewright.sources.sinks import copy_files, remove_files, write_files, write_table
from cuewright.sources.store import Located, Store, is_uri, joined, mounted

COACH = ".coach"
SEGMENT_FILE = re.compile(r"--seg-[^/]*$")
PROFILE_LISTS = ["comprehension_strengths", "output_fragilities", "reusable_chunks", "recurring_vocab_gaps", "track_bias", "recent_priorities"]

# What an import of each track starts a profile with.
TRACK_PROFILES = {
    "live_chat": ("Learning profile initialized from cleaned live-chat transcript imports.", ["live_chat chunk integrity", "spoken scene management", "dual-platform chat humor"]),
    "article_reading": ("Learning profile initialized from cleaned reading-style subtitle transcript imports.", ["argument comprehension", "written connector accuracy", "claim-support mapping", "summary paraphrase precision"]),
}


def normalized(spark: SparkSession, raw: list[Path] | DataFrame, ready: list[Path] | DataFrame) -> DataFrame:
    """Payload columns of raw subtitle files (named, or read by ``subtitles.scan``) and of normalised ones (named, or read by ``subtitles.scan_normalized``), with their place file_ord.

    Of payloads with one source_id the last counts, normalised ones after raw ones.
    """
    files = subtitles.described(raw if isinstance(raw, DataFrame) else subtitles.read_files(spark, raw))
    done = files.select("file_ord", "source_id", "path", "file_name", "stem", "source_label").join(folds.transcripts(files.select("source_id", "format", "raw_text")), "source_id")
    source = F.struct(F.col("path").alias("input_path"), "file_name", "stem", "source_id", "source_label", F.col("stats.format").alias("subtitle_format"))
    made = done.select("file_ord", F.lit(S.SCHEMA_VERSION).alias("schema_version"), F.lit(S.NORMALIZED_KIND).alias("kind"), source.alias("source"), F.lit(T.CLEANING_SUMMARY).alias("cleaning_summary"), F.col("utterances").alias("cleaned_utterances"), F.col("paragraphs").alias("paragraph_records"), F.transform("paragraphs", lambda p: p["text"]).alias("paragraphs"), "stats")
    if not isinstance(ready, DataFrame) and not ready:
        return made
    first = 1 << 30 if isinstance(raw, DataFrame) else len(raw)
    given = last_of_each(ready).withColumn("file_ord", F.lit(first)) if isinstance(ready, DataFrame) else ready_payloads(spark, ready, first)
    if not isinstance(raw, DataFrame) and not raw and isinstance(ready, DataFrame):
        return given.select(*made.columns)
    every = made.unionByName(given.drop("from_")).withColumn("id_", F.col("source.source_id"))
    last = every.groupBy("id_").agg(F.max("file_ord").alias("file_ord"))
    return every.join(last, ["id_", "file_ord"], "left_semi").drop("id_")


def last_of_each(payloads: DataFrame) -> DataFrame:
    """Of payloads with one source_id, the one whose path comes last."""
    rows = payloads.withColumn("id_", F.col("source.source_id"))
    last = rows.groupBy("id_").agg(F.max(F.struct(F.lower("from_"), "from_"))["from_"].alias("from_"))
    return rows.join(last, ["id_", "from_"], "left_semi").drop("id_")


def ready_payloads(spark: SparkSession, ready: list[Path], first: int = 0) -> DataFrame:
    """Normalised payloads with their place, from ``first`` on, and the path that each is from."""
    order = spark.createDataFrame([(first + k, str(p)) for k, p in enumerate(ready)], "file_ord int, from_ string")
    path = subtitles.plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    return subtitles.read_normalized(spark, ready).withColumn("from_", path).join(order, "from_")


def folder_of(path: Column, output: object) -> Column:
    """The folder that a file's documents go to: ``output``, or the file's own."""
    return F.lit(str(output).rstrip("/")) if output else F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def home_of(paths: list[Path], output: object) -> str:
    return str(output or paths[0].parent)


def pathed(path: str) -> Path | Located:
    return Located(path) if is_uri(path) else Path(path)


def lesson_markdown(title: Column, track: Column) -> Column:
    """The lesson-ready document of a payload."""
    c = lambda name: F.coalesce(F.col(f"stats.{name}").cast("string"), F.lit("None"))
    head = ["# Lesson-Ready Transcript", "", "- input_type: transcript", F.concat(F.lit("- track: "), track), "- material_type: subtitle_transcript", F.concat(F.lit("- title: "), title), F.concat(F.lit("- source_id: "), F.col("source.source_id")), F.concat(F.lit("- source_label: "), F.col("source.source_label")), F.concat(F.lit("- cleaned_span: "), T.clock(F.coalesce("stats.start", F.lit(0.0))), F.lit("-"), T.clock(F.coalesce("stats.end", F.lit(0.0)))), F.concat(F.lit("- cleaning_summary: "), F.coalesce("cleaning_summary", F.lit(T.CLEANING_SUMMARY))), "", "## Cleaned Text", ""]
    names = {"subtitle_format": "format", "raw_cues": "rawCueCount", "cleaned_utterances": "cleanedUtteranceCount", "merged_cross_cue_continuations": "mergedCueCount", "removed_exact_repeats": "dedupedCount", "dropped_noise_cues": "droppedNoiseCount"}
    tail = ["## Cleaning Stats", "", *[F.concat(F.lit(f"- {label}: "), c(name)) for label, name in names.items()], ""]
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    body = F.flatten(F.transform("paragraphs", lambda p: F.array(p, F.lit(""))))
    return F.array_join(F.concat(F.array(*map(column, head)), body, F.array(*map(column, tail))), "\n")


def segment_markdown() -> Column:
    pairs = [("track", "track"), ("segment_index", "segmentIndex"), ("start_ref", "startRef"), ("end_ref", "endRef"), ("scene_or_argument_summary", "sceneSummary"), ("context_before_summary", "contextBefore"), ("context_after_summary", "contextAfter")]
    lines = [F.concat(F.lit(f"- {label}: "), F.col(name).cast("string")) for label, name in pairs]
    return F.concat(F.concat_ws("\n", F.lit("# Transcript Segment"), F.lit(""), *lines, F.lit(""), F.lit("## Text"), F.lit("")), F.lit("\n"), F.regexp_replace("text", rf"{T.SPACE}+\z", ""), F.lit("\n"))


def plain_text() -> Column:
    return F.concat(T.strip(F.array_join("paragraphs", "\n")), F.lit("\n"))


@F.pandas_udf(StringType())
def indented(texts: pd.Series) -> pd.Series:
    """JSON texts over several lines, characters as they are."""
    return texts.map(lambda text: json.dumps(json.loads(text), ensure_ascii=False, indent=2) + "\n")


def normalize(spark: SparkSession, paths: list[Path], output: Path | None = None) -> list[Path]:
    """A JSON payload beside each file."""
    if not paths:
        return []
    rows = normalized(spark, paths, [])
    path = F.concat(folder_of(F.col("source.input_path"), output), F.lit("/"), F.col("source.stem"), F.lit(".normalized-subtitle.json"))
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != "file_ord"]), {"ignoreNullFields": "false"})
    made = rows.select(F.col("file_ord").alias("ord"), path.alias("path"), indented(payload).alias("text"))
    return [pathed(p) for p, _ in write_files(made, home_of(paths, output))]


def documents_beside(rows: DataFrame, base: Column, title: Column, track: str, emit_txt: bool) -> DataFrame:
    """ord, path, text of each payload's lesson-ready document, and of its plain text if asked."""
    made = rows.select((F.col("file_ord") * 2).alias("ord"), F.concat(base, F.lit(".lesson-ready.en.md")).alias("path"), lesson_markdown(title, F.lit(track)).alias("text"))
    return made.unionByName(rows.select((F.col("file_ord") * 2 + 1).alias("ord"), F.concat(base, F.lit(".lesson-ready.en.txt")).alias("path"), plain_text().alias("text"))) if emit_txt else made


def render(spark: SparkSession, paths: list[Path], track: str, output: Path | None = None, emit_txt: bool = False) -> list[Path]:
    """Lesson-ready Markdown, and text if asked, of normalised payloads."""
    if not paths:
        return []
    title = F.coalesce(F.nullif("source.stem", F.lit("")), F.nullif("source.source_label", F.lit("")), F.col("source.source_id"))
    base = F.concat(folder_of(F.col("from_"), output), F.lit("/"), title)
    return [pathed(p) for p, _ in write_files(documents_beside(ready_payloads(spark, paths), base, title, track, emit_txt), home_of(paths, output))]


def init_root(spark: SparkSession, root: str | Path, language: str = "en", overwrite: bool = False, now: dt.datetime | None = None, learner_id: str = "default", native_language: str = "zh-CN", feedback_language: str = "zh-CN", strict: bool = False) -> None:
    """Folders, config, profile and empty state; an existing config or profile stays unless ``overwrite``.  ``strict``: see ``State.create``."""
    root, at = absolute(root), now_iso(now)
    for part in ("raw", "cleaned", "segments", "lessons", "sessions", "exports"):
        Store(spark).make(joined(root, "languages", language, part))
    stamps = {"created_at": at, "updated_at": at}
    config = {
        "schema_version": S.SCHEMA_VERSION, "learner_id": learner_id, "default_language": language, "default_feedback_language": feedback_language, "auto_write": True,
        "review_policy": {"mode": "summary_first", "max_focus_groups": 3, "max_item_details_on_demand": 5},
        "paths": {"languages_dir": "languages", "coach_dir": COACH}, **stamps,
    }
    profile = {
        "schema_version": S.SCHEMA_VERSION, "learner_id": learner_id, "native_language": native_language, "active_languages": [language],
        "preferences": {"feedback_language": feedback_language, "auto_write": True},
        "language_profiles": {language: {"baseline_summary": None, **{k: [] for k in PROFILE_LISTS}, "last_updated_at": None}}, **stamps,
    }
    for name, value in (("config.json", config), ("profile.json", profile)):
        path = joined(root, COACH, name)
        if overwrite or not Store(spark).exists(path):
            write_json(path, value, spark)
    State(spark, root).create(strict)


def migrate_root(spark: SparkSession, root: str | Path, now: dt.datetime | None = None, strict: bool = False) -> int:
    """Missing state tables are made and the schema version stamped; rows stay.  A root without state is an error."""
    root = absolute(root)
    state = State(spark, root)
    if not state.unlogged():
        state.version()
    state.create(strict)
    for path in (joined(root, COACH, "config.json"), joined(root, COACH, "profile.json")):
        if Store(spark).exists(path):
            write_json(path, {**read_json(path, spark), "schema_version": S.SCHEMA_VERSION, "updated_at": now_iso(now)}, spark)
    return S.SCHEMA_VERSION


def clean(spark: SparkSession, paths: list[Path], track: str = "live_chat", output: Path | None = None, emit_txt: bool = False) -> list[dict]:
    """Lesson-ready documents straight from subtitle files, with what the cleaning did to each."""
    if not paths:
        return []
    rows = normalized(spark, paths, []).cache()
    base = F.concat(folder_of(F.col("source.input_path"), output), F.lit("/"), F.col("source.stem"))
    write_files(documents_beside(rows, base, F.col("source.stem"), track, emit_txt), home_of(paths, output))
    out = []
    for r in rows.select("file_ord", "source.input_path", base.alias("base"), "stats").orderBy("file_ord").toLocalIterator():
        out.append({"input": r.input_path, "plain_text": f"{r.base}.lesson-ready.en.txt" if emit_txt else None, "markdown": f"{r.base}.lesson-ready.en.md", "track": track, "raw_cues": r.stats.rawCueCount, "cleaned_utterances": r.stats.cleanedUtteranceCount, "merged_cross_cue_continuations": r.stats.mergedCueCount, "removed_exact_repeats": r.stats.dedupedCount, "dropped_noise_cues": r.stats.droppedNoiseCount})
    rows.unpersist()
    return out


def absolute(root: object) -> str:
    root = mounted(root)
    return root.rstrip("/") if is_uri(root) else str(Path(root).resolve())


def ingest(spark: SparkSession, root: str | Path, raw: list[Path] | DataFrame, ready: list[Path] | DataFrame = (), **options: object) -> list[dict]:
    """As ``import_files``, with what was done as a list, a row of counts for each source."""
    done = import_files(spark, root, raw, ready, **options).orderBy("file_ord", "source_id").drop("file_ord")
    return [r.asDict() | {"first_segment": r.first_segment and r.first_segment.asDict()} for r in done.toLocalIterator()]


def import_files(spark: SparkSession, root: str | Path, raw: list[Path] | DataFrame, ready: list[Path] | DataFrame = (), track: str = "live_chat", language: str = "en", title: str | None = None, creator: str | None = None, source_url: str | None = None, emit_txt: bool = False, now: dt.datetime | None = None) -> DataFrame:
    """Import files: documents and segment files on disk, sources and segments in state (published together), and the profile.

    Tasks read, copy, write and remove.  The rows returned are what was done, one for each source, with its place file_ord.
    """
    root, at, store = absolute(root), now_iso(now), Store(spark)
    if track not in S.TRACKS:
        raise ValueError(f"unknown track {track}")
    profile_path = joined(root, COACH, "profile.json")
    if not store.exists(profile_path):
        raise FileNotFoundError(profile_path)
    home = joined(root, "languages", language)
    named = F.coalesce(F.lit(title), T.default_title(F.col("source.stem"), F.col("source.source_id"), F.lit(track)))
    cleaned = F.concat(F.lit(f"{home}/cleaned/"), F.col("source.source_id"), F.lit(".lesson-ready.en.md"))
    payloads = normalized(spark, *(x if isinstance(x, DataFrame) else list(x) for x in (raw, ready))).withColumn("title", named).withColumn("cleaned_path", cleaned).cache()
    said = payloads.select(F.col("source.source_id").alias("source_id"), F.lit("transcript").alias("input_type"), F.lit(track).alias("track"), "title", F.array_join("paragraphs", " ").alias("text"), F.col("source.input_path").alias("source_path"))
    contracts.refuse(contracts.checked_inputs(said), "source_id")
    segment_path = F.concat(F.lit(f"{home}/segments/"), F.col("source_id"), F.lit("--seg-"), T.two_digits(F.col("segmentIndex")), F.lit(".md"))
    cut = folds.segments(payloads.select("source.source_id", F.col("paragraph_records").alias("paragraphs")), F.lit(track)).withColumn("segment_path", segment_path).cache()

    # files
    extension = F.lower(F.regexp_extract("source.input_path", r"[^/](\.[^./]+)$", 1))
    target = F.concat(F.lit(f"{home}/raw/"), F.col("source.source_id"), F.lit(f".{language}"), F.when(extension == "", ".txt").otherwise(extension))
    copies = copy_files(payloads.filter(F.col("source.input_path") != "").select(F.col("source.input_path").alias("source"), target.alias("target"))).filter("copied").select(F.col("target").alias("raw_path")).cache()
    files = payloads.select(F.lit(0).alias("ord"), F.col("cleaned_path").alias("path"), lesson_markdown(F.col("title"), F.lit(track)).alias("text"))
    if emit_txt:
        files = files.unionByName(payloads.select(F.lit(0).alias("ord"), F.regexp_replace("cleaned_path", "md$", "txt").alias("path"), plain_text().alias("text")))
    files = files.unionByName(cut.select(F.lit(0).alias("ord"), F.col("segment_path").alias("path"), segment_markdown().alias("text")))
    written = write_table(files, home)

    # state
    own = {"id": F.col("source.source_id"), "language": F.lit(language), "material_type": F.lit("subtitle_transcript"), "track": F.lit(track), "title": F.col("title"), "source_url": F.lit(source_url), "creator": F.lit(creator), "raw_path": F.col("raw_path"), "cleaned_path": F.col("cleaned_path"), "imported_at": F.lit(at), "status": F.lit("active")}
    sources = payloads.withColumn("target", target).join(copies, F.col("target") == F.col("raw_path"), "left").select(*[own[c].cast("string").alias(c) for c in S.columns_of("sources")])
    state = State(spark, root)

    def imported() -> None:
        state.merge("sources", sources)
        state.change_rows("segments", replacing_segments(state.read("segments"), cut, sources, at))

    state.transact(imported)

    # what was done
    first = F.min_by(F.struct(F.col("startRef").alias("start_ref"), F.col("endRef").alias("end_ref"), F.col("sceneSummary").alias("summary")), "segmentIndex")
    counted = cut.groupBy("source_id").agg(F.count("*").alias("segment_count"), first.alias("first_segment"))
    told = payloads.select("file_ord", "source.source_id", F.col("title").alias("source_title"), F.lit(track).alias("track"), F.col("stats.rawCueCount").alias("raw_cues"), F.col("stats.cleanedUtteranceCount").alias("cleaned_utterances"))
    done = kept(told.join(counted, "source_id", "left").select(*told.columns, F.coalesce("segment_count", F.lit(0)).alias("segment_count"), "first_segment"), "done")
    remove_stale(joined(home, "segments"), written, done, store)
    last = done.orderBy(F.desc("file_ord"), F.desc("source_id")).limit(1).collect()
    update_profile(profile_path, language, track, [{"source_id": r.source_id, "title": r.source_title, "track": track, "imported_at": at, "segment_count": r.segment_count} for r in last], at, spark)
    for frame in (payloads, cut, copies):
        frame.unpersist()
    return done


def remove_stale(folder: str, written: DataFrame, done: DataFrame, store: Store) -> None:
    """Remove segment files of the imported sources that this import did not write: those of an earlier one with more segments."""
    spark = written.sparkSession
    if is_uri(folder):
        paths = spark.createDataFrame([(joined(folder, name),) for name, _ in store.names(folder)], "path string")
    else:
        paths = subtitles.names_under(spark, folder, SEGMENT_FILE).select("path")
    stem = F.regexp_extract("path", "([^/]*)--seg-[^/]*$", 1)
    stale = paths.join(written, "path", "left_anti").withColumn("source_id", stem).join(done.select("source_id"), "source_id", "left_semi")
    remove_files(stale.select("path"), store)


def replacing_segments(old: DataFrame, cut: DataFrame, sources: DataFrame, at: str) -> Change:
    """The sources' old segments go, their new ones come, whose ids follow from source and index."""
    new = cut.select(F.substring(F.sha2(F.concat_ws("\x1f", "source_id", F.col("segmentIndex").cast("string")), 256), 1, 32).alias("id"), "source_id", F.lit("subtitle_transcript").alias("material_type"), "track", F.col("segmentIndex").alias("segment_index"), "segment_path", F.col("startRef").alias("start_ref"), F.col("endRef").alias("end_ref"), F.col("contextBefore").alias("context_before_summary"), F.col("contextAfter").alias("context_after_summary"), F.col("sceneSummary").alias("scene_or_argument_summary"), F.lit(at).alias("created_at"), F.lit("ready").alias("status"))
    return Change(new, old.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id"))


def replaced_segments(old: DataFrame, cut: DataFrame, sources: DataFrame, at: str) -> DataFrame:
    """``old`` without the sources' old segments and with their new ones."""
    return replacing_segments(old, cut, sources, at).applied(old, "id")


def track_profile(track: Column, bias: Column, priorities: Column, baseline: Column) -> dict[str, Column]:
    """What an import of a track makes of a language's lists."""
    of_track = lambda k: F.when(track == "article_reading", k(TRACK_PROFILES["article_reading"])).otherwise(k(TRACK_PROFILES["live_chat"]))
    return profile_lists.after_import(track, bias, priorities, baseline, of_track(lambda t: F.array(*map(F.lit, t[1]))), of_track(lambda t: F.lit(t[0])))


def update_profile(path: str, language: str, track: str, imported: list[dict], at: str, spark: SparkSession) -> None:
    profile = read_json(path, spark)
    own = profile.get("language_profiles", {}).get(language)
    if not own:
        return
    listed = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    old = F.lit(own.get("baseline_summary")).cast("string")
    after = track_profile(F.lit(track), listed(own.get("track_bias") or []), listed(own.get("recent_priorities") or []), old)
    own.update(spark.range(1).select(*[c.alias(n) for n, c in after.items()]).first().asDict(), last_updated_at=at)
    profile["updated_at"] = at
    profile["last_imported_source"] = imported[-1] if imported else profile.get("last_imported_source")
    write_json(path, profile, spark)


__all__ = ["clean", "fresh_id", "import_files", "ingest", "init_root", "migrate_root", "normalize", "normalized", "render"]
