"""Bindings that write files and state to the shared folder and read them back, each with its DuckDB SQL.

What they write stays there, as their results are read from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import queries as Q
from cuewright.format_queries import joined_lines, rows_of
from cuewright.functions import text as T
from cuewright.plans import transcripts
from cuewright.plans.state import State
from cuewright.session import shared_dir
from cuewright.sources import sinks, subtitles
from cuewright.sources.store import Store, joined


def own_folder(spark: SparkSession, name: str) -> str:
    return Store(spark).full(joined(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"))


def q_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as SubRip files, in folders by language, written by tasks, listed and read by the readers, and described."""
    home, start = own_folder(spark, "files"), F.col("start")
    stamp = lambda s: F.concat(T.clock(s), F.lit(","), F.lpad(((s * 1000) % 1000).cast("int").cast("string"), 3, "0"))
    block = F.concat_ws("\n", (F.col("cue_index") + 1).cast("string"), F.concat(stamp(start), F.lit(" --> "), stamp(F.col("end"))), F.col("text"))
    bodies = joined_lines(Q.document_cues(spark, sf_dir), "cue_index", block, "\n\n")
    named = bodies.join(Q.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), "lang"), "source_id")
    path = F.concat(F.lit(f"{home}/"), F.col("lang"), F.lit("/Talk é [d-"), F.col("source_id"), F.lit("] {x}.en-US."), F.when(F.col("source_id").cast("long") % 2 == 0, "srt").otherwise("SRT"))
    sinks.write_table(named.select(F.lit(0).alias("ord"), path.alias("path"), F.concat("body", F.lit("\n")).alias("text")), home)
    files = subtitles.described(subtitles.scan(spark, [home], recursive=True))
    return files.select("source_id", "file_name", "stem", "source_label", "format", F.sha2("raw_text", 256).alias("sha256"))


def round_trip_sql() -> str:
    stamp = lambda s: f"lpad(CAST(CAST(floor({s}) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({s}) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({s}) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(CAST(floor({s} * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
    block = f"CAST(k + 1 AS VARCHAR) || chr(10) || {stamp('s')} || ' --> ' || {stamp('(s + 3.5::DOUBLE)')} || chr(10) || t"
    return f"""
        SELECT 'd-' || source_id AS source_id, 'Talk é [d-' || source_id || '] {{x}}.en-US.' || CASE WHEN CAST(source_id AS BIGINT) % 2 = 0 THEN 'srt' ELSE 'SRT' END AS file_name, 'Talk é [d-' || source_id || '] {{x}}' AS stem,
            'Talk [d-' || source_id || '] {{x}}' AS source_label, 'srt' AS format, sha256(string_agg({block}, chr(10) || chr(10) ORDER BY k) || chr(10)) AS sha256
        FROM ({Q.CUES_SQL}) GROUP BY source_id
    """


def q_published_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources (customers), their segments (orders) and items (events), published, changed by two batches, and read back; one source's rows by lookups."""
    state = State(spark, own_folder(spark, "root"), buckets=16)
    state.create()
    text = lambda c: F.col(c).cast("string")
    tables = {
        "sources": Q.table(spark, sf_dir, "customer").select(text("c_custkey").alias("id"), F.lit("active").alias("status")),
        "segments": Q.table(spark, sf_dir, "orders").select(text("o_orderkey").alias("id"), text("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 3 == 0, "deleted").otherwise("active").alias("status")),
        "review_items": Q.review_items(spark, sf_dir).withColumn("source_id", (F.col("id").cast("long") % 10 + 1).cast("string")),
    }
    state.transact(lambda: [state.append(t, rows_of(t, rows)) for t, rows in tables.items()])
    state.act([{"action": "archive_source", "source_id": "7", "reason": "done"}])
    state.apply([{"table": "segments", "op": "update", "data": {"track": "seen"}, "where": {"source_id": "8"}}])
    rows = [state.read(t).select(F.lit(t).alias("kind"), "id", "status", *([F.col("track")] if t == "segments" else [F.lit(None).cast("string").alias("track")])) for t in tables]
    found = [state.lookup("sources", ["7", "8"]).select(F.lit("one source").alias("kind"), "id", "status", "track"), state.lookup("segments", ["8"], "source_id").select(F.lit("its segments").alias("kind"), "id", "status", "track")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(found[0]).unionByName(found[1])


PUBLISHED_SQL = f"""
    WITH g AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'deleted' WHEN o_custkey = 7 THEN 'archived' ELSE 'active' END AS status, CASE WHEN o_custkey = 8 THEN 'seen' END AS track, o_custkey FROM orders),
    s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey = 7 THEN 'archived' ELSE 'active' END AS status FROM customer)
    SELECT 'sources' AS kind, id, status, NULL AS track FROM s
    UNION ALL SELECT 'segments', id, status, track FROM g
    UNION ALL SELECT 'review_items', id, CASE WHEN event_id % 10 + 1 = 7 AND status IN ('active', 'paused') THEN 'ignored' ELSE status END, NULL FROM ({Q.ITEM_SQL})
    UNION ALL SELECT 'one source', id, status, NULL FROM s WHERE id IN ('7', '8')
    UNION ALL SELECT 'its segments', id, status, track FROM g WHERE o_custkey = 8
"""


def q_ingested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as normalised payload files, imported into a new root: the segments in its state, with the text of each one's file."""
    home = own_folder(spark, "import")
    listed = Q.listed_paragraphs(spark, sf_dir).filter(F.size("paragraphs") > 0)
    source = F.struct(F.lit("").alias("input_path"), F.concat("source_id", F.lit(".srt")).alias("file_name"), F.concat(F.lit("Talk "), "source_id").alias("stem"), F.col("source_id"), F.concat(F.lit("Talk "), "source_id").alias("source_label"), F.lit("srt").alias("subtitle_format"))
    stats = F.struct(F.lit("srt").alias("format"), F.lit(1).alias("rawCueCount"), F.lit(1).alias("cleanedUtteranceCount"))
    payload = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("normalized_subtitle_transcript").alias("kind"), source.alias("source"), F.transform("paragraphs", lambda p: p["text"]).alias("paragraphs"), F.col("paragraphs").alias("paragraph_records"), stats.alias("stats")))
    path = F.concat(F.lit(f"{home}/in/"), "source_id", F.lit(".normalized-subtitle.json"))
    sinks.write_table(listed.select(F.lit(0).alias("ord"), path.alias("path"), F.concat(payload, F.lit("\n")).alias("text")), home)
    root = joined(home, "root")
    transcripts.init_root(spark, root)
    transcripts.import_files(spark, root, [], subtitles.scan_normalized(spark, joined(home, "in")))
    segments = State(spark, root).read("segments")
    found = subtitles.found_files(spark, joined(root, "languages", "en", "segments"), transcripts.SEGMENT_FILE, "*--seg-*")
    texts = found.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.sha2("content", 256).alias("sha256"))
    return segments.withColumn("file", F.regexp_extract("segment_path", "[^/]*$", 0)).join(texts, "file", "left").select("source_id", "segment_index", "start_ref", "end_ref", F.col("context_before_summary").alias("before"), F.col("context_after_summary").alias("after"), F.col("scene_or_argument_summary").alias("summary"), "status", "sha256")


def ingested_sql() -> str:
    from cuewright.format_queries import segment_documents_sql

    return f"""
        SELECT source_id, "segmentIndex" AS segment_index, "startRef" AS start_ref, "endRef" AS end_ref, "contextBefore" AS before, "contextAfter" AS after, "sceneSummary" AS summary, 'ready' AS status, sha256(md) AS sha256
        FROM ({Q.segments_sql(Q.LIVE_SPLIT)}) JOIN ({Q.contexts_sql(Q.LIVE_SPLIT, "live_chat")}) USING (source_id, "segmentIndex") JOIN ({segment_documents_sql()}) USING (source_id, "segmentIndex")
    """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"file_round_trip": q_file_round_trip, "published_state": q_published_state, "ingested_segments": q_ingested_segments}


def oracle_sql() -> dict[str, str]:
    return {"file_round_trip": round_trip_sql(), "published_state": PUBLISHED_SQL, "ingested_segments": ingested_sql()}
