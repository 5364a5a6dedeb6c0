"""Bindings for what the tables hold only once they are written out: styled scripts, rolling captions,
documents in Markdown, and changes of the state tables.  Each has its DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import queries as Q
from cuewright.functions import scoring as X
from cuewright.functions import text as T
from cuewright.operators import cues, folds
from cuewright.plans import transcripts
from cuewright.plans.state import State
from cuewright.schemas import TABLES, columns_of


def joined_lines(rows: DataFrame, order: str, line: Column, between: str) -> DataFrame:
    """source_id, body: the lines of each source in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return rows.groupBy("source_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), between).alias("body"))


# styled scripts

ASS_HEAD = "[Script Info]\nTitle: x\nDialogue: 0,0:00:00.00,0:00:01.00,no event\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"
ASS_TAIL = "\n\n[Fonts]\nDialogue: 0,0:00:00.00,0:00:01.00,Default,no event"


def q_ass_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as styled scripts, with breaks and overrides for blanks, and every eleventh start unreadable."""
    k, start = F.col("cue_index"), F.col("start")
    clock = lambda s: F.format_string("%d:%02d:%02d.%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), F.floor(s % 60), F.floor(s * 100 % 100))
    text = F.concat(F.lit(r"{\an8}"), F.replace("text", F.lit(" "), F.lit(r"\N")))
    line = F.concat(F.lit("Dialogue: 0,"), F.when(k % 11 == 10, "soon").otherwise(clock(start)), F.lit(","), clock(F.col("end")), F.lit(",Default,"), text)
    bodies = joined_lines(Q.document_cues(spark, sf_dir), "cue_index", line, "\n")
    files = bodies.select("source_id", F.lit("ass").alias("format"), F.concat(F.lit(ASS_HEAD), "body", F.lit(ASS_TAIL)).alias("raw_text"))
    return cues.parse_cues(files)[0]


def ass_sql() -> str:
    text = "t"
    for pattern, by in T.STYLE_MARKUP:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    noise = ", ".join(f"'{n}'" for n in T.NOISE)
    return f"""
        SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS INTEGER) AS cue_index, s AS "start", s + 3.5::DOUBLE AS "end", x AS text
        FROM (SELECT *, {Q.compact_sql(Q.entities_sql(text))} AS x FROM ({Q.CUES_SQL}) WHERE k % 11 <> 10) WHERE x <> '' AND lower(x) NOT IN ({noise})
    """


# rolling captions

VTT_STAMP = "%02d:%02d:%02d.%03d"


def q_vtt_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rolling captions: the turn before with the first two words of this one, then this one."""
    now, s = T.compact(F.col("text")), F.col("turn") * 4
    again = F.concat_ws(" ", T.compact(F.col("before")), F.array_join(F.slice(T.tokens(now), 1, 2), " "))
    stamp = lambda at, ms: F.format_string(VTT_STAMP, F.floor(at / 3600), F.floor(at % 3600 / 60), at % 60, F.lit(ms))
    block = F.concat(stamp(s, 0), F.lit(" --> "), stamp(s + 3, 500), F.lit(" align:start\n"), again, F.lit("\n<c.yellow>"), now, F.lit("</c>"))
    rows = Q.turns(spark, sf_dir).withColumn("source_id", F.col("conv_id").cast("string"))
    files = joined_lines(rows, "turn", block, "\n\n").select("source_id", F.lit("vtt").alias("format"), F.concat(F.lit("WEBVTT\n\n"), "body").alias("raw_text"))
    return cues.parse_cues(files)[0]


def vtt_sql() -> str:
    bare = lambda x: Q.compact_sql(Q.entities_sql(Q.chained_sql(x)))
    noise = ", ".join(f"'{n}'" for n in T.NOISE)
    words = Q.words_sql(Q.compact_sql("text"))
    return f"""
        WITH t AS (SELECT conv_id, turn, {Q.compact_sql('text')} AS now_, {words} AS w, {Q.compact_sql('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS before FROM conversations),
        line AS (SELECT conv_id, turn, {bare("before || ' ' || array_to_string(w[1:2], ' ')")} AS a, {bare("'<c.yellow>' || now_ || '</c>'")} AS b FROM t WHERE before IS NOT NULL),
        cut AS (SELECT *, {Q.words_sql('lower(a)')} AS p, {Q.words_sql('lower(b)')} AS c, {Q.words_sql('b')} AS o FROM line),
        same AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(p), len(c)) + 1), lambda k: p[len(p) - k + 1 : len(p)] = c[1:k])), 0) AS k FROM cut),
        more AS (SELECT *, CASE WHEN suffix(lower(a), lower(b)) THEN '' WHEN k = 0 THEN b ELSE array_to_string(o[k + 1 : len(o)], ' ') END AS n FROM same),
        told AS (SELECT conv_id, turn, CASE WHEN a = '' THEN b WHEN n = '' THEN a ELSE {Q.compact_sql("a || ' ' || n")} END AS text FROM more)
        SELECT CAST(conv_id AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS cue_index, turn * 4.0::DOUBLE AS "start", turn * 4.0::DOUBLE + 3.5::DOUBLE AS "end", text
        FROM told WHERE text <> '' AND lower(text) NOT IN ({noise})
    """


def q_cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as SubRip files that open with a noise cue, from text to statistics."""
    stamp = lambda at, ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(at / 3600), F.floor(at % 3600 / 60), at % 60, F.lit(ms))
    s = F.col("turn") * 4
    block = F.concat((F.col("turn") + 2).cast("string"), F.lit("\n"), stamp(s, 0), F.lit(" --> "), stamp(s + 3, 500), F.lit("\n"), T.compact(F.col("text")))
    rows = Q.table(spark, sf_dir, "conversations").withColumn("source_id", F.col("conv_id").cast("string"))
    head = F.lit("1\n00:00:00,000 --> 00:00:00,500\n[Music]\n\n")
    files = joined_lines(rows, "turn", block, "\n\n").select("source_id", F.lit("srt").alias("format"), F.concat(head, "body").alias("raw_text"))
    return folds.transcripts(files).select("source_id", "stats.*")


def stats_sql() -> str:
    text = Q.compact_sql(Q.entities_sql(Q.chained_sql("text")))
    noise = ", ".join(f"'{n}'" for n in T.NOISE)
    kept = f"({text}) <> '' AND lower({text}) NOT IN ({noise})"
    blank = f"{Q.compact_sql('text')} = ''"  # a block without text lines is no cue
    said = f"(SELECT CAST(conv_id AS VARCHAR) AS source_id, CAST(1 + count_if(NOT ({kept}) AND NOT ({blank})) AS INTEGER) AS lost, CAST(count_if({blank}) AS INTEGER) AS bad FROM conversations GROUP BY 1)"
    folded = Q.clean_sql(f"(SELECT conv_id, turn, {text} AS text FROM conversations WHERE {kept})")
    return f"""
        SELECT source_id, 'srt' AS format, coalesce(any_value(raw), 0) AS "rawCueCount", CAST(count(utterance_index) AS INTEGER) AS "cleanedUtteranceCount", coalesce(any_value(deduped), 0) AS "dedupedCount",
            coalesce(any_value(merged), 0) AS "mergedCueCount", any_value(lost) AS "droppedNoiseCount", coalesce(arg_min("start", utterance_index), 0.0::DOUBLE) AS "start", coalesce(arg_max("end", utterance_index), 0.0::DOUBLE) AS "end", any_value(bad) AS "rejectedCueCount"
        FROM {said} LEFT JOIN ({folded}) USING (source_id) GROUP BY source_id
    """


# documents

LESSON_COUNTS = ["rawCueCount", "cleanedUtteranceCount", "mergedCueCount", "dedupedCount", "droppedNoiseCount"]


def q_lesson_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesson-ready Markdown and plain text of each document's paragraphs."""
    listed = Q.listed_paragraphs(spark, sf_dir).filter(F.size("paragraphs") > 0)
    first, last = F.get("paragraphs", F.lit(0)), F.element_at("paragraphs", -1)
    counts = [F.size("paragraphs").alias(c) if c == "cleanedUtteranceCount" else F.lit(None).cast("int").alias(c) if c == "droppedNoiseCount" else F.lit(k).alias(c) for k, c in enumerate(LESSON_COUNTS)]
    stats = F.struct(F.lit("srt").alias("format"), *counts, first["start"].alias("start"), last["end"].alias("end"))
    source = F.struct(F.col("source_id"), F.concat(F.lit("Label "), "source_id").alias("source_label"))
    payload = listed.select("source_id", source.alias("source"), stats.alias("stats"), F.lit(None).cast("string").alias("cleaning_summary"), F.transform("paragraphs", lambda p: p["text"]).alias("paragraphs"))
    return payload.select("source_id", transcripts.lesson_markdown(F.concat(F.lit("Talk "), "source_id"), F.lit("live_chat")).alias("md"), transcripts.plain_text().alias("txt"))


def clock_sql(s: str) -> str:
    whole = f"CAST(floor({s}) AS BIGINT)"
    return f"lpad(CAST({whole} // 3600 AS VARCHAR), CAST(greatest(2, length(CAST({whole} // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({whole} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({whole} % 60 AS VARCHAR), 2, '0')"


def lesson_sql() -> str:
    head = [
        "'# Lesson-Ready Transcript'", "''", "'- input_type: transcript'", "'- track: live_chat'", "'- material_type: subtitle_transcript'", "'- title: Talk ' || source_id", "'- source_id: ' || source_id", "'- source_label: Label ' || source_id",
        f"'- cleaned_span: ' || {clock_sql('s')} || '-' || {clock_sql('e')}", f"'- cleaning_summary: {T.CLEANING_SUMMARY}'", "''", "'## Cleaned Text'", "''", "body", "'## Cleaning Stats'", "''", "'- subtitle_format: srt'", "'- raw_cues: 0'",
        "'- cleaned_utterances: ' || n", "'- merged_cross_cue_continuations: 2'", "'- removed_exact_repeats: 3'", "'- dropped_noise_cues: None'", "''",
    ]
    return rf"""{Q.PARAGRAPHS_SQL},
        doc AS (SELECT source_id, min("start") AS s, arg_max("end", paragraph_index) AS e, count(*) AS n, string_agg(text || chr(10), chr(10) ORDER BY paragraph_index) AS body, string_agg(text, chr(10) ORDER BY paragraph_index) AS plain FROM paragraph GROUP BY 1)
        SELECT source_id, {" || chr(10) || ".join(head)} AS md, regexp_replace(plain, '^{Q.SQL_SPACE}+|{Q.SQL_SPACE}+$', '', 'g') || chr(10) AS txt FROM doc"""


def q_segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of each live-chat segment."""
    return folds.segments(Q.listed_paragraphs(spark, sf_dir), F.lit("live_chat")).select("source_id", "segmentIndex", transcripts.segment_markdown().alias("md"))


def segment_documents_sql() -> str:
    pairs = [("track", "'live_chat'"), ("segment_index", 'CAST("segmentIndex" AS VARCHAR)'), ("start_ref", '"startRef"'), ("end_ref", '"endRef"'), ("scene_or_argument_summary", '"sceneSummary"'), ("context_before_summary", '"contextBefore"'), ("context_after_summary", '"contextAfter"')]
    lines = ["'# Transcript Segment'", "''", *(f"'- {label}: ' || {column}" for label, column in pairs), "''", "'## Text'", "''", f"regexp_replace(text, '{Q.SQL_SPACE}+$', '')", "''"]
    return f"""SELECT source_id, "segmentIndex", {" || chr(10) || ".join(lines)} AS md FROM ({Q.segments_sql(Q.LIVE_SPLIT)}) JOIN ({Q.contexts_sql(Q.LIVE_SPLIT, "live_chat")}) USING (source_id, "segmentIndex")"""


# formats and times

NAMES = ["a.VTT", "b.ass", "c.ssa", "d.srt", ".vtt", "e"]


def q_format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of each document by name, or by a signature that every other one gets."""
    i = F.col("doc_id")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (i % len(NAMES) + 1).cast("int"))
    raw = F.when(F.floor(i / len(NAMES)) % 2 == 0, F.concat(F.lit(" \ufeffWebVTT\n"), "text")).otherwise(F.concat(F.lit("WEBVTTs "), "text"))
    return Q.documents(spark, sf_dir).select("doc_id", cues.detect_format(raw, name).alias("format"))


FORMAT_SQL = f"SELECT doc_id, CASE doc_id % {len(NAMES)} WHEN 0 THEN 'vtt' WHEN 1 THEN 'ass' WHEN 2 THEN 'ssa' ELSE CASE WHEN doc_id // {len(NAMES)} % 2 = 0 THEN 'vtt' ELSE 'srt' END END AS format FROM documents"


def q_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text and read back, and numbers given as text."""
    i, at = F.col("event_id"), F.col("ts").cast("timestamp")
    told = X.format_time(X.later(at, (i % 4) * 1e-6 / 86400))
    number = F.when(i % 3 == 0, "x").otherwise(i.cast("string"))
    return Q.table(spark, sf_dir, "events").select("event_id", told.alias("told"), F.unix_micros(X.parse_time(told)).alias("us"), X.as_float(number, 0.5).alias("number"))


TIMES_SQL = r"""
    SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(t) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS told, epoch_us(t) AS us,
        CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE CAST(event_id AS DOUBLE) END AS number
    FROM (SELECT event_id, ts + to_microseconds(event_id % 4) AS t FROM events)
"""


def q_default_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    stem = F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("Talk "), i.cast("string")))
    return Q.table(spark, sf_dir, "pages").select("page_id", T.default_title(stem, i.cast("string"), F.when(i % 2 == 0, "article_reading").otherwise("live_chat")).alias("title"))


TITLE_SQL = "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'Talk ' || page_id ELSE CASE WHEN page_id % 2 = 0 THEN 'Article-style subtitle transcript [' ELSE 'Live chat transcript [' END || page_id || ']' END AS title FROM pages"


# state tables


def rows_of(name: str, df: DataFrame) -> DataFrame:
    """``df`` with all columns of the state table, null where it has none."""
    own, types = set(df.columns), dict(f.split() for f in TABLES[name].split(", "))
    return df.select(*[F.col(c) if c in own else F.lit(None).cast(types[c]).alias(c) for c in columns_of(name)])


WRITES = [
    {"table": "review_items", "op": "insert", "data": {"id": "new", "language": "en", "status": "active", "unknown": 1}},
    {"table": "review_items", "op": "upsert", "key_fields": ["id"], "data": {"id": "5", "status": "paused", "priority_score": 0.75}},
    {"table": "review_items", "op": "upsert", "key_fields": ["id"], "data": {"id": "other", "language": "ja", "status": "active"}},
    {"table": "review_items", "op": "upsert", "key_fields": ["language", "content"], "data": {"id": "n", "language": "en", "content": "none", "status": "mastered"}},
    {"table": "review_items", "op": "update", "where": {"language": "en", "review_category": "click"}, "data": {"status": "ignored"}},
]


def q_state_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All review items after an insert, upserts by one key and by two, and an update."""
    state = State(spark, "unpublished")
    state.changed["review_items"] = rows_of("review_items", Q.review_items(spark, sf_dir))
    state.write(WRITES)
    return state.read("review_items").select("id", "language", "status", "priority_score")


WRITES_SQL = f"""
    SELECT id, language, CASE WHEN language = 'en' AND review_category = 'click' THEN 'ignored' WHEN id = '5' THEN 'paused' ELSE status END AS status, CASE WHEN id = '5' THEN 0.75::DOUBLE ELSE priority_score END AS priority_score FROM ({Q.ITEM_SQL})
    UNION ALL SELECT * FROM (VALUES ('new', 'en', 'active', NULL::DOUBLE), ('other', 'ja', 'active', NULL), ('n', 'en', 'mastered', NULL))
"""


def q_archive_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and states of sources (customers), their segments (orders) and items (events) after one source is archived, and the audit row."""
    state = State(spark, "unpublished")
    customers, orders = Q.table(spark, sf_dir, "customer"), Q.table(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    state.changed = {
        "sources": rows_of("sources", customers.select(text("c_custkey").alias("id"), F.lit("active").alias("status"))),
        "segments": rows_of("segments", orders.select(text("o_orderkey").alias("id"), text("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 3 == 0, "deleted").otherwise("active").alias("status"))),
        "review_items": rows_of("review_items", Q.review_items(spark, sf_dir).withColumn("source_id", (F.col("id").cast("long") % 10).cast("string"))),
        "user_actions": spark.createDataFrame([], TABLES["user_actions"]),
    }
    state.change([{"action": "archive_source", "source_id": "7", "reason": "done"}])
    rows = [state.read(t).select(F.lit(t).alias("kind"), "id", "status") for t in ("sources", "segments", "review_items")]
    audit = state.read("user_actions").select(F.lit("user_actions").alias("kind"), F.concat_ws(":", "target_type", "target_id").alias("id"), F.concat_ws(":", "action_type", "reason").alias("status"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(audit)


ARCHIVE_SQL = f"""
    SELECT 'sources' AS kind, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey = 7 THEN 'archived' ELSE 'active' END AS status FROM customer
    UNION ALL SELECT 'segments', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN 'deleted' WHEN o_custkey = 7 THEN 'archived' ELSE 'active' END FROM orders
    UNION ALL SELECT 'review_items', id, CASE WHEN event_id % 10 = 7 AND status IN ('active', 'paused') THEN 'ignored' ELSE status END FROM ({Q.ITEM_SQL})
    UNION ALL SELECT 'user_actions', 'source:7', 'archive:done'
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "ass_parse": q_ass_parse, "vtt_rolling": q_vtt_rolling, "cleaning_stats": q_cleaning_stats, "lesson_documents": q_lesson_documents, "segment_documents": q_segment_documents, "format_detect": q_format_detect,
        "times": q_times, "default_title": q_default_title, "state_writes": q_state_writes, "archive_source": q_archive_source,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "ass_parse": ass_sql(), "vtt_rolling": vtt_sql(), "cleaning_stats": stats_sql(), "lesson_documents": lesson_sql(), "segment_documents": segment_documents_sql(), "format_detect": FORMAT_SQL,
        "times": TIMES_SQL, "default_title": TITLE_SQL, "state_writes": WRITES_SQL, "archive_source": ARCHIVE_SQL,
    }
