"""Bindings of batches of writes, review passes, imports, contracts and stretches of long recordings, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import queries as Q
from cuewright.format_queries import joined_lines, rows_of
from cuewright.functions import text as T
from cuewright.operators import agenda, contracts, cues, folds
from cuewright.plans import transcripts
from cuewright.plans.state import State


def text_of(column: str) -> F.Column:
    return F.col(column).cast("string")


# long recordings


def q_paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents, folded by stretches between pauses."""
    return folds.paragraph_rows(Q.document_cues(spark, sf_dir).withColumnRenamed("cue_index", "utterance_index"))


# rejected cues


def q_rejected_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as SubRip text in which every seventh start has one digit of hours: noise and rejected cues of each."""
    stamp = lambda s: F.concat(T.clock(s), F.lit(","), F.lpad(((s * 1000) % 1000).cast("int").cast("string"), 3, "0"))
    start = F.when(F.col("cue_index") % 7 == 3, F.concat(F.lit("1"), F.substring(stamp(F.col("start")), 3, 20))).otherwise(stamp(F.col("start")))
    block = F.concat_ws("\n", (F.col("cue_index") + 1).cast("string"), F.concat(start, F.lit(" --> "), stamp(F.col("end"))), F.col("text"))
    files = joined_lines(Q.document_cues(spark, sf_dir), "cue_index", block, "\n\n").select("source_id", F.lit("srt").alias("format"), F.col("body").alias("raw_text"))
    return cues.parse_cues(files)[1]


def rejected_sql() -> str:
    text = Q.compact_sql(Q.entities_sql(Q.chained_sql("t")))
    noise = ", ".join(f"'{n}'" for n in T.NOISE)
    return f"""
        SELECT source_id, CAST(count_if(NOT bad AND (x = '' OR lower(x) IN ({noise}))) AS INTEGER) AS "droppedNoiseCount", CAST(count_if(bad) AS INTEGER) AS "rejectedCueCount"
        FROM (SELECT source_id, k % 7 = 3 OR t = '' AS bad, {text} AS x FROM ({Q.CUES_SQL})) GROUP BY 1
    """


# session start


def q_session_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are among the sources (customers) and have segments (orders)."""
    deleted = lambda key, n: F.when(F.col(key) % n == 0, "deleted").otherwise("active").alias("status")
    sources = Q.table(spark, sf_dir, "customer").select(text_of("c_custkey").alias("id"), deleted("c_custkey", 11))
    segments = Q.table(spark, sf_dir, "orders").select(text_of("o_custkey").alias("source_id"), deleted("o_orderkey", 3))
    return agenda.known_inputs(Q.documents(spark, sf_dir).select(text_of("doc_id").alias("source_id")), sources, segments)


START_SQL = """
    SELECT CAST(doc_id AS VARCHAR) AS source_id, c_custkey IS NOT NULL AS imported, coalesce(n, 0) AS segments
    FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0) ON c_custkey = doc_id
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) ON o_custkey = doc_id
"""


# contracts


def q_input_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as inputs that lack this or that."""
    i = F.col("doc_id")
    rows = Q.documents(spark, sf_dir).select(
        i, F.when(i % 3 == 0, "transcript").when(i % 3 == 1, "article").otherwise(F.col("lang")).alias("input_type"), F.when(i % 4 == 0, "live_chat").when(i % 4 == 1, "article_reading").otherwise(F.col("source")).alias("track"),
        F.when(i % 5 == 0, " ").otherwise(F.col("source")).alias("title"), F.when(i % 2 == 0, F.col("text")).alias("text"), F.when(i % 7 == 0, "a.srt").alias("source_path"), F.when(i % 6 == 0, F.col("lang")).alias("learner_language"),
    )
    return contracts.checked_inputs(rows).select("doc_id", "learner_language", "watched_or_read", F.array_join("violations", ",").alias("violations"))


CONTRACT_SQL = """
    SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN lang ELSE 'zh-CN' END AS learner_language, true AS watched_or_read,
        array_to_string(list_filter([CASE WHEN doc_id % 3 = 2 AND lang NOT IN ('transcript', 'article') THEN 'input_type' END, CASE WHEN doc_id % 4 >= 2 AND source NOT IN ('live_chat', 'article_reading') THEN 'track' END,
            CASE WHEN doc_id % 5 = 0 OR trim(source) = '' THEN 'title' END, CASE WHEN (doc_id % 2 = 1 OR trim(text) = '') AND doc_id % 7 <> 0 THEN 'text' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM documents
"""


def q_delta_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as profile deltas: every fifth turn is an entry of one list."""
    lists = [F.collect_list(F.when(F.col("turn") % 5 == k, F.col("text"))).alias(name) for k, name in enumerate(contracts.DELTA_SIZES)]
    deltas = Q.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*lists)
    return contracts.checked_deltas(deltas).select("conv_id", F.array_join("violations", ",").alias("violations"))


def delta_sql() -> str:
    sizes = [("comprehension_strengths", 1, 3), ("output_fragilities", 1, 3), ("reusable_chunks", 2, 5), ("next_focus", 1, 3), ("review_candidates", 3, 6)]
    each = ", ".join(f"CASE WHEN count(text) FILTER (turn % 5 = {k}) NOT BETWEEN {low} AND {high} THEN '{name}' END" for k, (name, low, high) in enumerate(sizes))
    return f"SELECT conv_id, array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',') AS violations FROM conversations GROUP BY 1"


# state

BATCH = [
    {"table": "review_items", "op": "update", "data": {"status": "paused"}, "where": {"review_category": "click"}},
    {"table": "review_items", "op": "update", "data": {"track": "seen", "priority_score": 0.5}, "where": {"status": "paused", "language": "en"}},
    *({"table": "review_items", "op": "update", "data": {"content": f"w{k}"}, "where": {"id": str(5 * k)}} for k in range(200)),
    *({"table": "review_items", "op": "insert", "data": {"id": f"x{k}", "language": "ja", "status": "paused", "stability": 0.1}} for k in range(50)),
    *({"table": "review_items", "op": "upsert", "key_fields": ["id"], "data": {"id": str(7 * k) if k % 2 else f"x{k}", "stability": 0.9, "track": "again"}} for k in range(100)),
    {"table": "review_items", "op": "update", "data": {"status": "active"}, "where": {"track": "seen", "item_type": "vocab"}},
    {"table": "review_items", "op": "update", "data": {"status": "ignored"}, "where": {"status": "paused", "language": "ja"}},
]


def q_batch_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All review items after a batch whose updates ask for what others of it set."""
    state = State(spark, "unpublished")
    state.changed["review_items"] = rows_of("review_items", Q.review_items(spark, sf_dir))
    state.write(BATCH)
    return state.read("review_items").select("id", "language", "status", "track", "content", F.floor(F.col("stability") * 100 + 0.5).alias("stability"), F.floor(F.col("priority_score") * 10000 + 0.5).alias("priority"))


BATCH_SQL = f"""
    WITH a AS (SELECT id, language, review_category, item_type, CASE WHEN review_category = 'click' THEN 'paused' ELSE status END AS status, NULL::VARCHAR AS track, content, stability, priority_score FROM ({Q.ITEM_SQL})),
    b AS (SELECT * REPLACE (CASE WHEN status = 'paused' AND language = 'en' THEN 'seen' END AS track, CASE WHEN status = 'paused' AND language = 'en' THEN 0.5::DOUBLE ELSE priority_score END AS priority_score,
              CASE WHEN CAST(id AS BIGINT) % 5 = 0 AND CAST(id AS BIGINT) < 1000 THEN 'w' || CAST(CAST(id AS BIGINT) // 5 AS VARCHAR) ELSE content END AS content) FROM a),
    u AS (SELECT CASE WHEN k % 2 = 1 THEN CAST(7 * k AS VARCHAR) ELSE 'x' || k END AS id FROM range(100) t(k)),
    n AS (SELECT * FROM b UNION ALL SELECT 'x' || k, 'ja', NULL, NULL, 'paused', NULL, NULL, 0.1::DOUBLE, NULL FROM range(50) t(k)),
    c AS (SELECT n.* REPLACE (CASE WHEN u.id IS NOT NULL THEN 0.9::DOUBLE ELSE stability END AS stability, CASE WHEN u.id IS NOT NULL THEN 'again' ELSE track END AS track) FROM n LEFT JOIN u USING (id)
          UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'again', NULL, 0.9::DOUBLE, NULL FROM u WHERE id NOT IN (SELECT id FROM n)),
    d AS (SELECT * REPLACE (CASE WHEN track = 'seen' AND item_type = 'vocab' THEN 'active' ELSE status END AS status) FROM c)
    SELECT id, language, CASE WHEN status = 'paused' AND language = 'ja' THEN 'ignored' ELSE status END AS status, track, content, CAST(floor(stability * 100 + 0.5) AS BIGINT) AS stability, CAST(floor(priority_score * 10000 + 0.5) AS BIGINT) AS priority FROM d
"""


def q_review_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, items and profile events after a review pass: sessions of all conversations, reviews of all events, profile events of all documents."""
    state = State(spark, "unpublished")
    events, i = Q.table(spark, sf_dir, "events"), text_of("event_id")
    state.changed = {
        "review_items": rows_of("review_items", Q.review_items(spark, sf_dir)),
        "sessions": rows_of("sessions", Q.sessions(spark, sf_dir)),
        "profile_events": rows_of("profile_events", events.select(i.alias("id"), F.col("event_type").alias("signal"), F.lit("old").alias("evidence"))),
    }
    sessions = Q.table(spark, sf_dir, "conversations").select(text_of("conv_id").alias("id"), F.lit("fr").alias("language"), F.lit("review").alias("session_type")).distinct()
    told = Q.documents(spark, sf_dir).select(text_of("doc_id").alias("id"), F.col("lang").alias("signal"), F.lit("new").alias("evidence"))
    reviews = Q.reviews(spark, sf_dir).join(state.read("review_items").select("id"), "id", "left_semi")
    state.record(rows_of("sessions", sessions), reviews, rows_of("profile_events", told))
    parts = {"sessions": ("language", "track"), "review_items": ("status", F.floor(F.col("interval_days") * 1000 + 0.5).cast("string")), "profile_events": ("signal", "evidence")}
    rows = [state.read(t).select(F.lit(t).alias("kind"), "id", F.col(a).alias("one"), (F.col(b) if isinstance(b, str) else b).alias("two")) for t, (a, b) in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


REVIEW_SQL = f"""
    WITH done AS ({Q.SCHEDULE_FOLD_SQL})
    SELECT 'sessions' AS kind, CAST(conv_id AS VARCHAR) AS id, 'fr' AS one, NULL AS two FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT 'sessions', CAST(event_id AS VARCHAR), CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'ja' END, CASE event_id % 3 WHEN 0 THEN 'live_chat' WHEN 1 THEN 'article_reading' END FROM events WHERE event_id NOT IN (SELECT conv_id FROM conversations)
    UNION ALL SELECT 'profile_events', CAST(doc_id AS VARCHAR), lang, 'new' FROM documents
    UNION ALL SELECT 'profile_events', CAST(event_id AS VARCHAR), event_type, 'old' FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'review_items', id, status, CAST(CAST(floor(interval_days * 1000 + 0.5) AS BIGINT) AS VARCHAR) FROM done
    UNION ALL SELECT 'review_items', id, status, CAST(CAST(floor(interval_days * 1000 + 0.5) AS BIGINT) AS VARCHAR) FROM ({Q.ITEM_SQL}) WHERE id NOT IN (SELECT id FROM done)
"""


def q_profile_on_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' language profiles after each has imported material of one track."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    track = F.when(k % 2 == 0, "live_chat").otherwise("article_reading")
    bias = F.when(k % 3 == 0, F.array(F.lit("live_chat"), segment)).when(k % 3 == 1, F.array(segment))
    after = transcripts.track_profile(track, bias, F.array(segment, F.lit("argument comprehension"), F.lit("chat"), F.lit("x"), F.lit("y")), F.when(k % 5 == 0, "").when(k % 5 == 1, segment))
    joined = lambda c: F.array_join(c, "|") if c is not after["baseline_summary"] else c
    return Q.table(spark, sf_dir, "customer").select(k, *[joined(c).alias(n) for n, c in after.items()])


IMPORT_SQL = """
    WITH t AS (SELECT c_custkey, c_custkey % 2 = 0 AS live, c_mktsegment AS m, CASE c_custkey % 3 WHEN 0 THEN ['live_chat', c_mktsegment] WHEN 1 THEN [c_mktsegment] ELSE [] END AS bias FROM customer),
    l AS (SELECT *, CASE WHEN live THEN 'live_chat' ELSE 'article_reading' END AS track,
        CASE WHEN live THEN ['live_chat chunk integrity', 'spoken scene management', 'dual-platform chat humor'] ELSE ['argument comprehension', 'written connector accuracy', 'claim-support mapping', 'summary paraphrase precision'] END AS new FROM t)
    SELECT c_custkey, array_to_string(list_concat([track], list_filter(bias, lambda x: x <> track)), '|') AS track_bias,
        array_to_string(list_concat(new, list_filter([m, 'argument comprehension', 'chat', 'x', 'y'], lambda x: NOT list_contains(new, x)))[1:6], '|') AS recent_priorities,
        CASE WHEN c_custkey % 5 = 1 THEN m WHEN live THEN 'Learning profile initialized from cleaned live-chat transcript imports.' ELSE 'Learning profile initialized from cleaned reading-style subtitle transcript imports.' END AS baseline_summary
    FROM l
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "paragraph_islands": q_paragraph_islands, "rejected_cues": q_rejected_cues, "session_start": q_session_start, "input_contract": q_input_contract, "delta_contract": q_delta_contract,
        "batch_writes": q_batch_writes, "review_pass": q_review_pass, "profile_on_import": q_profile_on_import,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "paragraph_islands": f"{Q.PARAGRAPHS_SQL} SELECT * FROM paragraph", "rejected_cues": rejected_sql(), "session_start": START_SQL, "input_contract": CONTRACT_SQL, "delta_contract": delta_sql(),
        "batch_writes": BATCH_SQL, "review_pass": REVIEW_SQL, "profile_on_import": IMPORT_SQL,
    }
