"""The library's operators bound to the driver's tables, each with its DuckDB SQL.

The tables have no subtitles and no review state, so the bindings are projections: a document's lines
or a conversation's turns are cues, events are review items, profile events, sessions and reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions import scoring as X
from cuewright.functions import text as T
from cuewright.operators import agenda, cues, folds, profile
from cuewright.schemas import TABLES, columns_of

NOW = "2024-02-05 00:00:00"
SQL_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# review state from events

ITEM_SQL = f"""
    SELECT CAST(event_id AS VARCHAR) AS id, event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'ja' END AS language, event_type AS review_category,
           CASE event_id % 4 WHEN 0 THEN 'chunk' WHEN 1 THEN 'vocab' WHEN 2 THEN 'term' ELSE 'phrase' END AS item_type, 'c' || CAST(event_id AS VARCHAR) AS content,
           ts AS seen, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts + INTERVAL 1 DAY * (event_id % 10) END AS due, CAST(1 + event_id % 30 AS DOUBLE) AS interval_days,
           CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS stability, CASE WHEN event_id % 7 = 0 THEN NULL ELSE least(1.0, greatest(0.0, value / 1000)) END AS priority_score,
           CASE WHEN event_id % 17 = 0 THEN 'paused' WHEN event_id % 19 = 0 THEN 'mastered' ELSE 'active' END AS status, TIMESTAMP '{NOW}' AS now_
    FROM events
"""


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    kind = F.element_at(F.array(*map(F.lit, ["chunk", "vocab", "term", "phrase"])), (i % 4 + 1).cast("int"))
    return e.select(
        i.cast("string").alias("id"), F.when(F.col("user_id") % 2 == 0, "en").otherwise("ja").alias("language"), F.col("event_type").alias("review_category"), kind.alias("item_type"),
        F.concat(F.lit("c"), i.cast("string")).alias("content"), X.format_time(ts).alias("first_seen_at"), X.format_time(ts).alias("last_seen_at"), F.lit(None).cast("string").alias("last_reviewed_at"),
        F.when(i % 13 != 0, X.format_time(X.later(ts, i % 10))).alias("due_at"), (1 + i % 30).cast("double").alias("interval_days"),
        F.when(i % 11 != 0, (i % 100).cast("double") / 100).alias("stability"), F.when(i % 7 != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 1000))).alias("priority_score"),
        F.when(i % 17 == 0, "paused").when(i % 19 == 0, "mastered").otherwise("active").alias("status"),
    )


def pressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda.pressures(review_items(spark, sf_dir), F.lit(NOW).cast("timestamp"))


PRESSED_SQL = f"""
    SELECT id, language, review_category, content, due, coalesce(stability, 0.0) AS stability, coalesce(priority_score, 0.0) AS priority_score,
           floor(greatest(0.0, least(3.0, coalesce(priority_score, 0.0) + CASE WHEN due <= now_ THEN 1.0 WHEN due <= now_ + INTERVAL 1 DAY THEN 0.55 WHEN due <= now_ + INTERVAL 3 DAY THEN 0.25 ELSE 0.0 END
                 + greatest(0.0, 0.45::DOUBLE - coalesce(stability, 0.0)) * 1.2::DOUBLE)) * 10000 + 0.5) / 10000 AS pressure_score,
           coalesce(due <= now_, false) AS overdue, coalesce(due > now_ AND due < now_ + INTERVAL 4 DAY, false) AS due_soon
    FROM ({ITEM_SQL}) WHERE status = 'active'
"""


def ranked_sql(inner: str, order: str, limit: int, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY language ORDER BY {order}) AS INTEGER) AS rank FROM ({inner})) WHERE rank <= {limit}"


def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "vocab_gap").otherwise("output_fragility")
    return table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "en").otherwise("ja").alias("language"), kind.alias("event_type"), F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("signal"), F.round("value", 4).alias("strength"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.when(F.col("event_id") % 3 == 0, "live_chat").when(F.col("event_id") % 3 == 1, "article_reading")
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("user_id") % 2 == 0, "en").otherwise("ja").alias("language"), track.alias("track"), X.format_time(F.col("ts").cast("timestamp")).alias("finished_at"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of items in groups of four neighbouring events: item, order, result, time."""
    i = F.col("event_id")
    result = F.element_at(F.array(*map(F.lit, [*X.RESULTS, "mastered"])), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.floor(i / 4).cast("string").alias("id"), i.alias("ord"), result.alias("result"), F.col("ts").cast("timestamp").alias("reviewed_at"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order)).filter("before is not null")


def document_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's non-empty lines as cues of 3.5 s every 4 s, with a pause of 10 s more after every seventh."""
    lines = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("cue_index", "text"))
    start = 4.0 * F.col("cue_index") + 10.0 * F.floor(F.col("cue_index") / 7)
    return lines.select("source_id", "cue_index", start.alias("start"), (start + 3.5).alias("end"), T.compact(F.col("text")).alias("text"))


def listed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    utterances = folds.ordered(document_cues(spark, sf_dir), "cue_index", "start", "end", "text").withColumnRenamed("items", "utterances")
    return folds.paragraphs(utterances).select("source_id", "paragraphs")


CUES_SQL = rf"""
    SELECT CAST(doc_id AS VARCHAR) AS source_id, i - 1 AS k, 4.0::DOUBLE * (i - 1) + 10.0::DOUBLE * floor((i - 1) / 7) AS s, trim(regexp_replace(l[i], '{SQL_SPACE}+', ' ', 'g')) AS t
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents))
"""
PARAGRAPHS_SQL = rf"""
    WITH cue AS ({CUES_SQL}),
    listed AS (SELECT source_id, list({{'s': s, 'e': s + 3.5::DOUBLE, 't': t, 'w': CAST(len(list_filter(string_split_regex(t, '{SQL_SPACE}+'), lambda x: x <> '')) AS INTEGER)}} ORDER BY k) AS us FROM cue GROUP BY 1),
    marked AS (
        SELECT source_id, us, list_reduce(list_transform(us, lambda u: {{'e': u.e, 's': u.s, 'w': u.w, 'stop': regexp_matches(u.t, '[.!?]["'')\]]*\n?\z'), 'words': 0, 'p': [0]}}),
            lambda a, u: CASE WHEN len(a.p) > 1 AND (u.s - a.e >= 8 OR a.words = 0) OR u.s - a.e >= 8
                THEN {{'e': u.e, 's': u.s, 'w': u.w, 'stop': u.stop, 'words': CASE WHEN u.w >= 140 OR (u.w >= 85 AND u.stop) THEN 0 ELSE u.w END, 'p': list_append(a.p, a.p[-1] + 1)}}
                ELSE {{'e': u.e, 's': u.s, 'w': u.w, 'stop': u.stop, 'words': CASE WHEN a.words + u.w >= 140 OR (a.words + u.w >= 85 AND u.stop) THEN 0 ELSE a.words + u.w END, 'p': list_append(a.p, a.p[-1])}} END,
            {{'e': -1.0::DOUBLE, 's': -1.0::DOUBLE, 'w': 0, 'stop': false, 'words': 0, 'p': [0]}}).p AS p FROM listed),
    rows_ AS (SELECT source_id, us[i] AS u, p[i + 1] AS g, i FROM (SELECT source_id, us, p, unnest(range(1, len(us) + 1)) AS i FROM marked)),
    paragraph AS (SELECT source_id, CAST(dense_rank() OVER (PARTITION BY source_id ORDER BY g) - 1 AS INTEGER) AS paragraph_index, min(u.s) AS "start", max(u.e) AS "end", string_agg(u.t, ' ' ORDER BY i) AS text, CAST(sum(u.w) AS INTEGER) AS "wordCount" FROM rows_ GROUP BY source_id, g)
"""


def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_paragraphs(spark, sf_dir).select("source_id", F.posexplode("paragraphs").alias("paragraph_index", "p")).select("source_id", "paragraph_index", "p.*")


def segments_of(track: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: folds.segments(listed_paragraphs(spark, sf_dir), F.lit(track)).select("source_id", "segmentIndex", "start", "end", "startRef", "endRef", "wordCount", "text")


def segments_sql(test: str) -> str:
    clock = lambda s: f"lpad(CAST(CAST(floor({s}) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({s}) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({s}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"
    return rf"""{PARAGRAPHS_SQL},
    listed_p AS (SELECT source_id, list({{'s': "start", 'e': "end", 't': text, 'w': "wordCount"}} ORDER BY paragraph_index) AS ps FROM paragraph GROUP BY 1),
    cut AS (SELECT source_id, ps, list_reduce(list_transform(ps, lambda x: {{'s': x.s, 'e': x.e, 'w': x.w, 'words': 0, 'n': 0, 'of': [1]}}),
        lambda a, x: CASE WHEN a.n > 0 AND ({test}) THEN {{'s': x.s, 'e': x.e, 'w': x.w, 'words': x.w, 'n': 1, 'of': list_append(a.of, a.of[-1] + 1)}}
                     ELSE {{'s': x.s, 'e': x.e, 'w': x.w, 'words': a.words + x.w, 'n': a.n + 1, 'of': list_append(a.of, a.of[-1])}} END,
        {{'s': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'w': 0, 'words': 0, 'n': 0, 'of': [1]}}).of AS o FROM listed_p),
    each AS (SELECT source_id, ps[i] AS x, o[i + 1] AS g, i FROM (SELECT source_id, ps, o, unnest(range(1, len(ps) + 1)) AS i FROM cut))
    SELECT source_id, CAST(g AS INTEGER) AS "segmentIndex", min(x.s) AS "start", max(x.e) AS "end", {clock('min(x.s)')} AS "startRef", {clock('max(x.e)')} AS "endRef", CAST(sum(x.w) AS INTEGER) AS "wordCount", string_agg(x.t, chr(10) || chr(10) ORDER BY i) AS text
    FROM each GROUP BY source_id, g"""


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written out as SubRip text."""
    stamp = lambda s: F.concat(T.clock(s), F.lit(","), F.lpad(((s * 1000) % 1000).cast("int").cast("string"), 3, "0"))
    cue = F.concat_ws("\n", (F.col("cue_index") + 1).cast("string"), F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end"))), F.col("text"))
    return document_cues(spark, sf_dir).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_index", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("raw_text")).withColumn("format", F.lit("srt"))


def q_srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = cues.parse_cues(srt_files(spark, sf_dir))
    return found


def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("int").alias("cue_index"), (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 3.5).alias("end"), T.compact(F.col("text")).alias("text"))
    cleaned = folds.clean(own)
    return cleaned.select("source_id", "raw", "deduped", "merged", F.posexplode("utterances").alias("utterance_index", "u")).select("source_id", "utterance_index", "u.*", "raw", "deduped", "merged")


def contexts_of(track: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: folds.segments(listed_paragraphs(spark, sf_dir), F.lit(track)).select("source_id", "segmentIndex", "sceneSummary", "contextBefore", "contextAfter")


LIVE_SPLIT = "a.words >= 460 OR (a.words >= 340 AND (a.n >= 4 OR x.s - a.e >= 40)) OR (a.words >= 260 AND x.s - a.e >= 90)"
ARTICLE_SPLIT = "a.words >= 560 OR (a.words >= 340 AND a.n >= 3) OR (a.words >= 260 AND a.n >= 2 AND x.s - a.e >= 20)"


def contexts_sql(split: str, track: str) -> str:
    """Summaries by rule or first sentence, and those of the neighbours."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    clipped = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n - 1})) || '...' END"
    found = rf"regexp_extract(text, '[^\n]*?[.!?](?:{SQL_SPACE}|\z)', 0)"
    bare = rf"regexp_replace(f, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"
    if track == "article_reading":
        summary = f"'Argument unit ' || no || ': ' || {clipped('g', 150)}"
        inner = f"SELECT *, {compact_sql(f'CASE WHEN f <> {quoted(str())} THEN {bare} ELSE text END')} AS g FROM (SELECT *, {found} AS f FROM seg)"
    else:
        rules = " ".join(f"WHEN {' AND '.join([*(f'contains(lower(text), {quoted(w)})' for w in every), '(' + ' OR '.join(f'contains(lower(text), {quoted(w)})' for w in some) + ')'])} THEN {quoted(by)}" for every, some, by in T.LIVE_CHAT_RULES)
        summary = f"CASE {rules} ELSE 'Live-chat segment ' || no || ': ' || CASE WHEN f <> '' THEN {bare} ELSE {clipped('g', 120)} END END"
        inner = f"SELECT *, {found} AS f, {compact_sql('text')} AS g FROM seg"
    first, last = (quoted(x) for x in folds.EDGES[track])
    return f"""
        WITH seg AS (SELECT *, CASE WHEN "segmentIndex" < 10 THEN '0' ELSE '' END || CAST("segmentIndex" AS VARCHAR) AS no FROM ({segments_sql(split)})),
        told AS (SELECT source_id, "segmentIndex", {summary} AS "sceneSummary" FROM ({inner}))
        SELECT *, coalesce(lag("sceneSummary") OVER w, {first}) AS "contextBefore", coalesce(lead("sceneSummary") OVER w, {last}) AS "contextAfter" FROM told WINDOW w AS (PARTITION BY source_id ORDER BY "segmentIndex")
    """


def q_schedule_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id").cast("long")
    result = F.element_at(F.array(*map(F.lit, [*X.RESULTS, "mastered"])), (i % 5 + 1).cast("int"))
    next_ = X.schedule(result, F.col("interval_days"), F.col("stability"), F.col("priority_score"), F.lit(NOW).cast("timestamp"))
    return review_items(spark, sf_dir).select("id", next_.alias("n")).select("id", *[(F.floor(F.col(f"n.{c}") * 1e6 + 0.5) / 1e6).alias(c) for c in ("interval_days", "stability", "priority_score")], F.col("n.status").alias("status"), F.floor(F.unix_micros("n.due_at") / 1_000_000).alias("due_s"))


SCHEDULE_SQL = f"""
    WITH p AS (SELECT id, event_id % 5 AS r, interval_days AS i, coalesce(stability, 0.3::DOUBLE) AS s, coalesce(priority_score, 0.5::DOUBLE) AS p FROM ({ITEM_SQL})),
    a AS (SELECT *, CASE r WHEN 0 THEN greatest(0.25::DOUBLE, i * 0.5::DOUBLE) WHEN 1 THEN greatest(1.0::DOUBLE, i * 1.35::DOUBLE) WHEN 2 THEN greatest(1.0::DOUBLE, i * 2.2::DOUBLE) WHEN 3 THEN greatest(2.0::DOUBLE, i * 3.6::DOUBLE) END AS raw,
            greatest(0.05::DOUBLE, least(1.0::DOUBLE, CASE r WHEN 0 THEN s - 0.16::DOUBLE WHEN 1 THEN s + 0.03::DOUBLE WHEN 2 THEN s + 0.12::DOUBLE WHEN 3 THEN s + 0.2::DOUBLE ELSE greatest(s, 0.92::DOUBLE) END)) AS ns FROM p)
    SELECT id, floor(CASE WHEN r = 4 THEN greatest(7.0::DOUBLE, least(180.0::DOUBLE, greatest(i, 7.0::DOUBLE))) ELSE greatest(0.25::DOUBLE, least(180.0::DOUBLE, raw)) END * 1e6 + 0.5) / 1e6 AS interval_days, floor(ns * 1e6 + 0.5) / 1e6 AS stability,
        floor(CASE WHEN r = 4 THEN least(p, 0.2::DOUBLE) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, p + CASE r WHEN 0 THEN 0.18::DOUBLE WHEN 1 THEN 0.08::DOUBLE WHEN 2 THEN -0.05::DOUBLE ELSE -0.12::DOUBLE END + greatest(0.0::DOUBLE, 0.4::DOUBLE - ns) * 0.25::DOUBLE)) END * 1e6 + 0.5) / 1e6 AS priority_score,
        CASE WHEN r = 4 THEN 'mastered' ELSE 'active' END AS status,
        CAST(CASE WHEN r = 4 THEN NULL ELSE epoch(TIMESTAMP '{NOW}') + CASE WHEN r = 0 THEN 21600 ELSE floor(round(raw * 86400000000) / 1000000) END END AS BIGINT) AS due_s
    FROM a
"""


def q_schedule_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = profile.review_fold(review_items(spark, sf_dir), reviews(spark, sf_dir))
    return done.select("id", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("interval_days", "stability", "priority_score")], "status")


SCHEDULE_FOLD_SQL = f"""
    WITH RECURSIVE review AS (SELECT CAST(event_id // 4 AS VARCHAR) AS id, event_id % 5 AS r, row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id) AS k FROM events),
    f AS (
        SELECT id, 0::BIGINT AS k, interval_days AS i, stability AS s, priority_score AS p, status FROM ({ITEM_SQL})
        UNION ALL
        SELECT id, k, CASE WHEN r = 4 THEN greatest(7.0::DOUBLE, least(180.0::DOUBLE, greatest(i, 7.0::DOUBLE))) ELSE greatest(0.25::DOUBLE, least(180.0::DOUBLE, raw)) END, ns,
            CASE WHEN r = 4 THEN greatest(0.0::DOUBLE, least(p, 0.2::DOUBLE)) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, p + CASE r WHEN 0 THEN 0.18::DOUBLE WHEN 1 THEN 0.08::DOUBLE WHEN 2 THEN -0.05::DOUBLE ELSE -0.12::DOUBLE END + greatest(0.0::DOUBLE, 0.4::DOUBLE - ns) * 0.25::DOUBLE)) END,
            CASE WHEN r = 4 THEN 'mastered' ELSE 'active' END
        FROM (SELECT *, CASE r WHEN 0 THEN greatest(0.25::DOUBLE, i * 0.5::DOUBLE) WHEN 1 THEN greatest(1.0::DOUBLE, i * 1.35::DOUBLE) WHEN 2 THEN greatest(1.0::DOUBLE, i * 2.2::DOUBLE) ELSE greatest(2.0::DOUBLE, i * 3.6::DOUBLE) END AS raw,
                  greatest(0.05::DOUBLE, least(1.0::DOUBLE, CASE r WHEN 0 THEN s - 0.16::DOUBLE WHEN 1 THEN s + 0.03::DOUBLE WHEN 2 THEN s + 0.12::DOUBLE WHEN 3 THEN s + 0.2::DOUBLE ELSE greatest(s, 0.92::DOUBLE) END)) AS ns
              FROM (SELECT f.id, review.k, r, coalesce(i, 1.0::DOUBLE) AS i, coalesce(s, 0.3::DOUBLE) AS s, coalesce(p, 0.5::DOUBLE) AS p FROM f JOIN review ON review.id = f.id AND review.k = f.k + 1))
    )
    SELECT id, floor(arg_max(i, k) * 1e6 + 0.5) / 1e6 AS interval_days, floor(arg_max(s, k) * 1e6 + 0.5) / 1e6 AS stability, floor(arg_max(p, k) * 1e6 + 0.5) / 1e6 AS priority_score, arg_max(status, k) AS status
    FROM f WHERE id IN (SELECT id FROM review) GROUP BY id
"""


def q_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources made from all customers, upserted by those made from all documents: ids of both are replaced, the others stay or are new."""
    from cuewright.plans.state import State

    def rows(name: str, id_: str, language: F.Column) -> DataFrame:
        own = {"id": F.col(id_).cast("string"), "language": language, "title": F.lit(name)}
        return table(spark, sf_dir, name).select(*[own.get(c, F.lit(None).cast("string")).alias(c) for c in columns_of("sources")])

    state = State(spark, "unpublished")
    state.changed["sources"] = rows("customer", "c_custkey", F.col("c_mktsegment"))
    state.merge("sources", rows("documents", "doc_id", F.col("lang")))
    return state.read("sources").select("id", "language", "title")


def q_replace_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live-chat segments of all documents, replaced by a second import on the other track; one segment of each customer stays."""
    from cuewright.plans.transcripts import replaced_segments

    def cut(track: str) -> DataFrame:
        return folds.segments(listed_paragraphs(spark, sf_dir), F.lit(track)).withColumn("segment_path", F.lit("p"))

    def replaced(old: DataFrame, new: DataFrame, at: str) -> DataFrame:
        return replaced_segments(old, new, documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id")), at)

    own = {"source_id": F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "segment_index": F.lit(1), "created_at": F.lit("old")}
    kept = table(spark, sf_dir, "customer").select(*[own.get(c, F.lit(None).cast("string")).alias(c) for c in columns_of("segments")])
    return replaced(replaced(kept, cut("live_chat"), "old"), cut("article_reading"), "new").select("source_id", "segment_index", "created_at")


def q_status(operation: dict) -> Callable[[SparkSession, str], DataFrame]:
    """All review items after a user action on the state tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from cuewright.plans.state import State

        state = State(spark, "unpublished")
        state.changed |= {"review_items": review_items(spark, sf_dir), "user_actions": spark.createDataFrame([], TABLES["user_actions"])}
        state.change([operation])
        return state.read("review_items").select("id", "status")

    return run


def flag(df: DataFrame, key: str, **columns) -> DataFrame:
    return df.select(key, *[c.alias(n) for n, c in columns.items()])


def q_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", T.word_overlap(F.col("before"), F.col("text")).alias("overlap"), T.remove_overlap(F.col("before"), F.col("text")).alias("rest"))


def chained_sql(x: str) -> str:
    for pattern, by in T.CUE_MARKUP:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return x


def entities_sql(x: str) -> str:
    for entity, character in T.ENTITIES:
        x = f"replace({x}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return x


def compact_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_SPACE}+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SQL_SPACE}+'), lambda x: x <> '')"


OVERLAP_SQL = f"""
    WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    w AS (SELECT *, {words_sql('lower(before)')} AS p, {words_sql('lower(text)')} AS c, {words_sql('text')} AS o FROM t WHERE before IS NOT NULL),
    k AS (SELECT *, CAST(coalesce(list_max(list_filter(range(1, least(len(p), len(c)) + 1), lambda k: p[len(p) - k + 1 : len(p)] = c[1:k])), 0) AS INTEGER) AS overlap FROM w)
    SELECT conv_id, turn, overlap, CASE WHEN before = '' THEN text WHEN suffix(lower(before), lower(text)) THEN '' WHEN overlap = 0 THEN text ELSE array_to_string(o[overlap + 1 : len(o)], ' ') END AS rest FROM k
"""
CONTINUES = "|".join(T.CONTINUATIONS)


def clean_sql(conversations: str = "conversations") -> str:
    """The cleaning fold, one cue a step: the state after each cue, of which each utterance's last one counts."""
    overlap = lambda p, c: f"coalesce(list_max(list_filter(range(1, least(len({p}), len({c})) + 1), lambda k: {p}[len({p}) - k + 1 : len({p})] = {c}[1:k])), 0)"
    more = lambda b, t, words, k: f"CASE WHEN {b} = '' THEN {t} WHEN suffix(lower({b}), lower({t})) THEN '' WHEN {k} = 0 THEN {t} ELSE array_to_string({words}[{k} + 1 : len({words})], ' ') END"
    stop = lambda marks: f"regexp_matches(b, '[{marks}][\"'')\\]]*\\n?\\z')"
    edge = r"(?:[^0-9A-Za-z_\x{80}-\x{10FFFF}]|\z)"
    return f"""
        WITH RECURSIVE cue AS (SELECT CAST(conv_id AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn * 4.0::DOUBLE AS s, turn * 4.0::DOUBLE + 3.5::DOUBLE AS e, coalesce({compact_sql('text')}, '') AS t FROM {conversations}),
        word AS (SELECT *, {words_sql('t')} AS o, {words_sql('lower(t)')} AS c FROM cue),
        f AS (
            SELECT source_id, k, 0 AS u, s, e, t, c AS w, 0 AS d, 0 AS m FROM word WHERE k = 1
            UNION ALL
            SELECT source_id, k, CASE WHEN how = 2 THEN u + 1 ELSE u END, CASE WHEN how = 2 THEN s2 ELSE s END, e2,
                CASE WHEN how = 2 THEN n1 WHEN how = 1 AND n2 <> '' THEN {compact_sql("b || ' ' || n2")} ELSE b END,
                CASE WHEN how = 2 THEN c1 WHEN how = 1 AND n2 <> '' THEN list_concat(w, c1[k2 + 1 : len(c1)]) ELSE w END,
                d + CASE WHEN how = 0 THEN 1 ELSE 0 END, m + CASE WHEN how = 1 THEN 1 ELSE 0 END
            FROM (SELECT *, {more('b', 'n1', 'o1', 'k2')} AS n2,
                      CASE WHEN n1 = '' OR lower(b) = lower(t) THEN 0
                           WHEN (k1 > 0 AND NOT {stop('.!?')}) OR (b <> '' AND NOT {stop('.!?')} AND ({stop(',;:')} OR regexp_matches(n1, '^[a-z]') OR regexp_matches(n1, '(?i)^(?:{CONTINUES}){edge}') OR (len(w) <= 4 AND regexp_matches(n1, '^[a-zA-Z]')))) THEN 1 ELSE 2 END AS how
                  FROM (SELECT *, {overlap('w', 'c1')} AS k2 FROM (SELECT *, o[k1 + 1 : len(o)] AS o1, c[k1 + 1 : len(c)] AS c1, {more('b', 't', 'o', 'k1')} AS n1
                        FROM (SELECT f.source_id, f.u, f.s, f.t AS b, f.w, f.d, f.m, n.k, n.s AS s2, n.e AS e2, n.t, n.o, n.c, {overlap('f.w', 'n.c')} AS k1 FROM f JOIN word n ON n.source_id = f.source_id AND n.k = f.k + 1))))
        ),
        ended AS (SELECT source_id, CAST(max(k) AS INTEGER) AS raw, arg_max(d, k) AS deduped, arg_max(m, k) AS merged FROM f GROUP BY 1)
        SELECT source_id, u AS utterance_index, s AS "start", e AS "end", t AS text, raw, deduped, merged
        FROM (SELECT source_id, u, arg_max(s, k) AS s, arg_max(e, k) AS e, arg_max(t, k) AS t FROM f GROUP BY 1, 2) JOIN ended USING (source_id)
    """


def file_name() -> F.Column:
    """A subtitle file's name for each page, bracketed id or not."""
    return F.concat(F.lit("Talk "), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("[a-"), F.col("page_id").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("n"), F.col("page_id").cast("string"))), F.when(F.col("page_id") % 2 == 0, ".en-US.srt").otherwise(".de.vtt"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = documents
    items, signals = review_items, profile_events
    mode_columns = ["language", "rank", "id", "pressure_score"]
    return {
        "markup_strip": lambda s, d: flag(table(s, d, "pages"), "page_id", clean=T.strip_cue_markup(F.col("html"))),
        "entity_decode": lambda s, d: flag(table(s, d, "pages"), "page_id", decoded=T.decode_entities(F.col("html"))),
        "style_strip": lambda s, d: flag(docs(s, d), "doc_id", clean=T.strip_style_markup(F.col("text"))),
        "stop_flags": lambda s, d: flag(docs(s, d), "doc_id", strong=T.ends_strongly(F.col("text")), soft=T.ends_softly(F.col("text"))),
        "continuation": lambda s, d: flag(docs(s, d), "doc_id", continues=T.starts_with_continuation(F.col("text")), shifts=T.starts_with_topic_shift(F.col("text"))),
        "word_count": lambda s, d: flag(docs(s, d), "doc_id", words=T.word_count(F.col("text"))),
        "first_sentence": lambda s, d: flag(docs(s, d), "doc_id", sentence=T.first_sentence(F.col("text"))),
        "clip_summary": lambda s, d: flag(docs(s, d), "doc_id", clipped=T.clip(F.col("text"))),
        "ascii_label": lambda s, d: flag(docs(s, d), "doc_id", label=T.ascii_label(F.col("text"))),
        "source_id": lambda s, d: flag(table(s, d, "pages"), "page_id", source_id=T.source_id(file_name()), stem=T.strip_subtitle_extension(file_name())),
        "noise_filter": lambda s, d: flag(table(s, d, "conversations"), "conv_id", turn=F.col("turn"), noise=T.is_noise(F.col("text"))),
        "word_overlap": q_word_overlap,
        "timestamp_parse": lambda s, d: flag(table(s, d, "events"), "event_id", seconds=cues.parse_timestamp(F.format_string("%02d:%02d:%02d.%03d", F.col("event_id") % 120, F.col("event_id") % 60, F.col("user_id") % 60, F.col("event_id") % 1000)), clock=T.clock(F.col("event_id").cast("double"))),
        "srt_parse": q_srt_parse,
        "clean_fold": q_clean,
        "paragraphs": q_paragraphs,
        "segments_live": segments_of("live_chat"),
        "segments_article": segments_of("article_reading"),
        "segment_context": contexts_of("live_chat"),
        "segment_context_article": contexts_of("article_reading"),
        "pressure": lambda s, d: pressed(s, d).select("id", "pressure_score", "overdue", "due_soon"),
        "agenda_counts": lambda s, d: agenda.counts(pressed(s, d)),
        "focus_groups": lambda s, d: agenda.focus_groups(pressed(s, d)),
        "item_preview": lambda s, d: agenda.item_preview(pressed(s, d)).select(mode_columns),
        "overdue_preview": lambda s, d: agenda.due_preview(pressed(s, d), "overdue").select(mode_columns),
        "due_soon_preview": lambda s, d: agenda.due_preview(pressed(s, d), "due_soon").select(mode_columns),
        "recommended_mode": lambda s, d: agenda.recommended_mode(pressed(s, d)),
        "days_since_last": lambda s, d: agenda.days_since_last(sessions(s, d), F.lit(NOW).cast("timestamp")),
        "schedule_once": q_schedule_once,
        "schedule_fold": q_schedule_fold,
        "top_signals": lambda s, d: profile.top_signals(signals(s, d), "output_fragility"),
        "top_chunks": lambda s, d: profile.top_chunks(items(s, d)).select("language", "rank", "content"),
        "vocab_gaps": lambda s, d: profile.vocab_gaps(signals(s, d), items(s, d)),
        "track_bias": lambda s, d: profile.track_bias(sessions(s, d)),
        "recent_priorities": lambda s, d: profile.recent_priorities(items(s, d)),
        "active_languages": lambda s, d: profile.active_languages(docs(s, d).select(F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, "active").otherwise("archived").alias("status")), sessions(s, d)),
        "outcome_counts": lambda s, d: profile.outcome_counts(reviews(s, d)),
        "ordered_union": lambda s, d: flag(docs(s, d), "doc_id", merged=F.array_join(profile.ordered_union(F.array(F.lit("live_chat"), "lang"), F.array("source", "lang", F.lit("live_chat")), 3), ",")),
        "upsert_sources": q_state_upsert,
        "replace_segments": q_replace_segments,
        "item_status": q_status({"action": "mark_item_not_useful", "item_ids": ["5", "17", "34"]}),
        "category_status": q_status({"action": "set_category_status", "language": "en", "review_category": "click", "status": "paused"}),
    }


def oracle_sql() -> dict[str, str]:
    pages, docs = "FROM pages", "FROM documents"
    name = "'Talk ' || CASE WHEN page_id % 3 = 0 THEN '[a-' || page_id || ']' ELSE 'n' || page_id END || CASE WHEN page_id % 2 = 0 THEN '.en-US.srt' ELSE '.de.vtt' END"
    style = "text"
    for pattern, by in T.STYLE_MARKUP:
        style = f"regexp_replace({style}, '{pattern}', '{by}', 'g')"
    clip = "CASE WHEN length(c) <= 160 THEN c ELSE rtrim(substr(c, 1, 159)) || '...' END"
    stop = "[\"'')\\]]*\\n?\\z"
    edge = r"(?:[^0-9A-Za-z_\x{80}-\x{10FFFF}]|\z)"
    signal = "SELECT CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'ja' END AS language, CASE WHEN event_id % 3 = 0 THEN 'vocab_gap' ELSE 'output_fragility' END AS event_type, event_type || '-' || CAST(user_id % 50 AS VARCHAR) AS signal, round(value, 4) AS strength FROM events"
    grouped = lambda kind: f"SELECT language, signal, CAST(coalesce(sum(CAST(strength AS DECIMAL(30,6))), 0) AS DOUBLE) AS total_strength, count(*) AS hits FROM ({signal}) WHERE event_type = '{kind}' GROUP BY 1, 2"
    contents = lambda types, statuses: f"SELECT language, content, coalesce(priority_score, 0.0) AS priority, seen, id FROM ({ITEM_SQL}) WHERE item_type IN ({types}) AND status IN ({statuses})"
    session = "SELECT CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'ja' END AS language, CASE event_id % 3 WHEN 0 THEN 'live_chat' WHEN 1 THEN 'article_reading' END AS track, ts FROM events"
    shown = ranked_sql(PRESSED_SQL, "pressure_score DESC, coalesce(due, TIMESTAMP '0001-01-01'), priority_score DESC, id", 5, "*")
    late = ranked_sql(f"SELECT * FROM ({PRESSED_SQL}) WHERE overdue", "due, pressure_score DESC, id", 5, "*")
    columns = "language, rank, id, pressure_score"
    return {
        "markup_strip": f"SELECT page_id, {compact_sql(entities_sql(chained_sql('html')))} AS clean {pages}",
        "entity_decode": f"SELECT page_id, {entities_sql('html')} AS decoded {pages}",
        "style_strip": f"SELECT doc_id, {compact_sql(entities_sql(style))} AS clean {docs}",
        "stop_flags": f"SELECT doc_id, regexp_matches(text, '[.!?]{stop}') AS strong, regexp_matches(text, '[,;:]{stop}') AS soft {docs}",
        "continuation": f"SELECT doc_id, regexp_matches(text, '(?i)^(?:{CONTINUES}){edge}') AS continues, regexp_matches(text, '(?i)^(?:{'|'.join(T.TOPIC_SHIFTS).replace(chr(39), chr(39) * 2)})') AS shifts {docs}",
        "word_count": f"SELECT doc_id, CAST(len({words_sql('text')}) AS INTEGER) AS words {docs}",
        "first_sentence": rf"SELECT doc_id, regexp_extract(text, '[^\n]*?[.!?](?:{SQL_SPACE}|\z)', 0) AS sentence {docs}",
        "clip_summary": f"SELECT doc_id, {clip} AS clipped FROM (SELECT doc_id, {compact_sql('text')} AS c {docs})",
        "ascii_label": rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\x20-\x7E]+', ' ', 'g'), ' +', ' ', 'g')) AS label {docs}",
        "source_id": rf"SELECT page_id, CASE WHEN n LIKE '%[%' THEN regexp_extract(n, '\[([A-Za-z0-9_-]+)\][^\[]*$', 1) ELSE regexp_replace(regexp_replace(n, '\.[^.]+$', ''), '(?i)(?:\.[a-z]{{2}}(?:-[A-Za-z]+)?)+$', '') END AS source_id, regexp_replace(n, '(?i)(?:\.[a-z]{{2}}(?:-[A-Za-z]+)?)?\.(?:srt|vtt|ass|ssa)$', '') AS stem FROM (SELECT page_id, {name} AS n {pages})",
        "noise_filter": f"SELECT conv_id, turn, lower({compact_sql('text')}) IN ({', '.join(repr(n) for n in T.NOISE)}) AS noise FROM conversations",
        "word_overlap": OVERLAP_SQL,
        "timestamp_parse": "SELECT event_id, CAST((event_id % 120) * 3600 + (event_id % 60) * 60 + user_id % 60 AS DOUBLE) + CAST(event_id % 1000 AS DOUBLE) / 1000 AS seconds, lpad(CAST(event_id // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS clock FROM events",
        "srt_parse": f"SELECT source_id, CAST(k AS INTEGER) AS cue_index, s AS \"start\", s + 3.5::DOUBLE AS \"end\", t AS text FROM ({CUES_SQL})",
        "paragraphs": f"{PARAGRAPHS_SQL} SELECT * FROM paragraph",
        "segments_live": segments_sql(LIVE_SPLIT),
        "segments_article": segments_sql(ARTICLE_SPLIT),
        "segment_context": contexts_sql(LIVE_SPLIT, "live_chat"),
        "segment_context_article": contexts_sql(ARTICLE_SPLIT, "article_reading"),
        "clean_fold": clean_sql(),
        "schedule_fold": SCHEDULE_FOLD_SQL,
        "pressure": f"SELECT id, pressure_score, overdue, due_soon FROM ({PRESSED_SQL})",
        "agenda_counts": f"SELECT language, count_if(overdue) AS overdue_items, count_if(due_soon) AS due_soon_items FROM ({PRESSED_SQL}) GROUP BY 1",
        "focus_groups": ranked_sql(f"SELECT language, review_category, count(*) AS count, max(priority_score) AS max_priority, CAST(sum(CAST(pressure_score AS DECIMAL(20,4))) AS DOUBLE) AS pressure_score FROM ({PRESSED_SQL}) GROUP BY 1, 2", "pressure_score DESC, max_priority DESC, count DESC, review_category", 3, "*"),
        "item_preview": f"SELECT {columns} FROM ({shown})",
        "overdue_preview": f"SELECT {columns} FROM ({late})",
        "due_soon_preview": ranked_sql(f"SELECT * FROM ({PRESSED_SQL}) WHERE due_soon", "due, pressure_score DESC, id", 5, columns),
        "recommended_mode": f"SELECT c.language, CASE WHEN o >= 3 OR (o >= 1 AND u >= 1.5) THEN 'review_first' WHEN o >= 1 OR n >= 3 OR p >= 1.0 THEN 'mixed' ELSE 'new_content_first' END AS recommended_mode FROM (SELECT language, count_if(overdue) AS o, count_if(due_soon) AS n FROM ({PRESSED_SQL}) GROUP BY 1) c LEFT JOIN (SELECT language, max(pressure_score) AS u FROM ({late}) GROUP BY 1) l USING (language) LEFT JOIN (SELECT language, max(pressure_score) AS p FROM ({shown}) GROUP BY 1) s USING (language)",
        "days_since_last": f"SELECT language, CAST(greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(max(ts))) / 86400)) AS BIGINT) AS days_since_last_session FROM ({session}) GROUP BY 1",
        "schedule_once": SCHEDULE_SQL,
        "top_signals": ranked_sql(grouped("output_fragility"), "total_strength DESC, hits DESC, signal", 5, "*"),
        "top_chunks": ranked_sql(contents("'chunk'", "'active', 'mastered'"), "priority DESC, seen DESC, id", 8, "language, rank, content"),
        "vocab_gaps": ranked_sql(grouped("vocab_gap"), "total_strength DESC, hits DESC, signal", 6, "language, rank, signal AS gap"),
        "track_bias": f"SELECT language, track, hits, rank FROM ({ranked_sql(f'SELECT language, track, count(*) AS hits FROM ({session}) GROUP BY 1, 2', 'hits DESC, track NULLS FIRST', 3, '*')}) WHERE track IS NOT NULL",
        "recent_priorities": ranked_sql(f"SELECT language, review_category, count(*) AS hits, max(coalesce(priority_score, 0.0)) AS max_priority FROM ({ITEM_SQL}) WHERE status = 'active' GROUP BY 1, 2", "max_priority DESC, hits DESC, review_category", 3, "*"),
        "active_languages": "SELECT lang AS language FROM documents WHERE doc_id % 2 = 0 UNION SELECT CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'ja' END FROM events",
        "outcome_counts": "SELECT CASE event_id % 5 WHEN 0 THEN 'again' WHEN 1 THEN 'hard' WHEN 2 THEN 'good' WHEN 3 THEN 'easy' ELSE 'mastered' END AS result, count(*) AS n FROM events GROUP BY 1",
        "ordered_union": "SELECT doc_id, 'live_chat,' || lang || ',' || source AS merged FROM documents",
        "upsert_sources": "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, 'documents' AS title FROM documents UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_mktsegment, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)",
        "replace_segments": f"SELECT source_id, \"segmentIndex\" AS segment_index, 'new' AS created_at FROM ({segments_sql(ARTICLE_SPLIT)}) UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 1, 'old' FROM customer",
        "item_status": f"SELECT id, CASE WHEN id IN ('5', '17', '34') THEN 'ignored' ELSE status END AS status FROM ({ITEM_SQL})",
        "category_status": f"SELECT id, CASE WHEN language = 'en' AND review_category = 'click' THEN 'paused' ELSE status END AS status FROM ({ITEM_SQL})",
    }
