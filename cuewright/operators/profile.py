"""The learner profile rebuilt from state, for all languages at once.

Empty values take up a place among the first k and are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.operators.agenda import top


def filled(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def top_signals(events: DataFrame, event_type: str, limit: int = 5) -> DataFrame:
    strength = F.coalesce(F.sum(F.col("strength").cast("decimal(30,6)")), F.lit(0)).cast("double")
    grouped = events.filter(F.col("event_type") == event_type).groupBy("language", "signal").agg(strength.alias("total_strength"), F.count("*").alias("hits"))
    return top(grouped, limit, F.desc("total_strength"), F.desc("hits"), F.asc_nulls_first("signal")).filter(filled("signal"))


def top_contents(items: DataFrame, types: list[str], statuses: list[str], limit: int) -> DataFrame:
    chosen = items.filter(F.col("item_type").isin(types) & F.col("status").isin(statuses)).select("language", "id", "content", F.coalesce("priority_score", F.lit(0.0)).alias("priority"), F.coalesce("last_seen_at", "first_seen_at").alias("seen"))
    return top(chosen, limit, F.desc("priority"), F.desc("seen"), F.asc("id")).filter(filled("content"))


def top_chunks(items: DataFrame, limit: int = 8) -> DataFrame:
    return top_contents(items, ["chunk"], ["active", "mastered"], limit)


def vocab_gaps(events: DataFrame, items: DataFrame, limit: int = 6) -> DataFrame:
    """language, rank, gap: signalled gaps, or where a language has none, its active words and terms."""
    signalled = top_signals(events, "vocab_gap", limit).select("language", "rank", F.col("signal").alias("gap"))
    words = top_contents(items, ["vocab", "term"], ["active"], limit).select("language", "rank", F.col("content").alias("gap"))
    return signalled.unionByName(words.join(signalled.select("language").distinct(), "language", "left_anti"))


def track_bias(sessions: DataFrame, limit: int = 3) -> DataFrame:
    return top(sessions.groupBy("language", "track").agg(F.count("*").alias("hits")), limit, F.desc("hits"), F.asc_nulls_first("track")).filter(filled("track"))


def recent_priorities(items: DataFrame, limit: int = 3) -> DataFrame:
    grouped = items.filter("status = 'active'").groupBy("language", "review_category").agg(F.count("*").alias("hits"), F.max(F.coalesce("priority_score", F.lit(0.0))).alias("max_priority"))
    return top(grouped, limit, F.desc("max_priority"), F.desc("hits"), F.asc_nulls_first("review_category")).filter(filled("review_category"))


def active_languages(sources: DataFrame, sessions: DataFrame) -> DataFrame:
    return sources.filter("status = 'active'").select("language").union(sessions.select("language")).filter(filled("language")).distinct().orderBy("language")


def outcome_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("result").agg(F.count("*").alias("n"))


def ordered_union(new: Column, old: Column, limit: int | None = None) -> Column:
    both = F.array_distinct(F.concat(new, F.coalesce(old, F.array().cast("array<string>"))))
    return both if limit is None else F.slice(both, 1, limit)


def review_fold(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items after their reviews (id, ord, result, reviewed_at timestamp), each review seeing what the ones before it left."""
    from cuewright.functions import scoring as X

    listed = reviews.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "result", "reviewed_at"))).alias("reviews"))
    state = "struct<interval_days:double,stability:double,priority_score:double,due_at:timestamp,status:string>"
    first = F.struct(*[F.col(c).cast("double").alias(c) for c in ("interval_days", "stability", "priority_score")], X.parse_time(F.col("due_at")).alias("due_at"), F.col("status")).cast(state)
    step = lambda s, r: X.schedule(r["result"], s["interval_days"], s["stability"], s["priority_score"], r["reviewed_at"])
    done = items.join(listed, "id").withColumn("next", F.aggregate("reviews", first, step)).withColumn("seen", X.format_time(F.element_at("reviews", -1)["reviewed_at"]))
    changed = {"interval_days": F.col("next.interval_days"), "stability": F.col("next.stability"), "priority_score": F.col("next.priority_score"), "due_at": X.format_time(F.col("next.due_at")), "status": F.col("next.status"), "last_seen_at": F.col("seen"), "last_reviewed_at": F.col("seen")}
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in items.columns])


def after_import(track: Column, bias: Column, priorities: Column, baseline: Column, own_priorities: Column, own_baseline: Column) -> dict[str, Column]:
    """A language's lists once material of a track is imported: the track and its priorities come first, an existing baseline stays."""
    return {"track_bias": ordered_union(F.array(track), bias), "recent_priorities": ordered_union(own_priorities, priorities, 6), "baseline_summary": F.coalesce(F.nullif(baseline, F.lit("")), own_baseline)}
