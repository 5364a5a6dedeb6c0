"""The review agenda: pressures, counts, focus groups, previews and the recommended mode, for all languages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions import scoring as X

SOON_DAYS = 3


def pressures(items: DataFrame, now: Column) -> DataFrame:
    """Active items with pressure_score, overdue and due_soon (by whole days left, so up to four)."""
    due = X.parse_time(F.col("due_at"))
    overdue = F.coalesce(due <= now, F.lit(False))
    return items.filter("status = 'active'").select(
        "id", "language", F.coalesce(F.nullif("review_category", F.lit("")), F.lit("uncategorized")).alias("review_category"), "content", "due_at",
        X.as_float(F.col("priority_score"), 0.0).alias("priority_score"), X.as_float(F.col("stability"), 0.0).alias("stability"), X.as_float(F.col("interval_days"), 0.0).alias("interval_days"),
        X.pressure(due, F.col("stability"), F.col("priority_score"), now).alias("pressure_score"), overdue.alias("overdue"),
        (~overdue & F.coalesce(F.floor(X.days_until(due, now)) <= SOON_DAYS, F.lit(False))).alias("due_soon"),
    )


def counts(pressed: DataFrame) -> DataFrame:
    return pressed.groupBy("language").agg(F.count_if("overdue").alias("overdue_items"), F.count_if("due_soon").alias("due_soon_items"))


def days_since_last(sessions: DataFrame, now: Column) -> DataFrame:
    """Whole days since each language's last finish, at least 0; times are compared as times."""
    last = F.max(X.parse_time(F.col("finished_at")))
    return sessions.groupBy("language").agg(F.greatest(F.lit(0), F.floor(-X.days_until(last, now))).alias("days_since_last_session"))


def top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each language; the filter lets Spark keep only so many a task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("language").orderBy(*order))).filter(F.col("rank") <= limit)


def focus_groups(pressed: DataFrame, limit: int = 3) -> DataFrame:
    grouped = pressed.groupBy("language", "review_category").agg(F.count("*").alias("count"), F.max("priority_score").alias("max_priority"), F.sum(F.col("pressure_score").cast("decimal(20,4)")).cast("double").alias("pressure_score"))
    return top(grouped, limit, F.desc("pressure_score"), F.desc("max_priority"), F.desc("count"), F.asc("review_category"))


def item_preview(pressed: DataFrame, limit: int = 5) -> DataFrame:
    return top(pressed, limit, F.desc("pressure_score"), F.coalesce("due_at", F.lit("")).asc(), F.desc("priority_score"), F.asc("id"))


def due_preview(pressed: DataFrame, which: str, limit: int = 5) -> DataFrame:
    """``which``: overdue or due_soon."""
    return top(pressed.filter(F.col(which)), limit, F.coalesce("due_at", F.lit("")).asc(), F.desc("pressure_score"), F.asc("id"))


def recommended_mode(pressed: DataFrame, limit: int = 5) -> DataFrame:
    """By the counts and the pressures of what the previews show."""
    urgent = due_preview(pressed, "overdue", limit).groupBy("language").agg(F.max("pressure_score").alias("urgent"))
    shown = item_preview(pressed, limit).groupBy("language").agg(F.max("pressure_score").alias("shown"))
    joined = counts(pressed).join(urgent, "language", "left").join(shown, "language", "left")
    mode = (
        F.when((F.col("overdue_items") >= 3) | ((F.col("overdue_items") >= 1) & (F.col("urgent") >= 1.5)), "review_first")
        .when((F.col("overdue_items") >= 1) | (F.col("due_soon_items") >= 3) | (F.col("shown") >= 1.0), "mixed")
        .otherwise("new_content_first")
    )
    return joined.select("language", mode.alias("recommended_mode"))


def known_inputs(wanted: DataFrame, sources: DataFrame, segments: DataFrame) -> DataFrame:
    """source_id, imported, segments: whether each wanted source is there, and how many segments it has that are not deleted."""
    there = sources.filter("coalesce(status, '') <> 'deleted'").select(F.col("id").alias("source_id"), F.lit(True).alias("there"))
    counted = segments.filter("coalesce(status, '') <> 'deleted'").groupBy("source_id").agg(F.count("*").alias("n"))
    return wanted.select("source_id").distinct().join(there, "source_id", "left").join(counted, "source_id", "left").select("source_id", F.coalesce("there", F.lit(False)).alias("imported"), F.coalesce("n", F.lit(0)).alias("segments"))
