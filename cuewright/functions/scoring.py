"""Review scheduling and pressure as expressions; ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each result the least interval, its growth, and what it adds to stability and priority.
RESULTS = {"again": (0.25, 0.5, -0.16, 0.18), "hard": (1.0, 1.35, 0.03, 0.08), "good": (1.0, 2.2, 0.12, -0.05), "easy": (2.0, 3.6, 0.20, -0.12)}
DEFAULTS = {"interval_days": 1.0, "stability": 0.3, "priority_score": 0.5}
MASTERED = "mastered"
AGAIN_HOURS = 6


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def as_float(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def parse_time(text: Column) -> Column:
    """ISO 8601 as a timestamp; a time without zone is in the session's, UTC."""
    return text.try_cast("timestamp")


def format_time(at: Column) -> Column:
    """ISO 8601 with Z; microseconds only where there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.unix_micros(at) % 1_000_000
    return F.concat(whole, F.when(part != 0, F.format_string(".%06d", part)).otherwise(""), F.lit("Z"))


def by_result(result: Column, which: int) -> Column:
    out = F.lit(None).cast("double")
    for name, values in RESULTS.items():
        out = F.when(result == name, F.lit(values[which])).otherwise(out)
    return out


def later(at: Column, days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + F.round(days * 86_400_000_000).cast("long"))


def schedule(result: Column, interval: Column, stability: Column, priority: Column, reviewed: Column) -> Column:
    """interval_days, stability, priority_score, due_at, status after a review; null for an unknown result."""
    i, s, p = as_float(interval, DEFAULTS["interval_days"]), as_float(stability, DEFAULTS["stability"]), as_float(priority, DEFAULTS["priority_score"])
    done = result == MASTERED
    raw = F.greatest(by_result(result, 0), i * by_result(result, 1))
    next_s = F.when(done, clamp(F.greatest(s, F.lit(0.92)), 0.05, 1.0)).otherwise(clamp(s + by_result(result, 2), 0.05, 1.0))
    next_p = F.when(done, clamp(F.least(p, F.lit(0.2)), 0.0, 1.0)).otherwise(clamp(p + by_result(result, 3) + F.greatest(F.lit(0.0), 0.4 - next_s) * 0.25, 0.0, 1.0))
    due = F.when(done, F.lit(None).cast("timestamp")).when(result == "again", later(reviewed, F.lit(AGAIN_HOURS / 24))).otherwise(later(reviewed, raw))
    out = F.struct(
        F.when(done, clamp(F.greatest(i, F.lit(7.0)), 7.0, 180.0)).otherwise(clamp(raw, 0.25, 180.0)).alias("interval_days"),
        next_s.alias("stability"),
        next_p.alias("priority_score"),
        due.alias("due_at"),
        F.when(done, F.lit(MASTERED)).otherwise(F.lit("active")).alias("status"),
    )
    return F.when(result.isin(*RESULTS, MASTERED), out)


def days_until(due: Column, now: Column) -> Column:
    return (F.unix_micros(due) - F.unix_micros(now)) / 86_400_000_000


def pressure(due: Column, stability: Column, priority: Column, now: Column) -> Column:
    """0 to 3, in steps of 0.0001: priority, a part for what is due or soon due, and one for what is unstable."""
    left = days_until(due, now)
    urgent = F.when(due <= now, 1.0).when(left <= 1, 0.55).when(left <= 3, 0.25).otherwise(0.0)
    total = as_float(priority, 0.0) + urgent + F.greatest(F.lit(0.0), 0.45 - as_float(stability, 0.0)) * 1.2
    return F.floor(clamp(total, 0.0, 3.0) * 10_000 + 0.5) / 10_000
