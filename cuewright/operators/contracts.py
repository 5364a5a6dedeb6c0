"""What a row has to fulfil, as tables of rules: one column lists every rule that a row breaks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an input has to say, and what it need not.
INPUT_TYPES = ["transcript", "article"]
INPUT_TRACKS = ["live_chat", "article_reading"]
INPUT_DEFAULTS = {"learner_language": "zh-CN", "watched_or_read": True}
# The least and the most entries of each list of a profile delta.
DELTA_SIZES = {"comprehension_strengths": (1, 3), "output_fragilities": (1, 3), "reusable_chunks": (2, 5), "next_focus": (1, 3), "review_candidates": (3, 6)}


def filled(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""


def broken(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that do not hold, in order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))


def with_missing(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with a null text in place of each column that it lacks."""
    return rows.withColumns({n: F.lit(None).cast("string") for n in names if n not in rows.columns}) if set(names) - set(rows.columns) else rows


def checked_inputs(rows: DataFrame) -> DataFrame:
    """Inputs with their defaults and ``violations``.  A text may be missing where a path or a manifest says where it is."""
    rows = with_missing(rows, ["input_type", "track", "title", "text", "source_path", "source_manifest"])
    whole = rows.withColumns({name: F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value) for name, value in INPUT_DEFAULTS.items()})
    rules = {"input_type": F.col("input_type").isin(INPUT_TYPES), "track": F.col("track").isin(INPUT_TRACKS), "title": filled("title"), "text": filled("text") | filled("source_path") | filled("source_manifest")}
    return whole.withColumn("violations", broken(rules))


def checked_deltas(rows: DataFrame) -> DataFrame:
    """Profile deltas with ``violations``: lists with too few or too many entries; a null list has none."""
    sizes = {name: F.size(F.coalesce(F.col(name), F.array().cast("array<string>"))).between(*bounds) for name, bounds in DELTA_SIZES.items()}
    return rows.withColumn("violations", broken(sizes))


def refuse(rows: DataFrame, key: str) -> None:
    """A ValueError that names the first rows with violations, if there are any."""
    bad = rows.filter(F.size("violations") > 0).select(F.col(key).cast("string").alias("key"), "violations").orderBy("key").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.key}: {', '.join(r.violations)}" for r in bad))
