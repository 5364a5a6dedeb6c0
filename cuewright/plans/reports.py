"""The agenda and the rebuilt profile as JSON documents.

Everything is ranked and limited on the cluster; only the few rows that a document shows are fetched.
"""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import agenda, profile
from cuewright.plans.state import State, now_iso, read_json, write_json
from cuewright.plans.transcripts import COACH
from cuewright.sources.store import joined

GROUP = ["review_category", "count", "max_priority", "pressure_score"]
ITEM = ["review_category", "content", "due_at", "priority_score", "stability", "interval_days", "pressure_score"]


def ranked(rows: DataFrame, columns: list[str]) -> list[dict]:
    return [r.asDict() for r in rows.orderBy("rank").select(*columns).collect()]  # at most the limit


def agenda_document(state: State, language: str, categories: int = 3, items: int = 5, now: dt.datetime | None = None, inputs: list[str] | None = None) -> dict:
    """What to review in one language; without active items, zero counts and empty lists.

    ``inputs``: names of files, of which the document says whether they are imported and have segments.
    """
    at = F.lit(now or dt.datetime.now(dt.timezone.utc)).cast("timestamp")
    pressed = agenda.pressures(state.read("review_items").filter(F.col("language") == language), at).cache()
    since = agenda.days_since_last(state.read("sessions").filter(F.col("language") == language), at).first()
    found, mode = agenda.counts(pressed).first(), agenda.recommended_mode(pressed, items).first()
    out = {
        "language": language,
        "days_since_last_session": since and since.days_since_last_session,
        "overdue_items": found.overdue_items if found else 0,
        "due_soon_items": found.due_soon_items if found else 0,
        "focus_groups": ranked(agenda.focus_groups(pressed, categories), GROUP),
        "item_preview": ranked(agenda.item_preview(pressed, items), ITEM),
        "overdue_preview": ranked(agenda.due_preview(pressed, "overdue", items), ITEM),
        "due_soon_preview": ranked(agenda.due_preview(pressed, "due_soon", items), ITEM),
        "display_mode": "summary_first",
        "recommended_mode": mode.recommended_mode if mode else "new_content_first",
    }
    pressed.unpersist()
    if inputs:
        named = state.spark.createDataFrame([(k, i, i.rpartition("/")[2]) for k, i in enumerate(inputs)], "ord int, input string, name string").withColumn("source_id", T.source_id(F.col("name")))
        known = named.join(agenda.known_inputs(named, state.read("sources"), state.read("segments")), "source_id").orderBy("ord")
        out["inputs"] = [r.asDict() for r in known.select("input", "source_id", "imported", "segments").collect()]  # a row for each input asked for
    return out


def rebuild_profile(state: State, root: str | Path, now: dt.datetime | None = None) -> str:
    """The profile's lists from state, for every active language; what state doesn't know stays."""
    path, at = joined(root, COACH, "profile.json"), now_iso(now)
    document = read_json(path, state.spark)
    events, items, sessions = (state.read(t) for t in ("profile_events", "review_items", "sessions"))
    languages = [r.language for r in profile.active_languages(state.read("sources"), sessions).collect()] or document.get("active_languages", [])
    lists = {
        "comprehension_strengths": (profile.top_signals(events, "comprehension_strength"), "signal"),
        "output_fragilities": (profile.top_signals(events, "output_fragility"), "signal"),
        "reusable_chunks": (profile.top_chunks(items), "content"),
        "recurring_vocab_gaps": (profile.vocab_gaps(events, items), "gap"),
        "track_bias": (profile.track_bias(sessions), "track"),
        "recent_priorities": (profile.recent_priorities(items), "review_category"),
    }
    one = None
    for name, (rows, column) in lists.items():
        part = rows.filter(F.col("language").isin(languages)).select("language", F.lit(name).alias("name"), "rank", F.col(column).alias("value"))
        one = part if one is None else one.unionByName(part)
    found: dict[tuple[str, str], list[str]] = {}
    for r in one.orderBy("language", "name", "rank").collect():  # at most 30 values a language
        found.setdefault((r.language, r.name), []).append(r.value)
    profiles = document.setdefault("language_profiles", {})
    for language in languages:
        own = profiles.setdefault(language, {})
        own.update({name: found.get((language, name), []) for name in lists}, last_updated_at=at)
        own.setdefault("baseline_summary", None)
    document.update(active_languages=languages, updated_at=at)
    write_json(path, document, state.spark)
    return path
