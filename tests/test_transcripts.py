"""Formats, edges, and whole imports on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuewright.operators import folds
from cuewright.plans import transcripts
from cuewright.plans.state import State
from cuewright.sources import subtitles

SRT = "1\n00:00:00,000 --> 00:00:02,000\nHello <i>there</i>.\n\n2\n00:00:02,500 --> 00:00:04,000\nGeneral Kenobi.\n\n3\n00:00:04,000 --> 00:00:05,000\n[Music]\n\n4\n00:00:05,000 -->\nlost\n"
VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000 align:start\n1796 at the<00:00:02.000><c> height</c>\n\n00:00:03.000 --> 00:00:05.000\n1796 at the height\nof the French\n\n00:00:05.000 --> 00:00:07.000\nRevolutionary Wars.\n"
ASS = "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.50,{\\b1}Styled\\Ntext, with comma.\nDialogue: 0,bad,0:00:03.00,skipped\n"


def run(spark, **texts):
    files = spark.createDataFrame([(k, {"a": "ass"}.get(k[0], "srt"), v) for k, v in texts.items()], "source_id string, format string, raw_text string")
    return {r.source_id: r for r in folds.transcripts(files).collect()}


def test_formats(spark):
    found = run(spark, s=SRT, v=VTT, a=ASS, e="")
    assert [u.text for u in found["s"].utterances] == ["Hello there .", "General Kenobi."]  # a tag becomes a space
    assert (found["s"].stats.rawCueCount, found["s"].stats.droppedNoiseCount) == (2, 1)
    assert [u.text for u in found["v"].utterances] == ["1796 at the height of the French", "Revolutionary Wars."]
    assert found["v"].stats.mergedCueCount == 1 and found["v"].utterances[0].end == 5.0
    assert [(u.start, u.end, u.text) for u in found["a"].utterances] == [(1.0, 2.5, "Styled text, with comma.")]
    assert found["e"].utterances == [] and found["e"].stats.end == 0.0


def test_import_and_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "Talk [abc-1].en.srt").write_text(SRT)
    (folder / "notes.txt").write_text("x")
    root = tmp_path / "root"
    transcripts.init_root(spark, root)
    paths = subtitles.collect([folder, folder])
    assert [p.name for p in paths] == ["Talk [abc-1].en.srt"]
    for _ in range(2):  # a second import replaces the first
        done = transcripts.ingest(spark, root, paths)
    assert done[0]["source_id"] == "abc-1" and done[0]["segment_count"] == 1
    assert (root / "languages/en/segments/abc-1--seg-01.md").read_text().startswith("# Transcript Segment\n\n- track: live_chat\n- segment_index: 1\n")
    state = State(spark, root)
    assert state.read("segments").count() == state.read("sources").count() == 1
    made = transcripts.normalize(spark, paths, tmp_path / "out")
    markdown = transcripts.render(spark, made, "article_reading")[0].read_text()
    assert "- track: article_reading\n" in markdown and "## Cleaned Text\n\nHello there . General Kenobi.\n" in markdown

    state.apply([{"table": "review_items", "op": "insert", "data": {"id": "i1", "language": "en", "status": "active", "interval_days": 1.0, "source_id": "abc-1", "unknown": 1}}])
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    state.review({"language": "en", "reviewed_items": [{"id": "i1", "result": "good", "reviewed_at": "2024-01-01T00:00:00Z"}, {"id": "i1", "result": "again", "reviewed_at": "2024-01-02T00:00:00Z"}]}, now)
    item = state.read("review_items").first()
    assert (item.interval_days, round(item.stability, 6), item.due_at) == (1.1, 0.26, "2024-01-02T06:00:00Z")
    before = state.version()
    with pytest.raises(KeyError):
        state.review({"language": "en", "reviewed_items": [{"id": "none", "result": "good"}]}, now)
    assert state.version() == before and state.changed == {}
    out = state.act([{"action": "archive_source", "source_id": "abc-1"}, {"action": "set_item_status", "item_ids": ["i1", "zz"], "status": "paused"}], now)
    assert [out[0]["source_rows_affected"], out[0]["review_rows_affected"], out[1]["rows_affected"], len(out[1]["user_action_ids"])] == [1, 1, 1, 2]
    assert state.read("user_actions").count() == 3 and state.read("sources").filter(F.col("status") == "archived").count() == 1


def test_ingest_of_a_folder_with_both_forms(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "root"
    folder.mkdir()
    (folder / "Talk [x1].en.srt").write_text(SRT)
    (folder / "Other one.srt").write_text(SRT.replace("Kenobi", "Grievous"))
    transcripts.init_root(spark, root)
    raw = subtitles.collect([folder])
    transcripts.normalize(spark, raw)
    ready = subtitles.collect([folder], normalized=True)
    assert len(raw) == len(ready) == 2
    done = transcripts.ingest(spark, root, raw, ready)
    assert sorted(d["source_id"] for d in done) == ["Other one", "x1"] and {d["segment_count"] for d in done} == {1}
    state = State(spark, root)
    assert sorted(r.id for r in state.read("sources").collect()) == ["Other one", "x1"]
    assert (root / "languages/en/segments/x1--seg-01.md").read_text().count("Kenobi") == 1
