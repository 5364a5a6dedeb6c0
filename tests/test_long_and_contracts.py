"""Long recordings over many tasks, rejected cues, what a session starts from, and contracts; texts and rules by literal values."""

import json
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import agenda, contracts, cues, folds
from cuewright.plans import reports, transcripts
from cuewright.plans.state import State
from cuewright.sources import subtitles

CUES = "source_id string, utterance_index int, start double, end double, text string"


def recording(chance, name, n):
    at, out = 0.0, []
    for k in range(n):
        at += chance.choice([0.0, 0.5, 2.0, 7.999, 8.0, 30.0]) if chance.random() < 0.4 else 0.1
        out.append((name, k, at, at + 2.0, " ".join(chance.choices(["one", "two", "three.", "four", "end!"], k=chance.randint(0, 30)))))
        at += 2.0
    return out


def folded_whole(rows):
    """The paragraphs of each source by the fold over its whole array."""
    listed = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("utterance_index", "start", "end", "text"))).alias("x"))
    whole = folds.paragraphs(listed.select("source_id", F.transform("x", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), u["text"].alias("text"))).alias("utterances")))
    return whole.select("source_id", F.posexplode("paragraphs").alias("paragraph_index", "p")).select("source_id", "paragraph_index", "p.*")


def test_stretches_fold_as_the_whole(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 250)
    chance = random.Random(4)
    rows = recording(chance, "long", 12_000) + recording(chance, "short", 5) + recording(chance, "one", 1) + [("still", k, 2.0 * k, 2.0 * k + 2, "word " * 10) for k in range(700)]
    df = spark.createDataFrame(rows, CUES).repartition(4)
    found = folds.paragraph_rows(df)
    wanted = folded_whole(df)
    assert found.columns == wanted.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    # one recording's stretches and their folds lie in several tasks
    stretch = folds.islands(df).filter("source_id = 'long'")
    assert stretch.select("island").distinct().count() > 500
    spread = stretch.repartition(4, "source_id", "island").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 6000
    assert folds.paragraph_rows(df.limit(0)).collect() == []


def test_no_task_gathers_a_recording(spark):
    """Windows and groupings have a block or a stretch in their keys, but for sums of blocks."""
    plan = folds.paragraph_rows(spark.createDataFrame([], CUES))._jdf.queryExecution().executedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.splitlines() if "Project" not in line]
    by_source = [k for k, line in enumerate(lines) if re.match(r"Exchange hashpartitioning\(source_id#\d+L?, \d", line)]
    assert by_source and all(re.match(r"(Sort|Hash|ObjectHash)Aggregate\(keys=\[source_id#\d+, block_#", lines[k + 1]) for k in by_source)


BROKEN = "1\n00:00:00,000 --> 00:00:01,000\nGood.\n\n2\n1:00:00,000 --> 1:00:01,000\nLost for its hours.\n\n3\n00:00:05,000 -->\nlost\n\n4\n00:00:06,000 --> 00:00:07,000\n\n5\n00:00:08,000 --> 00:00:09,000\n[Music]\n"
STYLED = "[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.00,Fine.\nDialogue: soon,0:00:02.00,Lost.\nDialogue: 0:00:03.00,0:00:04.00,(applause)\n"


def test_rejected_cues_are_counted(spark):
    files = spark.createDataFrame([("a", "srt", BROKEN), ("b", "ass", STYLED), ("c", "vtt", "WEBVTT\n\nNOTE no cue\n\n00:00:01.000 --> 00:00:02.000\nFine.\n"), ("d", "srt", "")], "source_id string, format string, raw_text string")
    run = Observation("run")
    found = {r.source_id: r for r in folds.transcripts(files, run).collect()}
    assert {k: (r.stats.rawCueCount, r.stats.droppedNoiseCount, r.stats.rejectedCueCount) for k, r in found.items()} == {"a": (1, 1, 3), "b": (1, 1, 1), "c": (1, 0, 0), "d": (0, 0, 0)}
    parsed, counts = cues.parse_cues(files, once := Observation("parse"))
    assert parsed.count() == 3
    assert (once.get["noise"], once.get["rejected"]) == (2, 4) and once.get["cues"] == 3
    assert run.get["rejected"] >= 4


def test_known_inputs(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",), (None,)], "source_id string")
    sources = spark.createDataFrame([("a", "active"), ("b", None), ("c", "deleted"), (None, "active")], "id string, status string")
    segments = spark.createDataFrame([("a", "ready"), ("a", "deleted"), ("a", None), ("c", "ready"), (None, "ready")], "source_id string, status string")
    found = {r.source_id: (r.imported, r.segments) for r in agenda.known_inputs(wanted, sources, segments).collect()}
    assert found == {"a": (True, 2), "b": (True, 0), "c": (False, 1), "d": (False, 0), None: (False, 0)}


def test_agenda_says_what_is_there(spark, tmp_path):
    (tmp_path / "Talk [x1].srt").write_text(BROKEN)
    root = tmp_path / "root"
    transcripts.init_root(spark, root)
    assert transcripts.ingest(spark, root, subtitles.collect([tmp_path / "Talk [x1].srt"]))[0]["segment_count"] == 1
    state = State(spark, root)
    found = reports.agenda_document(state, "en", inputs=["somewhere/Talk [x1].srt", "Other.en.vtt"])
    assert found["inputs"] == [{"input": "somewhere/Talk [x1].srt", "source_id": "x1", "imported": True, "segments": 1}, {"input": "Other.en.vtt", "source_id": "Other", "imported": False, "segments": 0}]
    assert "inputs" not in reports.agenda_document(state, "en")
    # an input that says neither its text nor where it is is refused, and nothing is written
    empty = tmp_path / "e.normalized-subtitle.json"
    empty.write_text(json.dumps({"kind": "normalized_subtitle_transcript", "source": {"source_id": "e", "stem": "e"}, "paragraphs": [], "paragraph_records": [], "stats": {"rawCueCount": 0, "cleanedUtteranceCount": 0}}))
    before = state.version()
    with pytest.raises(ValueError, match="e: text"):
        transcripts.ingest(spark, root, [], [empty])
    assert state.version() == before and not list((root / "languages/en/cleaned").glob("e.*"))


def test_contracts(spark):
    schema = "id int, input_type string, track string, title string, text string, source_manifest string, watched_or_read boolean"
    rows = spark.createDataFrame([(1, "transcript", "live_chat", "t", "x", None, None), (2, None, "other", " ", "", None, False), (3, "article", "article_reading", "t", None, "list.txt", True), (4, "Article", None, "t", "x", None, None)], schema)
    found = {r.id: (r.violations, r.learner_language, r.watched_or_read) for r in contracts.checked_inputs(rows).collect()}
    assert found == {1: ([], "zh-CN", True), 2: (["input_type", "track", "title", "text"], "zh-CN", False), 3: ([], "zh-CN", True), 4: (["input_type", "track"], "zh-CN", True)}
    with pytest.raises(ValueError, match="2: input_type, track, title, text; 4: input_type, track"):
        contracts.refuse(contracts.checked_inputs(rows), "id")
    contracts.refuse(contracts.checked_inputs(rows.filter("id in (1, 3)")), "id")
    names = ["comprehension_strengths", "output_fragilities", "reusable_chunks", "next_focus", "review_candidates"]
    sizes = [(1, 1, 2, 1, 3), (3, 3, 5, 3, 6), (0, 4, 1, 0, 2), (4, 0, 6, 4, 7), (None, 1, 2, 1, 3)]
    lists = spark.createDataFrame([(k, *[None if n is None else ["x"] * n for n in own]) for k, own in enumerate(sizes)], "id int, " + ", ".join(f"{n} array<string>" for n in names))
    assert {r.id: r.violations for r in contracts.checked_deltas(lists).collect()} == {0: [], 1: [], 2: names, 3: names, 4: names[:1]}


def test_literal_values(spark):
    """What the SQL of the queries takes from the library's own constants."""
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    noise = row(**{f"n{k}": T.is_noise(F.lit(t)) for k, t in enumerate(["[Music]", "(MUSIC)", "[applause]", "(Applause)", "[laughter]", "(laughter)", "[ music ]", "music"])})
    assert list(noise) == [True] * 6 + [False] * 2
    shown = row(
        entity=T.decode_entities(F.lit("&amp;lt; &nbsp;&quot;&#39;&gt;")), cue=T.strip_cue_markup(F.lit("<v Ann>Hi <00:00:01.000><c.x>you</c> <i>there</i> <b class=1>x</b>")), style=T.strip_style_markup(F.lit("{\\an8}a\\Nb\\nc\\hd")),
        house=T.segment_summary(F.lit("The Mortgage is due."), F.lit("live_chat"), F.lit(1)), stream=T.segment_summary(F.lit("Youtube and Twitch are cellmates."), F.lit("live_chat"), F.lit(1)), nice=T.segment_summary(F.lit("just be nice."), F.lit("live_chat"), F.lit(1)),
        art=T.segment_summary(F.lit("An artist came."), F.lit("live_chat"), F.lit(1)), plain=T.segment_summary(F.lit("So it went. On"), F.lit("live_chat"), F.lit(3)), unit=T.segment_summary(F.lit("So it went. On"), F.lit("article_reading"), F.lit(12)),
    )
    assert shown.entity == '<  "\'>' and shown.cue == "Ann: Hi you there x" and shown.style == "a b c d"
    assert shown.house == "Practical tangent about money, housing, and stream-related upgrades."
    assert shown.stream == "Opening dual-stream setup where chat platforms are framed as needing to get along."
    assert shown.nice == "Community-values segment focused on friendliness and audience culture."
    assert shown.art == "Planning segment about art commissions, stream events, and pending rewards."
    assert shown.plain == "Live-chat segment 03: So it went." and shown.unit == "Argument unit 12: So it went."
    assert folds.EDGES == {"live_chat": ("Stream opening.", "Segment sequence ends here."), "article_reading": ("Opening of the source argument.", "End of the current source argument sequence.")}
    assert T.CLEANING_SUMMARY.startswith("removed subtitle indices, timestamps, and subtitle markup; merged wrapped lines;")
