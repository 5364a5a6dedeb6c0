"""Listing, reading and writing files: manifests, recursion, names that look like patterns, failures, and a second kind of store."""

import io
import json

import pytest
from pyspark.sql import functions as F

from cuewright.__main__ import main
from cuewright.plans import transcripts
from cuewright.plans.state import State
from cuewright.sources import sinks, subtitles
from cuewright.sources.store import Store

SRT = "1\n00:00:00,000 --> 00:00:01,500\nHello there.\n\n2\n00:00:01,500 --> 00:00:03,000\nGeneral Kenobi.\n\n3\n00:00:03,000 --> 00:00:04,000\n[Music]\n"
ROLLING = "WEBVTT\n\n00:00:00.000 --> 00:00:01.000 align:start position:0%\n1796<00:00:00.200><c> at</c><00:00:00.400><c> the</c><00:00:00.600><c> height</c>\n\n00:00:01.000 --> 00:00:02.000 align:start position:0%\n1796 at the height\n1796 at the height of the French\n\n00:00:02.000 --> 00:00:03.000 align:start position:0%\nRevolutionary Wars.\n"
LINES = "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nHello there.\nGeneral Kenobi.\n"
STYLED = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:00.00,0:00:02.00,Default,,0,0,0,,{\\i1}This is styled text{\\i0}\\Nand a second line.\nDialogue: 0,0:00:02.00,0:00:04.00,Default,,0,0,0,,Another entry.\n"


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)


def test_one_file_of_each_form(spark, tmp_path):
    put(tmp_path, basic__srt=SRT, rolling__vtt=ROLLING, lines__vtt=LINES, basic__ass=STYLED)
    made = transcripts.normalize(spark, subtitles.collect([tmp_path]), tmp_path / "out")
    found = {p.name.partition(".")[0]: json.loads(p.read_text()) for p in made if "basic" not in p.name} | {json.loads(p.read_text())["source"]["subtitle_format"]: json.loads(p.read_text()) for p in made if "basic" in p.name}
    rolling, lines = found["rolling"], found["lines"]
    assert (rolling["source"]["subtitle_format"], rolling["stats"]["rawCueCount"], rolling["stats"]["cleanedUtteranceCount"]) == ("vtt", 3, 2)
    assert "1796 at the height of the French" in rolling["cleaned_utterances"][0]["text"]
    assert lines["cleaned_utterances"][0]["text"] == "Hello there. General Kenobi."
    # basic.srt and basic.ass have one source id: the file that comes last counts
    assert "srt" in found and "ass" not in found
    srt = found["srt"]
    assert (srt["stats"]["rawCueCount"], srt["stats"]["cleanedUtteranceCount"], srt["stats"]["droppedNoiseCount"]) == (2, 2, 1) and srt["paragraphs"] == ["Hello there. General Kenobi."]
    (tmp_path / "basic.srt").unlink()
    styled = json.loads(transcripts.normalize(spark, subtitles.collect([tmp_path / "basic.ass"]), tmp_path / "out")[0].read_text())
    assert styled["source"]["subtitle_format"] == "ass" and styled["stats"]["cleanedUtteranceCount"] == 2
    assert styled["cleaned_utterances"][0]["text"] == "This is styled text and a second line."
    assert list(styled) == ["schema_version", "kind", "source", "cleaning_summary", "cleaned_utterances", "paragraph_records", "paragraphs", "stats"]


def test_manifest_recursion_and_kinds(spark, tmp_path):
    put(tmp_path, b__srt=SRT, A__VTT=LINES, notes__txt="x", plain="x")
    put(tmp_path / "deep" / "er", c__ssa=STYLED)
    names = lambda paths: [p.name for p in paths]
    assert names(subtitles.collect([tmp_path])) == ["A.VTT", "b.srt"]
    assert names(subtitles.collect([tmp_path], recursive=True)) == ["A.VTT", "b.srt", "c.ssa"]
    (tmp_path / "list.txt").write_text("# talks\n\n  deep/er/c.ssa  \nb.srt\nnotes.txt\n")
    assert names(subtitles.collect([tmp_path / "A.VTT", tmp_path], tmp_path / "list.txt")) == ["c.ssa", "b.srt", "A.VTT"]
    with pytest.raises(FileNotFoundError):
        subtitles.collect([tmp_path / "none.srt"])
    # the readers' own listing finds the same files
    for recursive in (False, True):
        named = {str(p) for p in subtitles.collect([tmp_path], recursive=recursive)}
        scanned = subtitles.scan(spark, [tmp_path], recursive).collect()
        assert {r.path for r in scanned} == named and {r.file_name for r in scanned} == {p.rpartition("/")[2] for p in named}
        assert sorted(r.raw_text for r in scanned) == sorted(r.raw_text for r in subtitles.read_files(spark, subtitles.collect([tmp_path], recursive=recursive)).collect())
    assert subtitles.scan(spark, []).count() == 0


def test_wrong_kind_and_standard_input(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "x.normalized-subtitle.json"
    path.write_text(json.dumps({"kind": "other", "source": {"source_id": "a"}}))
    with pytest.raises(Exception, match="unsupported normalized payload"):
        subtitles.read_normalized(spark, [path]).collect()
    target = tmp_path / "t.json"
    monkeypatch.setattr("sys.stdin", io.StringIO("﻿" + json.dumps({"a": "é"})))
    assert main(["write-json", str(target)]) == 0 and json.loads(target.read_text()) == {"a": "é"}


def rows(spark, *given):
    return spark.createDataFrame(list(given), "ord int, path string, text string")


def test_written_files(spark, tmp_path):
    names = ["plain.md", "a [b] {c} *?.md", "é 日本.md", "50% = x#y.md", "sub/deep.md"]
    given = [(k, f"{tmp_path}/{n}", f"text {k}\r\nof two\n\n") for k, n in enumerate(names)]
    done = sinks.write_files(rows(spark, *given, (9, f"{tmp_path}/plain.md", "last\n")), str(tmp_path))
    assert [p for p, _ in done] == [p for _, p, _ in given[1:]] + [f"{tmp_path}/plain.md"] and done[-1][1] == 5
    assert (tmp_path / "plain.md").read_bytes() == b"last\n"
    for _, p, text in given[1:]:
        assert open(p, newline="").read() == text
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    assert sinks.write_files(rows(spark), str(tmp_path)) == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    put(tmp_path, old__md="old\n")
    good = rows(spark, *[(k, f"{tmp_path}/{k}.md", "x" * 1000 + "\n") for k in range(50)], (99, f"{tmp_path}/old.md", "new\n"))
    broken = good.withColumn("text", F.when(F.col("ord") == 37, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    for bad in (broken, good.withColumn("text", F.when(F.col("ord") != 37, F.col("text")).otherwise("no line end"))):
        with pytest.raises(Exception, match="lost|no line end"):
            sinks.write_files(bad, str(tmp_path))
        assert [p.name for p in tmp_path.iterdir()] == ["old.md"] and (tmp_path / "old.md").read_text() == "old\n"
    assert len(sinks.write_files(good, str(tmp_path))) == 51 and (tmp_path / "old.md").read_text() == "new\n"


@pytest.fixture
def store(spark, tmp_path):
    """A folder under another scheme, which neither Python nor a local path reaches."""
    (tmp_path / "held").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.box.link./held", f"file://{tmp_path}/held")
    return "viewfs://box/held"


@pytest.mark.parametrize("scheme", ["local", "store"])
def test_ingest_into_a_root(spark, tmp_path, store, scheme):
    folder = tmp_path / "held" / "in"
    put(folder, a__srt=SRT, b__vtt=ROLLING, note__txt="x")
    put(folder / "more", c__srt=SRT)
    (folder / "Talk [x-1] {y}.en.srt").write_text(SRT.replace("Kenobi", "Grievous"))
    (folder / "list.txt").write_text("more/c.srt\n")
    base = str(tmp_path / "held") if scheme == "local" else store
    root = f"{base}/root"
    transcripts.init_root(spark, root)
    raw = subtitles.collect([f"{base}/in"], f"{base}/in/list.txt", spark=spark)
    assert [p.name for p in raw] == ["c.srt", "a.srt", "b.vtt", "Talk [x-1] {y}.en.srt"]
    made = transcripts.normalize(spark, raw[-1:], f"{base}/made")
    assert [str(p) for p in made] == [f"{base}/made/Talk [x-1] {{y}}.normalized-subtitle.json"]
    assert [str(p) for p in transcripts.render(spark, made, "article_reading", emit_txt=True)] == [f"{base}/made/Talk [x-1] {{y}}.lesson-ready.en.{e}" for e in ("md", "txt")]
    ready = subtitles.collect([f"{base}/made"], normalized=True, spark=spark)
    assert list(map(str, ready)) == list(map(str, made))
    done = transcripts.ingest(spark, root, raw[:3], ready, emit_txt=True)
    assert [d["source_id"] for d in done] == ["c", "a", "b", "x-1"] and all(d["segment_count"] == 1 and d["first_segment"]["start_ref"] == "00:00:00" for d in done)
    held = tmp_path / "held" / "root" / "languages" / "en"
    seen = lambda part: sorted(p.name for p in (held / part).iterdir() if not p.name.endswith(".crc"))
    assert seen("raw") == ["a.en.srt", "b.en.vtt", "c.en.srt", "x-1.en.srt"] and (held / "raw" / "a.en.srt").read_text() == SRT
    assert seen("cleaned") == sorted(f"{i}.lesson-ready.en.{e}" for i in ("a", "b", "c", "x-1") for e in ("md", "txt"))
    assert seen("segments") == [f"{i}--seg-01.md" for i in ("a", "b", "c", "x-1")] and "Grievous" in (held / "segments" / "x-1--seg-01.md").read_text()
    assert not [p for p in held.rglob("*") if ".part-" in str(p) and p.is_file()]
    state = State(spark, root)
    assert {r.id: r.raw_path for r in state.read("sources").collect()} == {i: f"{root}/languages/en/raw/{i}.en.{'vtt' if i == 'b' else 'srt'}" for i in ("a", "b", "c", "x-1")}
    assert json.loads(Store(spark).read(f"{root}/.coach/profile.json"))["last_imported_source"]["source_id"] == "x-1"
    # again, by the readers' own listing: segments are replaced, a stale file goes
    (held / "segments" / "a--seg-07.md").write_text("stale")
    (held / "segments" / "a--seg-1--seg-07.md").write_text("of another source")
    again = transcripts.ingest(spark, root, subtitles.scan(spark, [f"{base}/in"]))
    assert {d["source_id"] for d in again} == {"a", "b", "x-1"} and state.read("segments").count() == 4
    assert "a--seg-07.md" not in seen("segments") and "a--seg-1--seg-07.md" in seen("segments")


def test_mounted_files_are_named_and_listed_by_tasks(spark, tmp_path, monkeypatch):
    given = [(0, f"{tmp_path}/in/{k % 3}/Talk {k} é.srt", f"{k}\n") for k in range(40)]
    monkeypatch.setattr(Store, "rename", lambda *_: pytest.fail("renamed by the driver"))
    made = sinks.write_table(rows(spark, *given), str(tmp_path))
    assert {(r.path, r.n) for r in made.collect()} == {(p, len(t)) for _, p, t in given}
    put(tmp_path / "in" / "_hidden", d__srt="x")
    (tmp_path / "in" / ".e.srt").write_text("x")
    found = subtitles.scan(spark, [tmp_path / "in"], recursive=True)
    assert found.inputFiles() == [] or all("/names-" in f for f in found.inputFiles())  # no file of the folder is in the plan
    assert {(r.path, r.raw_text) for r in found.collect()} == {(p, t) for _, p, t in given}


def test_payloads_of_a_folder_are_imported_without_a_list(spark, tmp_path):
    put(tmp_path / "raw", a__srt=SRT, b__vtt=ROLLING)
    transcripts.normalize(spark, subtitles.collect([tmp_path / "raw"]), tmp_path / "in")
    (tmp_path / "in" / "z.normalized-subtitle.json").write_text((tmp_path / "in" / "a.normalized-subtitle.json").read_text().replace("Kenobi", "Grievous"))
    root = str(tmp_path / "root")
    transcripts.init_root(spark, root)
    held = tmp_path / "root" / "languages" / "en" / "segments"
    put(held, **{"a--seg-07__md": "stale", "other--seg-01__md": "of another source"})
    done = transcripts.import_files(spark, root, [], subtitles.scan_normalized(spark, tmp_path / "in"))
    assert sorted((r.source_id, r.segment_count) for r in done.collect()) == [("a", 1), ("b", 1)]
    assert sorted(p.name for p in held.iterdir()) == ["a--seg-01.md", "b--seg-01.md", "other--seg-01.md"] and "Grievous" in (held / "a--seg-01.md").read_text()
    assert State(spark, root).read("segments").count() == 2
