"""Subtitle text to cues: one row a file in, one row a cue out, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions import text as T

CLOCK = r"\A(?:(\d{2,}):)?(\d{2}):(\d{2})[,.](\d{3})\z"
STYLED_CLOCK = r"\A(\d+):(\d{2}):(\d{2})\.(\d{2})\z"


def unified_newlines(raw: Column) -> Column:
    return F.regexp_replace(raw, "\r\n?", "\n")


def detect_format(raw: Column, name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))
    return F.when(extension.isin(".vtt", ".ass", ".ssa"), F.substring(extension, 2, 3)).when(T.strip(raw).rlike(r"(?i)\A\x{FEFF}?WEBVTT(?U:\b)"), "vtt").otherwise("srt")


def seconds_by(pattern: str, text: Column, unit: float) -> Column:
    """Seconds of a clock that fits ``pattern``; its parts are the digits between marks, hours first if there are any."""

    def total(parts: Column) -> Column:
        part = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).cast("double"), F.lit(0.0))
        return part(-4) * 3600 + part(-3) * 60 + part(-2) + part(-1) / F.lit(unit)

    return T.let(T.strip(text), lambda t: F.when(t.rlike(pattern), T.let(F.split(t, "[:,.]"), total)))


def parse_timestamp(text: Column) -> Column:
    """[HH:]MM:SS,mmm in seconds, null for anything else."""
    return seconds_by(CLOCK, text, 1000.0)


def parse_styled_timestamp(text: Column) -> Column:
    """H:MM:SS.cc in seconds, null for anything else."""
    return seconds_by(STYLED_CLOCK, text, 100.0)


def parse_time_line(line: Column) -> Column:
    """(start, end) of ``a --> b settings``; null where either doesn't parse."""
    ends = lambda sides: F.struct(parse_timestamp(F.get(sides, F.lit(0))).alias("start"), parse_timestamp(F.get(T.tokens(F.get(sides, F.lit(1))), F.lit(0))).alias("end"))
    known = lambda x: F.when(x["start"].isNotNull() & x["end"].isNotNull(), x)
    return F.when(F.contains(line, F.lit("-->")), T.let(T.let(F.split(line, "-->", 2), ends), known))


def cue_text(lines: Column) -> Column:
    """One text of a cue's lines; rolling captions, told by their markup, drop what a line repeats."""
    bare = lambda line: F.when(F.contains(line, F.lit("<")) | F.contains(line, F.lit("&")), T.strip_cue_markup(line)).otherwise(T.compact(line))
    rolling = F.exists(lines, lambda line: F.contains(line, F.lit("<")) & line.rlike(T.ROLLING))
    merged = lambda clean: F.aggregate(clean, F.lit(""), lambda now, line: F.when(now == "", line).otherwise(T.merge_texts(now, line)))
    joined = lambda clean: F.when(rolling & (F.size(clean) > 1), merged(clean)).otherwise(F.array_join(clean, " "))
    return T.let(F.filter(F.transform(lines, bare), lambda t: t != ""), joined)


def block_cue(body: Column) -> Column:
    """(start, end, text) of a block; null for one without a time line and text lines."""

    def timed(lines: Column) -> Column:
        arrow = lambda k: F.coalesce(F.contains(F.get(lines, k), F.lit("-->")), F.lit(False))
        first = F.when(F.get(lines, F.lit(0)).rlike(r"\A(?U:\d)+\z"), 1).otherwise(0)
        named = lambda at: at + F.when(~arrow(at) & arrow(at + 1), 1).otherwise(0)
        cue = lambda at: T.let(parse_time_line(F.get(lines, at)), lambda x: F.when(x.isNotNull() & (F.size(lines) > at + 1), F.struct(x["start"].alias("start"), x["end"].alias("end"), cue_text(F.slice(lines, at + 2, F.size(lines))).alias("text"))))
        return F.when(F.size(lines) >= 2, T.let(T.let(first, named), cue))

    return T.let(F.filter(F.transform(F.split(body, "\n"), T.strip), lambda t: t != ""), timed)


def block_cues(files: DataFrame) -> DataFrame:
    """Cues of block-wise formats: source_id, block, start, end, text, of every block with a time line and text lines.

    A block with an arrow that gives none is rejected: its other columns are null.
    """
    blocks = F.split(unified_newlines(F.col("raw_text")), r"\n{2,}")
    found = files.select("source_id", F.posexplode(F.transform(blocks, lambda b: F.struct(block_cue(b).alias("cue"), F.contains(b, F.lit("-->")).alias("meant")))).alias("block", "x"))
    return found.filter("x.cue is not null or x.meant").select("source_id", "block", "x.cue.*", F.col("x.cue").isNull().alias("rejected"))


def styled_cues(files: DataFrame) -> DataFrame:
    """Cues of styled scripts: dialogue rows of the events section, split by the last format row above them; those without readable times are rejected."""
    lines = files.select("source_id", F.posexplode(F.split(unified_newlines(F.col("raw_text")), "\n")).alias("block", "line")).withColumn("line", T.strip(F.col("line")))
    section = F.when(F.col("line").rlike(r"(?i)\A\[events\]\z"), True).when(F.col("line").rlike(r"\A\[.+\]\z"), False)
    above = W.partitionBy("source_id").orderBy("block")
    inside = lines.withColumn("inside", F.coalesce(F.last(section, ignorenulls=True).over(above), F.lit(False)))
    form = F.when(F.col("inside") & F.col("line").rlike(r"(?i)\Aformat:"), F.transform(F.split(F.regexp_replace("line", r"(?i)\Aformat:", ""), ","), lambda f: F.lower(T.strip(f))))
    rows = inside.withColumn("form", F.last(form, ignorenulls=True).over(above)).filter(F.col("inside") & F.col("line").rlike(r"(?i)\Adialogue:") & F.col("form").isNotNull())
    parts = F.split(T.strip(F.regexp_replace("line", r"(?i)\Adialogue:", "")), ",")
    n = F.size("form")
    tail = F.array_join(F.slice("parts", n, F.greatest(F.size("parts"), F.lit(1))), ",")
    values = F.transform(F.concat(F.slice("parts", F.lit(1), n - 1), F.array(tail)), T.strip)
    # fields that are missing are empty; the last of two fields of one name counts
    field = lambda name: F.coalesce(F.element_at(F.transform(F.filter(F.arrays_zip("form", "fields"), lambda x: x["form"] == name), lambda x: F.coalesce(x["fields"], F.lit(""))), -1), F.lit(""))
    cut = rows.withColumn("parts", parts).withColumn("fields", values)
    named = cut.select("source_id", "block", *[F.when(F.array_contains("form", k), field(k)).otherwise("").alias(k) for k in ("start", "end", "text")])
    timed = named.select("source_id", "block", parse_styled_timestamp(F.col("start")).alias("start"), parse_styled_timestamp(F.col("end")).alias("end"), T.strip_style_markup(F.col("text")).alias("text"))
    return timed.withColumn("rejected", F.col("start").isNull() | F.col("end").isNull())


def parse_cues(files: DataFrame, observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Cues in file order and, for each source, how many were noise and how many were rejected.  ``files``: source_id, format, raw_text.

    ``observation`` gets the sums of the run, as a side output of the pass that makes the cues.
    """
    styled = F.col("format").isin("ass", "ssa")
    every = block_cues(files.filter(~styled)).unionByName(styled_cues(files.filter(styled)))
    noise = ~F.col("rejected") & ((F.col("text") == "") | T.is_noise(F.col("text")))
    every = every.withColumn("noise", noise)
    if observation is not None:
        every = every.observe(observation, F.count_if(~F.col("rejected") & ~F.col("noise")).alias("cues"), F.count_if("noise").alias("noise"), F.count_if("rejected").alias("rejected"))
    order = W.partitionBy("source_id").orderBy("block")
    cues = every.filter("not rejected and not noise").select("source_id", (F.row_number().over(order) - 1).alias("cue_index"), "start", "end", "text")
    dropped = every.groupBy("source_id").agg(F.count_if("noise").cast("int").alias("droppedNoiseCount"), F.count_if("rejected").cast("int").alias("rejectedCueCount"))
    return cues, dropped
