"""Order-dependent folds over a source's cues: cleaning, paragraphs, segments, and their statistics.

Each source is one row with its cues in an array, folded by native expressions.  The state keeps the
open element apart from the closed ones, so a step that only extends it copies nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.schemas import PARAGRAPHS, UTTERANCES

GAP_SECONDS, FULL_WORDS, MOST_WORDS = 8.0, 85, 140
# What stands before the first and after the last segment of each track.
EDGES = {"live_chat": ("Stream opening.", "Segment sequence ends here."), "article_reading": ("Opening of the source argument.", "End of the current source argument sequence.")}


def ordered(rows: DataFrame, index: str, *fields: str) -> DataFrame:
    """source_id, items: the rows of each source as an array in order of ``index``."""
    packed = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(index, *fields))).alias("items"))
    return packed.select("source_id", F.transform("items", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("items"))


def null_of(kind: str) -> Column:
    return F.lit(None).cast(kind)


def clean(cues: DataFrame) -> DataFrame:
    """source_id, utterances, raw, deduped, merged: repeated and rolling cues folded into the utterance before them.

    A cue is compared with the accumulated text: an equal one, or one that adds nothing, only moves its end;
    one that overlaps or continues it is merged; any other starts a new utterance with what it adds.  A null
    text is an empty one.  The open utterance keeps its words, so each cue is split once, and only as many
    of the utterance's last words are looked at as the cue has.
    """
    one = "struct<start:double,end:double,text:string,low:array<string>>"

    def utterance(start: Column, end: Column, text: Column, low: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), text.alias("text"), low.alias("low"))

    def state(out: Column, last: Column, deduped: Column, merged: Column) -> Column:
        return F.struct(out.alias("out"), last.alias("last"), deduped.alias("deduped"), merged.alias("merged"))

    def rest(words: Column, k: Column) -> Column:
        return F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1)))

    def step(s: Column, cue: Column) -> Column:
        last = s["last"]
        before = last["text"]

        def merge(x: Column) -> Column:
            """The cue's new words overlap the open utterance once more after the first removal."""
            again = lambda k: T.let(T.added(before, x["more"], x["words"], k), lambda more: F.when(more == "", utterance(last["start"], cue["end"], before, last["low"])).otherwise(utterance(last["start"], cue["end"], T.compact(F.concat_ws(" ", before, more)), F.concat(last["low"], rest(x["low"], k)))))
            return T.let(T.shared_words(last["low"], x["low"]), again)

        def decide(x: Column) -> Column:
            same = (x["more"] == "") | (F.lower(before) == F.lower(cue["text"]))
            joins = ((x["k"] > 0) & ~T.ends_strongly(before)) | T.continues(before, x["more"], F.size(last["low"]))
            return (
                F.when(same, state(s["out"], utterance(last["start"], cue["end"], before, last["low"]), s["deduped"] + 1, s["merged"]))
                .when(joins, state(s["out"], merge(x), s["deduped"], s["merged"] + 1))
                .otherwise(state(F.array_append(s["out"], last.dropFields("low")), utterance(cue["start"], cue["end"], x["more"], x["low"]), s["deduped"], s["merged"]))
            )

        cut = lambda k: F.struct(k.alias("k"), T.added(before, cue["text"], cue["words"], k).alias("more"), rest(cue["words"], k).alias("words"), rest(cue["low"], k).alias("low"))
        seen = T.let(T.shared_words(last["low"], cue["low"]), cut)
        return F.when(before.isNull(), state(s["out"], utterance(cue["start"], cue["end"], cue["text"], cue["low"]), s["deduped"], s["merged"])).otherwise(T.let(seen, decide))

    start = state(F.array().cast(UTTERANCES), null_of(one), F.lit(0), F.lit(0))
    text = F.coalesce("text", F.lit(""))
    split = cues.select("source_id", "cue_index", "start", "end", text.alias("text"), T.tokens(text).alias("words"), T.tokens(F.lower(text)).alias("low"))
    folded = ordered(split, "cue_index", "start", "end", "text", "words", "low").select("source_id", F.size("items").alias("raw"), F.aggregate("items", start, step).alias("f"))
    return folded.select("source_id", F.array_append("f.out", F.col("f.last").dropFields("low")).alias("utterances"), "raw", "f.deduped", "f.merged")


BLOCK = 10_000  # rows of a source that one task looks at together


def before(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of its source up to and including each, by blocks of ``order``.

    A source's rows meet only within a block; across blocks meet their sums, a row for each.
    """
    placed = rows.withColumn("block_", F.floor(F.col(order) / BLOCK)).withColumn("value_", value)
    sums = placed.groupBy("source_id", "block_").agg(F.sum("value_").alias("sum_"))
    earlier = W.partitionBy("source_id").orderBy("block_").rowsBetween(W.unboundedPreceding, -1)
    start = sums.select("source_id", "block_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("start_"))
    own = W.partitionBy("source_id", "block_").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("own_", F.sum("value_").over(own)).join(start, ["source_id", "block_"]).select(*rows.columns, (F.col("start_") + F.col("own_")).alias(name))


def islands(utterances: DataFrame) -> DataFrame:
    """``utterances`` (source_id, utterance_index, start, end, text) with the number of the stretch between pauses that each is in.

    A pause of 8 s ends a paragraph whatever came before, so what follows it is folded as from the start.
    Pauses are counted within blocks; across blocks meet a block's first start, last end and count.
    """
    is_pause = lambda end: F.coalesce((F.col("start") - end >= GAP_SECONDS).cast("long"), F.lit(0))
    inside = W.partitionBy("source_id", "block_").orderBy("utterance_index")
    placed = utterances.withColumn("block_", F.floor(F.col("utterance_index") / BLOCK)).withColumn("pause_", is_pause(F.lag("end").over(inside)))
    counted = placed.withColumn("own_", F.sum("pause_").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("pause_")
    blocks = counted.groupBy("source_id", "block_").agg(F.max("own_").alias("n_"), F.min_by("start", "utterance_index").alias("start"), F.max_by("end", "utterance_index").alias("end"))
    order = W.partitionBy("source_id").orderBy("block_")
    edges = blocks.withColumn("edge_", is_pause(F.lag("end").over(order)))
    earlier = F.coalesce(F.sum(F.col("n_") + F.col("edge_")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = edges.select("source_id", "block_", (earlier + F.col("edge_")).alias("before_"))
    return counted.join(starts, ["source_id", "block_"]).select(*utterances.columns, (F.col("before_") + F.col("own_")).alias("island"))


def paragraph_rows(utterances: DataFrame) -> DataFrame:
    """source_id, paragraph_index and the paragraph, of utterances in rows: as ``paragraphs``, but a source spreads over tasks.

    The unit of work is the stretch between two pauses; one recording without any is one task's.
    """
    stretch = islands(utterances).groupBy("source_id", "island").agg(F.array_sort(F.collect_list(F.struct("utterance_index", "start", "end", "text"))).alias("items"))
    folded = paragraphs(stretch.select("source_id", "island", F.transform("items", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("utterances")))
    counted = before(folded.select("source_id", "island", "paragraphs"), "island", F.size("paragraphs").cast("long"), "until")
    rows = counted.select("source_id", (F.col("until") - F.size("paragraphs")).alias("first"), F.posexplode("paragraphs").alias("at", "p"))
    return rows.select("source_id", (F.col("first") + F.col("at")).cast("int").alias("paragraph_index"), "p.*")


def paragraphs(cleaned: DataFrame) -> DataFrame:
    """``cleaned`` with its paragraphs: a gap of 8 s closes one before an utterance; enough words and a stop, or too many words, after it."""
    one = "struct<start:double,end:double,text:string,wordCount:int>"

    def record(start: Column, end: Column, text: Column, words: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), text.alias("text"), words.cast("int").alias("wordCount"))

    def step(s: Column, u: Column) -> Column:
        gap = s["open"].isNotNull() & (u["start"] - s["end"] >= GAP_SECONDS)
        out = F.when(gap, F.array_append(s["out"], s["open"])).otherwise(s["out"])
        fresh = record(u["start"], u["end"], u["text"], u["words"])
        longer = record(s["open"]["start"], u["end"], F.concat_ws(" ", s["open"]["text"], u["text"]), s["open"]["wordCount"] + u["words"])
        now = F.when(gap | s["open"].isNull(), fresh).otherwise(longer)

        def close(x: Column) -> Column:
            words = x["open"]["wordCount"]
            full = ((words >= FULL_WORDS) & u["stop"]) | (words >= MOST_WORDS)
            return F.struct(F.when(full, F.array_append(x["out"], x["open"])).otherwise(x["out"]).alias("out"), F.when(~full, x["open"]).alias("open"), u["end"].alias("end"))

        return T.let(F.struct(out.alias("out"), now.alias("open")), close)

    counted = F.transform("utterances", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), u["text"].alias("text"), T.word_count(u["text"]).alias("words"), T.ends_strongly(u["text"]).alias("stop")))
    start = F.struct(F.array().cast(PARAGRAPHS).alias("out"), null_of(one).alias("open"), null_of("double").alias("end"))
    whole = lambda f: F.when(f["open"].isNotNull(), F.array_append(f["out"], f["open"])).otherwise(f["out"])
    return cleaned.withColumn("paragraphs", F.aggregate(counted, start, step, whole))


def splits(track: Column, words: Column, count: Column, gap: Column, following: Column) -> Column:
    """Whether the open segment closes before the next paragraph."""
    live = (words >= 460) | ((words >= 340) & ((count >= 4) | (gap >= 40) | (T.starts_with_topic_shift(following) & (count >= 4)))) | ((words >= 260) & (gap >= 90))
    article = (words >= 560) | ((words >= 340) & (count >= 3)) | ((words >= 260) & (count >= 2) & (gap >= 20))
    return (count > 0) & F.when(track == "article_reading", article).otherwise(live)


def segments(listed: DataFrame, track: Column) -> DataFrame:
    """source_id, track, segmentIndex, start, end, startRef, endRef, wordCount, text, sceneSummary and the neighbours' summaries.

    Segments are slices of a source's paragraphs, cut and joined inside its row: nothing is shuffled or sorted.
    """
    edge = lambda k: F.when(track == "article_reading", EDGES["article_reading"][k]).otherwise(EDGES["live_chat"][k])

    def step(s: Column, p: Column) -> Column:
        cut = splits(track, s["words"], s["count"], F.when(s["count"] > 0, p["start"] - s["end"]).otherwise(0.0), p["text"])
        next_ = lambda c: F.struct((s["at"] + 1).alias("at"), (F.when(c, 0).otherwise(s["words"]) + p["wordCount"]).alias("words"), (F.when(c, 0).otherwise(s["count"]) + 1).alias("count"), p["end"].alias("end"), F.when(c, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"]).alias("cuts"))
        return T.let(cut, next_)

    def segment(ps: Column, index: Column) -> Column:
        text, words = F.array_join(F.transform(ps, lambda p: p["text"]), "\n\n"), F.aggregate(ps, F.lit(0), lambda n, p: n + p["wordCount"])
        first, last = F.get(ps, F.lit(0))["start"], F.element_at(ps, -1)["end"]
        named = lambda t: F.struct(index.alias("segmentIndex"), first.alias("start"), last.alias("end"), T.clock(first).alias("startRef"), T.clock(last).alias("endRef"), words.alias("wordCount"), t.alias("text"), T.segment_summary(t, track, index).alias("sceneSummary"))
        return T.let(text, named)

    def sliced(cuts: Column) -> Column:
        return F.transform(cuts, lambda c, i: T.let(F.slice("paragraphs", c + 1, F.coalesce(F.get(cuts, i + 1), F.size("paragraphs")) - c), lambda ps: segment(ps, (i + 1).cast("int"))))

    def placed(all_: Column) -> Column:
        near = lambda k, side: F.coalesce(F.get(all_, k)["sceneSummary"], edge(side))
        return F.transform(all_, lambda x, i: F.struct(x.alias("own"), near(i - 1, 0).alias("contextBefore"), near(i + 1, 1).alias("contextAfter")))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("words"), F.lit(0).alias("count"), F.lit(0.0).alias("end"), F.array(F.lit(0)).alias("cuts"))
    found = T.let(T.let(F.aggregate("paragraphs", start, step)["cuts"], sliced), placed)
    rows = listed.filter(F.size("paragraphs") > 0).select("source_id", track.alias("track"), F.explode(found).alias("x"))
    return rows.select("source_id", "track", "x.own.*", "x.contextBefore", "x.contextAfter")


def transcripts(files: DataFrame, observation: Observation | None = None) -> DataFrame:
    """``files`` (source_id, format, raw_text) with utterances, paragraphs and stats; a file without cues has empty ones.

    ``observation``: told, when the rows are computed, how many cues and rejected cues there were in all.
    """
    from cuewright.operators.cues import parse_cues

    cues, dropped = parse_cues(files, observation)
    listed = files.select("source_id", "format").join(paragraphs(clean(cues)), "source_id", "left").join(dropped, "source_id", "left")
    whole = listed.select("source_id", "format", F.coalesce("utterances", F.array().cast(UTTERANCES)).alias("utterances"), F.coalesce("paragraphs", F.array().cast(PARAGRAPHS)).alias("paragraphs"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "deduped", "merged", "droppedNoiseCount", "rejectedCueCount")])
    first, last = F.get("utterances", F.lit(0)), F.when(F.size("utterances") > 0, F.element_at("utterances", -1))
    counts = F.struct(F.col("format"), F.col("raw").alias("rawCueCount"), F.size("utterances").alias("cleanedUtteranceCount"), F.col("deduped").alias("dedupedCount"), F.col("merged").alias("mergedCueCount"), F.col("droppedNoiseCount"), F.coalesce(first["start"], F.lit(0.0)).alias("start"), F.coalesce(last["end"], F.lit(0.0)).alias("end"), F.col("rejectedCueCount"))
    return whole.select("source_id", "utterances", "paragraphs", counts.alias("stats"))
