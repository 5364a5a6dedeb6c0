"""Scalar text functions on transcript text, as expressions on columns.

White space is what Python calls so, in every function; Java's own class is ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # all but the blank
SPACE = f"[ {WIDE}]"
BLANKS = " " + "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Plain characters are told by one range before the long class is asked; single blanks between words are no match.
GAP, UNEVEN_GAP, WORD = f"(?![!-~]){SPACE}+", f"(?![!-~])(?: *+[{WIDE}]{SPACE}*+| {{2,}})", f"(?:[!-~]++|[^ {WIDE}])++"

# Entities in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
# Cue markup patterns and their replacements, in order.
CUE_MARKUP = [
    (r"<\d{2}:\d{2}:\d{2}\.\d{3}>", " "),
    (r"</?c(?:\.[^>]*)?>", " "),
    (r"<v\s+([^>]+)>", "$1: "),
    (r"</v>", " "),
    (r"</?(?:i|b|u|ruby|rt|lang)[^>]*>", " "),
    (r"<[^>]+>", " "),
]
# Patterns of styled-script markup.
STYLE_MARKUP = [(r"\{[^}]*\}", " "), (r"\\[Nnh]", " ")]
# Whole cue texts that are noise.
NOISE = ["[music]", "(music)", "[applause]", "(applause)", "[laughter]", "(laughter)"]
# Words that continue a sentence.
CONTINUATIONS = [
    "and", "but", "so", "because", "if", "when", "which", "that", "to", "or", "then", "than", "as", "while", "though", "although", "unless", "until", "for", "with", "without", "where", "who",
    "whose", "whom", "what", "how",
]
# Openings that shift the topic.
TOPIC_SHIFTS = ["anyway", "also", r"yeah,\s*so", "okay", "wait", "but", "pilates", "what kind of games", "there's an ankh test", "are streams this time of day"]
# Ends of sentences and clauses, and the markup of rolling captions.
STRONG_STOP, SOFT_STOP = r"[.!?][\"')\]]*\n?\z", r"[,;:][\"')\]]*\n?\z"
ROLLING = r"<\d{2}:\d{2}:\d{2}\.\d{3}>|(?i)</?c(?:\.[^>]*)?>"
# Summaries by keyword rule, in order of priority.
LIVE_CHAT_RULES = [
    (["youtube", "twitch"], ["get along", "cellmates", "behind the bars", "introduce them to each other"], "Opening dual-stream setup where chat platforms are framed as needing to get along."),
    ([], ["house", "mortgage", "save money"], "Practical tangent about money, housing, and stream-related upgrades."),
    ([], ["illustrations", "artist", "subathon"], "Planning segment about art commissions, stream events, and pending rewards."),
    ([], ["support everyone", "be nice", "penguins"], "Community-values segment focused on friendliness and audience culture."),
]
CLEANING_SUMMARY = "removed subtitle indices, timestamps, and subtitle markup; merged wrapped lines; merged likely cross-cue continuations; dropped exact duplicate cue repeats where present"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(BLANKS))


def compact(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, UNEVEN_GAP, " "))


def decode_entities(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def strip_cue_markup(text: Column) -> Column:
    for pattern, by in CUE_MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return compact(decode_entities(text))


def strip_style_markup(text: Column) -> Column:
    for pattern, by in STYLE_MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return compact(decode_entities(text))


def is_noise(text: Column) -> Column:
    return F.lower(strip(text)).isin(NOISE)


def ends_strongly(text: Column) -> Column:
    return text.rlike(STRONG_STOP)


def ends_softly(text: Column) -> Column:
    return text.rlike(SOFT_STOP)


def starts_with_continuation(text: Column) -> Column:
    return text.rlike(rf"(?i)\A(?:{'|'.join(CONTINUATIONS)})(?U:\b)")


def starts_with_topic_shift(text: Column) -> Column:
    return text.rlike(rf"(?i)\A(?:{'|'.join(TOPIC_SHIFTS)})")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: an expression that a lambda repeats is computed anew each time."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def shared_words(p: Column, c: Column) -> Column:
    """The most words that end the array ``p`` and start the array ``c``; a whole slice is compared only where its first word fits."""

    def longest(x: Column) -> Column:
        size, most = F.size(x["p"]), F.least(F.size(x["p"]), F.size(x["c"]))
        fits = lambda k: (k <= most) & (F.get(x["p"], size - k) == F.get(x["c"], F.lit(0))) & (F.slice(x["p"], size - k + 1, k) == F.slice(x["c"], F.lit(1), k))
        return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), most)), fits)), F.lit(0))

    return let(F.struct(p.alias("p"), c.alias("c")), longest)


def word_overlap(previous: Column, current: Column) -> Column:
    """The most words that end ``previous`` and start ``current``, in any case."""
    return shared_words(tokens(F.lower(previous)), tokens(F.lower(current)))


def added(previous: Column, current: Column, words: Column, k: Column) -> Column:
    """What ``current``, of ``words``, adds to ``previous``, with which it shares ``k`` words: nothing if ``previous`` ends with it."""
    rest = F.array_join(F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), " ")
    return F.when(previous == "", current).when(F.endswith(F.lower(previous), F.lower(current)), "").when(k == 0, current).otherwise(rest)


def remove_overlap(previous: Column, current: Column) -> Column:
    return let(F.struct(word_overlap(previous, current).alias("k"), tokens(current).alias("w")), lambda x: added(previous, current, x["w"], x["k"]))


def merge_texts(previous: Column, current: Column) -> Column:
    return let(remove_overlap(previous, current), lambda more: F.when(more == "", previous).otherwise(compact(F.concat_ws(" ", previous, more))))


def continues(previous: Column, current: Column, words: Column | None = None) -> Column:
    """Whether ``current`` goes on with the sentence of ``previous``, whose number of words may be given."""
    return (
        F.when((previous == "") | ends_strongly(previous), False)
        .when(ends_softly(previous) | current.rlike(r"\A[a-z]") | starts_with_continuation(current), True)
        .otherwise(((word_count(previous) if words is None else words) <= 4) & current.rlike(r"\A[a-zA-Z]"))
    )


def clock(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS, hours without bound."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def clip(text: Column, limit: int = 160) -> Column:
    return let(compact(text), lambda short: F.when(F.char_length(short) <= limit, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, limit - 1)), F.lit("..."))))


def first_sentence(text: Column) -> Column:
    """Up to the first stop that white space or the end follows, on one line; empty if there is none."""
    return F.regexp_extract(text, rf"(?dm)^.*?[.!?](?:{SPACE}|\z)", 0)  # the earliest match starts a line; elsewhere none is tried


def two_digits(index: Column) -> Column:
    return F.format_string("%02d", index)


def live_chat_summary(text: Column, index: Column) -> Column:
    low = F.lower(text)
    has = lambda word: F.contains(low, F.lit(word))
    out = None
    for every, some, summary in LIVE_CHAT_RULES:
        test = has(some[0])
        for word in some[1:]:
            test = test | has(word)
        for word in every:
            test = test & has(word)
        out = F.when(test, F.lit(summary)) if out is None else out.when(test, F.lit(summary))
    return out.otherwise(F.concat(F.lit("Live-chat segment "), two_digits(index), F.lit(": "), let(first_sentence(text), lambda found: F.when(found != "", strip(found)).otherwise(clip(text, 120)))))


def article_summary(text: Column, index: Column) -> Column:
    return F.concat(F.lit("Argument unit "), two_digits(index), F.lit(": "), clip(let(first_sentence(text), lambda found: F.when(found != "", strip(found)).otherwise(text)), 150))


def segment_summary(text: Column, track: Column, index: Column) -> Column:
    return F.when(track == "article_reading", article_summary(text, index)).otherwise(live_chat_summary(text, index))


def strip_subtitle_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)(?:\.[a-z]{2}(?:-[A-Za-z]+)?)?\.(?:srt|vtt|ass|ssa)$", "")


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot starts none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def source_id(name: Column) -> Column:
    """The last bracketed group of plain characters with no bracket after it, else the stem without language suffixes."""
    bracketed = F.regexp_extract(name, r"\[([A-Za-z0-9_-]+)\][^\[]*$", 1)
    return F.when(bracketed != "", bracketed).otherwise(F.regexp_replace(stem(name), r"(?i)(?:\.[a-z]{2}(?:-[A-Za-z]+)?)+$", ""))


def ascii_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E]+", " "), " +", " "))


def default_title(stem_: Column, id_: Column, track: Column) -> Column:
    named = F.when(track == "article_reading", F.lit("Article-style subtitle transcript [")).otherwise(F.lit("Live chat transcript ["))
    return F.coalesce(F.nullif(stem_, F.lit("")), F.concat(named, id_, F.lit("]")))
