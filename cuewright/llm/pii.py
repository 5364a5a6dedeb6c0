"""Operator 9: personal data by candidate generators and gradient-boosted trees, in DataFrame operations only.

Four base patterns (email, ip, card, phone) with their checks give spans that always stay.  Wider
generators propose further, overlapping candidates: addresses with at or dot spelled out, IPv6 whole
or shortened, cards in dotted or short groups, phone numbers without a plus sign in several groupings.  Boosted trees of depth two score each candidate by
its format and the words before it, and a threshold for each kind, calibrated on a held-out half,
selects.  The trees are trained on the driver from a fixed set of written-out examples (bounded by
``EXAMPLES``), whose features the same DataFrame expressions compute, and are applied as SQL
expressions.

Offsets are code points, ends exclusive.  Null and empty texts have no spans (redaction keeps a null
null).  Repeated rows each give a row; null doc_ids are kept; other columns pass through.
"""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

KINDS = ["email", "ip", "card", "phone"]
SPANS = "array<struct<kind:int,start:int,end:int>>"

# Each pattern starts only where its leftmost match can start (or where the last match ended), and is
# possessive where nothing is lost by it, so that long runs of one kind of character stay linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# The candidates' generators; none repeats a group without bound.
AT, DOT = r"(?:\x20{0,2}[\[({]\x20?at\x20?[\])}]\x20{0,2}|\x20at\x20)", r"(?:\x20{0,2}[\[({]\x20?dot\x20?[\])}]\x20{0,2}|\x20dot\x20)"
LABEL, H16 = "[A-Za-z0-9-]{1,63}", "[0-9A-Fa-f]{1,4}"
WIDE = [
    # name and labels with at least one of at and dot spelled out
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{2,64}}(?:{AT}{LABEL}(?:(?:\.|{DOT}){LABEL}){{0,4}}?(?:\.|{DOT})[A-Za-z]{{2,12}}(?![A-Za-z0-9-])(?!(?:\.|{DOT})[A-Za-z0-9])|\x20?@\x20?{LABEL}(?:(?:\.|{DOT}){LABEL}){{0,4}}?{DOT}[A-Za-z]{{2,12}}(?![A-Za-z0-9-])(?!(?:\.|{DOT})[A-Za-z0-9]))",
    # eight groups, or fewer with one double colon
    rf"(?<![0-9A-Fa-f:.])(?:(?:{H16}:){{7}}{H16}|{H16}(?::{H16}){{0,6}}::(?:{H16}(?::{H16}){{0,6}})?|::{H16}(?::{H16}){{0,6}})(?![0-9A-Fa-f:])",
    r"(?<![0-9])[0-9]{4}(?:[.\x20_-]?[0-9]){9,15}(?![0-9])",
    # 3-3-4, two to five groups of 2 to 4 after a leading 0, and 3-4
    r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|\(?0[0-9]{1,4}\)?(?:[\x20./-][0-9]{2,4}){2,5}|\(?0[0-9]{2,4}\)?[\x20./-][0-9]{5,8}|[0-9]{3}-[0-9]{4})(?![0-9-])",
]
GATES = [r"(?i)[ \[({](?:dot|at)[ \])}]", r"[0-9A-Fa-f]:[0-9A-Fa-f:]|::", r"[0-9]{4}", r"[0-9]{3}[\x20.-][0-9]{4}|0[0-9]{1,4}\)?[\x20./-][0-9]{2}"]

CONTEXT = 24  # code points before a candidate
CUES = {
    "mail": r"(?i)(?:e-?mail|contact|write|reach|address)[^\n]*$",
    "host": r"(?i)(?:\bip\b|host|server|node|address|client)[^\n]*$",
    "card": r"(?i)(?:card|visa|credit|debit|payment|amex|paid)[^\n]*$",
    "phone": r"(?i)(?:phone|tel\b|tel\.|call|mobile|fax|cell|text me)[^\n]*$",
    "number": r"(?i)(?:order|isbn|invoice|version|serial|\bno\.|part|build|ticket|#)[^\n]*$",
}
FEATURES = ["kind", "length", "digits", "marks", "luhn", *(f"cue_{k}" for k in CUES), "leading", "bracketed"]
EXAMPLES, SEED, ROUNDS, RATE, PRECISION = 2400, 7, 40, 0.3, 0.95


def located(text: Column, pattern: str, gate: Column) -> Column:
    """(start, end, value) of all matches: starts are the lengths of what lies between matches, summed up."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    zipped = lambda v: F.zip_with(v, F.slice(between, 1, F.size(v)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.when(gate, let(found, lambda v: F.aggregate(zipped(v), first, add)["out"])).otherwise(empty)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def worth(own: Column, k: Column) -> Column:
        d = F.substring(own, F.char_length(own) - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = lambda own: F.aggregate(F.sequence(F.lit(0), F.char_length(own) - 1), F.lit(0), lambda s, k: s + worth(own, k))
    return let(digits, lambda own: F.when(F.char_length(own) > 0, total(own) % 10 == 0).otherwise(False))


def small_parts(value: Column) -> Column:
    """Whether all parts of a dotted number are at most 255."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    worth = lambda p: F.when(F.char_length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int")).otherwise(999)
    return F.forall(F.split(value, r"\."), lambda p: worth(p) <= 255)


def base_spans(text: Column) -> list[Column]:
    """For each kind, (start, end, value) of the base matches that pass their checks."""
    digit = text.rlike("[0-9]")
    count = lambda x: F.char_length(digits_of(x["value"]))
    return [
        located(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(located(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: small_parts(x["value"])),
        F.filter(located(text, CARD, digit), lambda x: luhn(digits_of(x["value"]))),
        F.filter(located(text, PHONE, F.contains(text, F.lit("+"))), lambda x: count(x).between(8, 15)),
    ]


def candidates(text: Column) -> Column:
    """All wider candidates with their features."""

    def features(kind: int, x: Column) -> Column:
        value, digits = x["value"], digits_of(x["value"])
        before = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        flag = lambda c: c.cast("double")
        values = [F.lit(float(kind)), flag(F.char_length(value)), flag(F.char_length(digits)), flag(F.char_length(F.regexp_replace(value, "[A-Za-z0-9]", ""))), flag(luhn(digits)), *(flag(before.rlike(p)) for p in CUES.values()), flag(before.rlike("[A-Za-z0-9_/$=.]$")), flag(value.rlike(r"(?i)[\[({]\x20?(?:at|dot)\x20?[\])}]|@"))]
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*values).alias("f"))

    of_kind = lambda k: lambda x: features(k, x)
    return F.concat(*[F.transform(located(text, p, text.rlike(g)), of_kind(k)) for k, (p, g) in enumerate(zip(WIDE, GATES, strict=True))])


def examples() -> list[tuple[str, int]]:
    """Written-out texts with one candidate each, and whether it is personal."""
    rng = random.Random(SEED)
    word = lambda n=6: "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(3, n)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def valid_card(n: int) -> str:
        body = rng.choice("3456") + number(n - 2)
        total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def grouped(s: str, mark: str) -> str:
        return mark.join(s[k : k + 4] for k in range(0, len(s), 4))

    cue = lambda *cues: rng.choice([*cues, word() + " " + word(), ""])
    bad = lambda: rng.choice(["order", "isbn", "invoice", "version", "serial", "part", "ticket"])
    host = lambda dot: dot.join([*(word() for _ in range(rng.randint(1, 2))), rng.choice(["com", "org", "net", "de"])])
    hexes = lambda n: ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(n))
    makers = [
        lambda: (f"{cue('email', 'contact', 'write to')} {word()}{rng.choice(['[at]', ' (at) ', ' [at] '])}{word()}{rng.choice(['[dot]', ' (dot) ', ' [dot] '])}com", 1),
        lambda: (f"{rng.choice(['email', 'contact', 'write'])} {word()} at {word()} dot {rng.choice(['com', 'org'])}", 1),
        lambda: (f"{word()} {word()} at {word()} dot {word()}", 0),
        lambda: (f"{cue('ip', 'host', 'server')} {':'.join(f'{rng.randrange(65536):x}' for _ in range(8))}", 1),
        lambda: (f"{bad()} {':'.join(number(2) for _ in range(8))}", 0),
        lambda: (f"{cue('card', 'visa', 'payment')} {grouped(valid_card(rng.choice([14, 15, 16])), rng.choice('._'))}", 1),
        lambda: (f"{rng.choice(['card', 'visa'])} {grouped(valid_card(15), ' ')}", 1),
        lambda: (f"{cue(bad())} {grouped('1' + number(rng.randint(12, 17)), rng.choice(['', '.', '-']))}", 0),
        lambda: (f"{rng.choice(['phone', 'tel', 'call', 'mobile', 'fax'])} {number(3)}{rng.choice('-. ')}{number(3)}{rng.choice('-. ')}{number(4)}", 1),
        lambda: (f"{cue('phone', 'tel')} ({number(3)}) {number(3)}-{number(4)}", 1),
        lambda: (f"{cue(bad())} {number(3)}{rng.choice('-. ')}{number(3)}{rng.choice('-. ')}{number(4)}", 0),
        lambda: (f"{bad()} {number(6)}-{number(4)}", 0),
        lambda: (f"{cue('email', 'contact', 'mail')} {word()}{rng.choice(['[at]', '(at)', ' (at) ', ' [at] '])}{host('.')}", 1),
        lambda: (f"{cue('email', 'contact', 'mail')} {word()}{rng.choice(['@', ' @ '])}{host(rng.choice(['[dot]', ' dot ', ' (dot) ']))}", 1),
        lambda: (f"{rng.choice(['email', 'contact', 'write'])} {word()} at {host(' dot ')}", 1),
        lambda: (f"{cue('email', 'contact', 'mail')} {word()}{rng.choice(['[at]', ' [at] '])}{host(rng.choice(['[dot]', ' [dot] ']))}", 1),
        lambda: (f"{word()} {word()} at {word()}.{rng.choice(['com', 'org'])}", 0),
        lambda: (f"{cue('ip', 'host', 'server')} {hexes(rng.randint(1, 3))}::{hexes(rng.randint(1, 3))}", 1),
        lambda: (f"{rng.choice(['std', 'ab', 'dead', word(4)])}::{rng.choice(['cafe', 'add', 'be', 'f'])}", 0),
        lambda: (f"{rng.choice(['phone', 'tel', 'call', 'mobile', 'fax'])} 0{number(rng.randint(2, 4))}{rng.choice(' -/.')}{number(3)}{rng.choice(' -.')}{number(rng.randint(2, 4))}", 1),
        lambda: (f"{rng.choice(['phone', 'tel', 'call', 'mobile', 'fax'])} 0{number(1)}{''.join(rng.choice(' .') + number(2) for _ in range(4))}", 1),
        lambda: (f"{rng.choice(['phone', 'tel', 'call', 'fax'])} {number(3)}-{number(4)}", 1),
        lambda: (f"{cue(bad())} {number(3)}-{number(4)}", 0),
        lambda: (f"{cue(bad())} 0{number(1)}{rng.choice('-./')}{number(2)}{rng.choice('-./')}{number(4)}", 0),
    ]
    return [makers[k % len(makers)]() for k in range(EXAMPLES)]


def split_of(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    """The gain, feature and threshold (values up to it go left) of the best split."""
    best = (1e-9, -1, 0.0)
    score = lambda a, b: a * a / (b + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gain = score(cg[cut], ch[cut]) + score(cg[-1] - cg[cut], ch[-1] - ch[cut]) - score(cg[-1], ch[-1])
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    gain, j, at = split_of(x, g, h) if depth and len(x) > 10 else (0, -1, 0)
    if j < 0:
        return -RATE * float(g.sum()) / (float(h.sum()) + 1.0)
    left = x[:, j] <= at
    return j, at, grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1)


def value_of(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, at, low, high = tree
    return np.where(x[:, j] <= at, value_of(low, x), value_of(high, x))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    trees, total = [], np.zeros(len(x))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        trees.append(grow(x, p - y, p * (1 - p), 2))
        total = total + value_of(trees[-1], x)
    return trees


def thresholds(scores: np.ndarray, kinds: np.ndarray, y: np.ndarray) -> list[float]:
    """For each kind, the least score from which on the held-out precision is ``PRECISION``; none selects nothing."""
    out = []
    for k in range(len(KINDS)):
        s, t = scores[kinds == k], y[kinds == k]
        order = np.argsort(-s, kind="stable")
        precise = np.cumsum(t[order]) / np.arange(1, len(s) + 1)
        last = np.append(np.diff(s[order]) != 0, True)[: len(s)]
        good = np.flatnonzero((precise >= PRECISION) & last)
        out.append(float(s[order][good[-1]]) if len(good) else math.inf)
    return out


def tree_column(tree: tuple | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    j, at, low, high = tree
    return F.when(F.get(f, F.lit(j)) <= at, tree_column(low, f)).otherwise(tree_column(high, f))


_MODEL: list[tuple[list, list[float]]] = []


def trained(spark: SparkSession) -> tuple[list, list[float]]:
    """Trees from half of the examples and thresholds from the other half; trained once a process."""
    if not _MODEL:
        rows = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(examples())], "id int, text string, y int")
        found = rows.select("id", "y", F.explode(candidates(F.col("text"))["f"]).alias("f")).collect()
        found.sort(key=lambda r: (r.id, r.f))
        x, y, ids = np.array([r.f for r in found]), np.array([r.y for r in found], float), np.array([r.id for r in found])
        fit = ids // 24 % 2 == 0
        trees = boost(x[fit], y[fit])
        scores = sum(value_of(t, x[~fit]) for t in trees)
        _MODEL.append((trees, thresholds(scores, x[~fit][:, 0], y[~fit])))
    return _MODEL[0]


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_ (an array of span arrays by kind) and spans_ (all spans by kind, then start)."""
    trees, cut = trained(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda k, a: F.transform(a, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    found = docs.withColumn("base_", F.array(*[bare(k, a) for k, a in enumerate(base_spans(text))])).withColumn("wide_", candidates(text))
    score = lambda f: reduce(lambda a, b: a + b, [tree_column(t, f) for t in trees])
    limit = lambda kind: reduce(lambda rest, k: F.when(kind == k, F.lit(cut[k])).otherwise(rest), range(len(KINDS)), F.lit(math.inf))
    clear = lambda c: ~F.exists(F.flatten("base_"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    picked = F.filter("wide_", lambda c: clear(c) & (score(c["f"]) >= limit(c["kind"])))
    plain = F.transform(picked, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    chosen = F.when(F.size("wide_") > 0, F.concat(F.flatten("base_"), plain)).otherwise(F.flatten("base_"))
    return found.withColumn("spans_", F.array_sort(chosen)).drop("wide_")


def written(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, and all spans."""
    found = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(F.get("base_", F.lit(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.flatten("base_")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans_")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans by the first one's."""
    columns = docs.columns
    docs = docs.toDF(*[f"kept_{k}" if c.lower() in ("base_", "spans_", "wide_") else c for k, c in enumerate(columns)])
    text = F.col(text_col)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("spans_", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        parts = F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.get(marks, s["kind"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], parts)).otherwise(state["out"]).alias("out"))

    done = F.aggregate(ordered, first, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))
    return with_spans(docs, text_col).withColumn(text_col, F.when(F.size("spans_") > 0, done).otherwise(text)).drop("base_", "spans_").toDF(*columns)
