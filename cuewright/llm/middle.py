"""Operator 11: fill-in-middle transformation of whole texts, as Arrow-batched pandas UDFs.

A text is cut into units by a pattern; the end offsets of its units stand in one compact array.  Two
of them, chosen by hashes of the document's id, cut the text into prefix, middle and suffix, and the
output sets the middle last.  ``restore`` rebuilds the text from output and form alone.

A null text is an empty one, with no units, and stays plain.  The seed of a null doc_id is that of an
empty id.  Text between units goes with the unit after it, text after the last unit with the suffix.
Repeated rows give equal rows; other columns are not read.  A task holds one slice of a batch and, for
one text at a time, two or four bytes a unit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
WORD = r"\s*\S+"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SLICE_CHARS = 4 << 20

CUT = "n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTS = "output_sha256 string, restored_sha256 string"
unit_end = methodcaller("end")


def unit_ends(unit: regex.Pattern, text: str) -> array:
    """Where each unit ends, in code points.  The interpreter's lock is kept: to give it up for each unit takes longer than the unit."""
    return array("H" if len(text) < 1 << 16 else "I", map(unit_end, unit.finditer(text, concurrent=False)))


def seeds(key: str) -> list[int]:
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(unit: regex.Pattern, key: str, text: str, plain_from: int, spm_below: int) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = unit_ends(unit, text)
    n = len(ends)
    first, second, plain, order = seeds(key)
    if not text or plain % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    low, high = (ends[k - 1] if k else 0 for k in sorted((first % (n + 1), second % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if order % 100 < spm_below:
        return n, SPM, len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text of an output.  Its parts hold no mark, so the first occurrence of each is the mark itself."""
    if form == PLAIN:
        return output
    head, tail = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(head).split(tail, 1)
    other, middle = rest.split(MIDDLE, 1)
    return one + middle + other if form == PSM else other + middle + one


def sliced(batches: Iterator[tuple[pd.Series, pd.Series]], text: int, columns: list[str], row: Callable[[str, str], tuple]) -> Iterator[pd.DataFrame]:
    """``row`` of each pair, in frames of about ``SLICE_CHARS`` characters of the series number ``text``."""
    types = {c: "Int64" for c in columns if c == "n" or c.endswith("_chars")}
    for pair in batches:
        rows, held = [], 0
        for one, two in zip(*pair, strict=True):
            rows.append(row(one, two))
            held += len((one, two)[text])
            if held > SLICE_CHARS:
                yield pd.DataFrame(rows, columns=columns).astype(types)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype(types)


def names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def transformation(unit: str, plain_from: int, spm_below: int) -> Callable[[Column, Column], Column]:
    compiled = regex.compile(unit)
    if compiled.match(""):
        raise ValueError("a unit must not be empty")

    @F.pandas_udf(CUT)
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from sliced(batches, 1, names(CUT), lambda key, text: cut(compiled, key, text, plain_from, spm_below))

    return cuts


def transform(docs: DataFrame, unit: str = CODE_POINT, salt: str = "1:", plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output, a row for each row of ``docs``.

    ``salt`` and the decimal id give the seed; of 100 documents ``plain_from`` are cut, and of 100 of
    those ``spm_below`` have the suffix first.
    """
    key = F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), transformation(unit, plain_from, spm_below)(key, F.coalesce(F.col(text_col), F.lit(""))).alias("cut"))
    return rows.select("doc_id", "cut.*")


def restore(output: Column, form: Column) -> Column:
    """The exact text that an output was made from."""

    @F.pandas_udf("text string")
    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from sliced(batches, 0, ["text"], lambda out, kind: (rebuilt(out, kind),))

    return texts(output, form)["text"]


def digests(output: Column, form: Column) -> Column:
    """Lower-case hex SHA-256 of an output, and of the text rebuilt from it."""
    hexed = lambda text: hashlib.sha256(text.encode()).hexdigest()

    @F.pandas_udf(DIGESTS)
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from sliced(batches, 0, names(DIGESTS), lambda out, kind: (hexed(out), hexed(rebuilt(out, kind))))

    return both(output, form)


#: What transform and digests give over code points, in DuckDB's SQL.
MIDDLE_SQL = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
    h AS (SELECT *, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || s[17:24] AS BIGINT) % 100 AS p, CAST('0x' || s[25:32] AS BIGINT) % 100 AS o FROM t),
    f AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (SELECT *, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1) AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
    FROM c
"""
