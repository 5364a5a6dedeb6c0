"""The fill-in-middle transformation against a plain version, its round trip and its edge cases."""

import hashlib

import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from cuewright.llm import middle

SCHEMA = "doc_id long, text string, lang string, n long, form string, output string"
TEXTS = [None, "", "a", "one two  three\nfour", "<P>", "a <S> b", "x<M>", "a<<S", "<P", "S>", "😀é́\r\n\x00z", "<" * 40, "word " * 20_000, "é" * 50]
ROWS = [(k * 7 + j, t) for j in range(7) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one two  three\nfour"), (3, "one two  three\nfour"), (2**62 + 1, "far id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in rows], SCHEMA)


def plain_version(doc_id, text, unit):
    text = text or ""
    ends = [0] + [m.end() for m in regex.finditer(unit, text)]
    n = len(ends) - 1
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    a, b = ends[a], ends[b]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("unit", [middle.CODE_POINT, middle.WORD, r"[^\n]*\n"])
def test_as_the_plain_version(spark, unit):
    found = middle.transform(frame(spark, ROWS), unit=unit).collect()
    assert in_order(map(tuple, found)) == in_order(plain_version(i, t, unit) for i, t in ROWS)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_round_trip_and_digests(spark):
    cut = middle.transform(frame(spark, ROWS))
    told = cut.withColumn("again", middle.restore(F.col("output"), F.col("form"))).withColumn("d", middle.digests(F.col("output"), F.col("form"))).collect()
    assert in_order((r.doc_id, r.again) for r in told) == in_order((i, t or "") for i, t in ROWS)
    hexed = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert all(r.d.output_sha256 == hexed(r.output) and r.d.restored_sha256 == hexed(r.again) for r in told)


def test_slices_keep_rows_in_order(spark, monkeypatch):
    rows = [(k, f"{k} " * (k % 50 + 1)) for k in range(500)]
    found = list(middle.sliced(iter([pd.DataFrame(rows, columns=["a", "b"]).astype(str).pipe(lambda d: (d["a"], d["b"]))]), 1, ["text"], lambda a, b: (a + b,)))
    assert [t for f in found for t in f["text"]] == [str(a) + b for a, b in rows]
    monkeypatch.setattr(middle, "SLICE_CHARS", 100)
    pieces = list(middle.sliced(iter([pd.DataFrame(rows, columns=["a", "b"]).astype(str).pipe(lambda d: (d["a"], d["b"]))]), 1, ["text"], lambda a, b: (a + b,)))
    assert len(pieces) > 100 and [t for f in pieces for t in f["text"]] == [str(a) + b for a, b in rows]


def test_empty_table_and_empty_unit(spark):
    empty = middle.transform(frame(spark, []))
    assert empty.withColumn("d", middle.digests(F.col("output"), F.col("form"))).collect() == []
    with pytest.raises(ValueError):
        middle.transform(frame(spark, []), unit=r"x*")
