"""Forms of personal data beyond the base patterns, by generator and by the trees' selection."""

import pytest
from pyspark.sql import functions as F

from cuewright.llm import pii

FORMS = [
    (0, "mail ", "bob[at]example[dot]com"), (0, "mail ", "bob[at]host.com"), (0, "contact ", "ann at mail dot host dot com"), (0, "email ", "ann@host[dot]org"),
    (1, "server ", "2001:db8::1"), (1, "host ", "fe80::1:2"), (1, "server ", "2001:db8:0:1:2:3:4:5"), (3, "phone ", "030 123 4567"), (3, "tel ", "01 23 45 67 89"), (3, "call ", "555-0199"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, f"Ü text, {cue}{value} and more") for k, (_, cue, value) in enumerate(FORMS)], "doc_id long, text string")
    wide = rows.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()
    return {r.doc_id: r.c for r in wide}, {r.doc_id: r.spans for r in pii.personal_data(rows).collect()}


@pytest.mark.parametrize("k", range(len(FORMS)))
def test_form(found, k):
    kind, cue, value = FORMS[k]
    start = len("Ü text, " + cue)
    assert (kind, start, start + len(value)) in [(c["kind"], c.start, c.end) for c in found[0][k]]
    assert f"{pii.KINDS[kind]}:{start}:{start + len(value)}" in found[1][k].split(",")
