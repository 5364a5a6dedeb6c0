"""The registered substring dedup against brute force over lines and words."""

import random
import re
from collections import Counter

import duckdb

from cuewright.llm import queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def op7(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r for r in queries.queries()["op7_substring_dedup"](spark, str(tmp_path)).collect()}


def words_of(text):
    return [(m[0].translate({c: c + 32 for c in range(65, 91)}), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]


def later_lines(rows):
    """Spans of the lines that an earlier line, by doc_id and place, has word for word."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        at = 0
        for line in (t or "").split("\n"):
            w = words_of(line)
            key = tuple(x[0] for x in w)
            if key and key in seen:
                out.setdefault(i, []).append((at + w[0][1], at + w[-1][2]))
            seen.add(key)
            at += len(line) + 1
    return out


def brute_spans(rows, run=25):
    """All that goes, by comparing words: later lines, and runs of words that stand earlier."""
    spans, first = later_lines(rows), {}
    for i, t in sorted(rows):
        w = words_of(t)
        for k in range(len(w) - run + 1):
            j, p = first.setdefault(tuple(x[0] for x in w[k : k + run]), (i, k))
            if j < i or k >= p + run:
                spans.setdefault(i, []).append((w[k][1], w[k + run - 1][2]))
    out = {}
    for i, own in spans.items():
        out[i] = []
        for a, b in sorted(own):
            if out[i] and a < out[i][-1][1]:
                out[i][-1] = (out[i][-1][0], max(b, out[i][-1][1]))
            else:
                out[i].append((a, b))
    return out


def test_every_repeated_run_is_found_to_its_last_word(spark, tmp_path):
    rng = random.Random(11)
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    foreign = lambda n: " ".join(f"é{rng.randrange(10**9)}x" for _ in range(n))
    rows = [*documents, (9999, "word " * 400 + "\n" + "a b c " * 90), (9998, "word " * 30)]
    for k in range(120):  # unpunctuated passages amid foreign words, of 24 (too short) to 70
        passage, n = foreign(80).split(), 24 + k % 47
        rows += [(10_000 + k, f"{foreign(3)} {' '.join(passage)} {foreign(3)}"), (20_000 + k, f"{foreign(k % 5)} {' '.join(passage[:n])} {foreign(2)}"), (30_000 + k, f"{foreign(2)} {' '.join(passage[5:n])} {foreign(k % 3)}")]
    want = brute_spans(rows)
    found = op7(spark, rows, tmp_path)
    assert {i: [tuple(s) for s in r.removed] for i, r in found.items() if r.removed} == want
    for i, t in rows:
        left = t
        for a, b in reversed(want.get(i, [])):
            left = left[:a] + left[b:]
        assert found[i].text == left and found[i].n_removed == len(t) - len(left)


def test_every_later_line_goes_however_short(spark, tmp_path):
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    rows = [*documents, (9001, "É own words\nAll rights reserved.\nmore"), (9002, "all  rights reserved.\nÜ other\n\nSee LICENSE"), (9003, "see license\n"), (9004, None)]
    found, want = op7(spark, rows, tmp_path), later_lines(rows)
    assert Counter(r for r in found) == Counter(i for i, _ in rows)
    assert want[9002] == [(0, 21)] and want[9003] == [(0, 11)]
    for i, spans in want.items():
        for a, b in spans:
            assert any(s.start <= a and b <= s.end for s in found[i].removed), (i, a, b)
    assert found[9002].text == "\nÜ other\n\nSee LICENSE" and found[9003].text == "\n" and found[9004].text is None


def test_copies_of_a_row_add_no_spans(spark, tmp_path):
    """As many spans meet in a task as the text has, however often its row is repeated."""
    from cuewright.llm import repeats

    text = "\n".join(f"line {k % 30} of a text" for k in range(90))
    docs = spark.createDataFrame([(1, text)] * 60 + [(0, "line 3 of a text")], SCHEMA).repartition(6)
    spans = repeats.later_spans(docs)
    listed = repeats.merged(spans).collect()
    assert [r.doc_id for r in listed] == [1] and len(listed[0].removed) <= 61
    found = repeats.dedup_repeats(docs).collect()
    one = [r for r in repeats.dedup_repeats(spark.createDataFrame([(1, text), (0, "line 3 of a text")], SCHEMA)).collect() if r.doc_id == 1][0]
    assert len(found) == 61 and {(r.text, r.n_removed) for r in found if r.doc_id == 1} == {(one.text, one.n_removed)}
