"""The whole pipeline against plain Python: every stage over what the one before kept."""

import math
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
from test_operators import DATA, brute_base, brute_components, brute_matches, shingle_set
from tokenizers import Tokenizer

from cuewright.llm import pii, quality

MARKS = {k: f"[{k.upper()}]" for k in ("email", "ip", "card", "phone")}


def plain_features(text):
    data = text.encode()
    shares = [0] * 10
    for b in data:
        c = chr(b)
        kind = 9 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t" else 4 if c in "\n\r" else 5 if c in ",.;:" else 6 if c in "!?" else 7 if c == "|" else 8
        shares[kind] += 1
    words = re.findall(rb"[^\x20\x09-\x0D]+", data.lower())
    n, distinct = max(len(words), 1), len(set(words))
    marked = sum(w[-1] < 128 and not chr(w[-1]).isalnum() and chr(w[-1]) not in ",.;:!?|" for w in words)
    return [*(s / max(len(data), 1) for s in shares), sum(map(len, words)) / n / 10, distinct / n, distinct / math.sqrt(n), marked / n, math.log1p(n) / 10]


def plain_evidence(model, text):
    x = plain_features(text)
    z = [(v - m) / s for v, m, s in zip([*x, *(v * v for v in x)], model["mean"], model["spread"], strict=True)]
    return max(-12, min(12, model["w"][0] + sum(w * max(-6, min(6, v)) for w, v in zip(model["w"][1:], z, strict=True))))


def plain_posteriors(rows, model, site_weight=0.5):
    """doc_id: log odds; sites as dictionaries, shrunk towards the global rate and then towards their host."""
    evidence = {i: plain_evidence(model, t or "") for i, t, *_ in rows}
    hosts, paths = {}, {}
    for i, _, lang, source in rows:
        p = 1 / (1 + math.exp(-evidence[i]))
        for level, key in ((hosts, source), (paths, (source, lang))):
            n, total = level.get(key, (0, 0.0))
            level[key] = n + 1, total + p
    all_n, all_total = len(rows), sum(t for _, t in hosts.values())
    rate = all_total / all_n

    def prior(level):  # (n, total, mean of the parent, rows of the parent)
        v = lambda m: max(m * (1 - m), 1e-9)
        between = sum(n * (t / n - m) ** 2 for n, t, m, of in level)
        noise = sum(v(m) * (1 - n / of) for n, t, m, of in level)
        room = sum(n * (1 - n / of) for n, t, m, of in level)
        within = sum(n * v(m) for n, t, m, of in level) / sum(n for n, *_ in level)
        excess = (between - noise) / room if room else 0.0
        return min(max(within / excess - 1 if excess > 0 else 1e6, 5.0), 1e6)

    for_host = prior([(n, t, rate, all_n) for n, t in hosts.values()])
    for_path = prior([(n, t, hosts[h][1] / hosts[h][0], hosts[h][0]) for (h, _), (n, t) in paths.items()])
    host_rate = {h: (t + for_host * rate) / (n + for_host) for h, (n, t) in hosts.items()}
    odds = lambda r: math.log(r / (1 - r))
    path_rate = {k: min(1 - 1e-6, max(1e-6, (t + for_path * host_rate[k[0]]) / (n + for_path))) for k, (n, t) in paths.items()}
    return {i: evidence[i] + site_weight * (odds(path_rate[s, lang]) - odds(rate)) for i, _, lang, s in rows}


def plain_redaction(text, spans):
    out, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], MARKS[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_against_plain_python(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")

    model = quality.fit(docs, labels)
    odds = plain_posteriors(rows, model)
    judged = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert all(abs(judged[i].posterior_ - 1 / (1 + math.exp(-x))) < 1e-6 for i, x in odds.items())
    left = {i: t for i, t, *_ in rows if odds[i] >= 0}
    assert len(left) < len(rows)

    groups = brute_components({i: shingle_set(t or "") for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    hit = {d for d, _ in brute_matches([(i, t or "") for i, t in left.items()], items)}
    left = {i: t for i, t in left.items() if i not in hit}
    assert hit and len(set(groups.values())) < len(groups)

    kept = docs.filter(docs.doc_id.isin(list(left)))
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.personal_data(kept).collect()}
    for i, t in left.items():  # the base spans by themselves; the candidates are the trees' own choice
        assert {s for kind in brute_base(t or "") for s in kind} <= {":".join(s) for s in spans[i]}
    left = {i: plain_redaction(t or "", spans[i]) for i, t in left.items()}

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = set()
    for i, t in left.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.add((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = corpus_pipeline.run(spark, DATA).collect()
    assert len(found) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == want
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([a for a, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048 for b in bins.values())
