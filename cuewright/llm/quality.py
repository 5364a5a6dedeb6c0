"""Operator 3: document quality by a classifier and hierarchical empirical Bayes over sites.

A logistic regression on character and word statistics gives each document's evidence.  Its mean by
host and by path is shrunk level by level: a host towards the global rate, a path towards its host,
each as strongly as the spread between sites (method of moments) says.  A document's posterior adds
the log odds of its path's shrunken rate against the global one to its own evidence, weighed by
``site_weight``.

The classifier is fitted on at most ``FIT_ROWS`` labelled documents, those with the least hash of
doc_id; everything else covers all rows.  Without labels of both classes every document is kept.
Null and empty texts are scored as texts without characters.  A null host or path is a site of its
own.  Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, staged, text_slices, utf8_bytes
from .word_hashes import words

FIT_ROWS = 20_000
BROADCAST_ROWS = 100_000

#: Classes of bytes whose shares are features.
CLASSES = ["lower", "upper", "digit", "space", "newline", "comma or stop", "! or ?", "bar", "other mark", "above ASCII"]


def byte_classes() -> np.ndarray:
    out = np.full(256, 8, np.uint8)
    for k, members in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b",.;:", b"!?", b"|"]):
        out[list(members)] = k
    out[128:] = 9
    return out


OF_BYTE = byte_classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row a text: shares of the byte classes, word length, variety of words and lines, and size."""
    flat, offsets = utf8_bytes(texts)
    n, k = len(texts), len(CLASSES)
    row = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(row * k + OF_BYTE[flat], minlength=n * k).reshape(n, k) / np.maximum(np.diff(offsets), 1)[:, None]
    hashes, starts, ends, at = words(flat, offsets)
    count = np.maximum(np.diff(at), 1)
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    length = (total[at[1:]] - total[at[:-1]]) / count
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)])
    marked = np.concatenate([[0], np.cumsum(OF_BYTE[flat[ends - 1]] == 8)]) if len(ends) else np.zeros(1)
    return np.column_stack([shares, length / 10, distinct / count, distinct / np.sqrt(count), (marked[at[1:]] - marked[at[:-1]]) / count if len(ends) else np.zeros(n), np.log1p(count) / 10])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> dict[str, np.ndarray]:
    """Newton's method on standardised features and their squares."""
    x = np.column_stack([x, x**2])
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / spread, -6, 6)])
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * (z.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "spread": spread, "w": w}


def log_odds(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = np.clip((np.column_stack([x, x**2]) - model["mean"]) / model["spread"], -6, 6)
    return np.clip(model["w"][0] + z @ model["w"][1:], -12, 12)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> dict[str, np.ndarray] | None:
    """The classifier from at most ``FIT_ROWS`` labelled rows, whose features alone reach the driver."""
    chosen = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(FIT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], pa.array(features(batch["text"]).tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(run, "id long, y int, x array<double>").toPandas()
    # in one order, whatever the order of the tasks
    rows = rows.sort_values(["id", "y"], kind="stable")
    if rows["y"].nunique() < 2:
        return None
    return fit_logistic(np.array(rows["x"].tolist()), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` and ``evidence_``, the classifier's log odds of good quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = iter(text_slices(iter([batch.select(["text"])]), "text", 1 << 20))
            parts = [log_odds(model, features(part["text"])) for part in whole]
            yield batch.append_column("evidence_", pa.array(np.concatenate(parts) if parts else np.zeros(0)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("evidence_", T.DoubleType())]))


def site_rates(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """host_, path_, rate of every path, and the global rate; all by grouped sums."""
    p = 1 / (1 + F.exp(-F.col("evidence_")))
    # staged, so that the texts are scored for it once
    paths = staged(scored.select(F.col(host).alias("host_"), F.col(path).alias("path_"), p.alias("p")).groupBy("host_", "path_").agg(F.count("*").alias("n"), F.sum("p").alias("total")), "sites")
    hosts = paths.groupBy("host_").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    all_n, all_total = max(whole.n or 0, 1), whole.total or 0.0
    rate = all_total / all_n

    def prior(level: DataFrame) -> float:
        """The size of a beta prior whose spread is that of sites within their parents (mean ``m``, rows ``of``) beyond what their sizes explain."""
        v = F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-9))
        found = level.agg(F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("m"), 2)).alias("between"), F.sum(v * (1 - F.col("n") / F.col("of"))).alias("noise"), F.sum(F.col("n") * (1 - F.col("n") / F.col("of"))).alias("room"), (F.sum(F.col("n") * v) / F.sum("n")).alias("within")).first()
        excess = (found.between - found.noise) / found.room if found.room else 0.0
        return float(min(max(found.within / excess - 1 if excess > 0 else 1e6, 5.0), 1e6))

    inside = paths.join(broadcast_if_small(hosts.select(F.col("host_").alias("h"), F.col("n").alias("of"), (F.col("total") / F.col("n")).alias("m")), BROADCAST_ROWS), F.col("host_").eqNullSafe(F.col("h")))
    for_host, for_path = prior(hosts.withColumns({"of": F.lit(all_n), "m": F.lit(rate)})), prior(inside)
    host_rates = hosts.select(F.col("host_").alias("h"), ((F.col("total") + for_host * rate) / (F.col("n") + for_host)).alias("host_rate"))
    joined = paths.join(broadcast_if_small(host_rates, BROADCAST_ROWS), F.col("host_").eqNullSafe(F.col("h")))
    return joined.select("host_", "path_", ((F.col("total") + for_path * F.col("host_rate")) / (F.col("n") + for_path)).alias("rate")), rate


def free_name(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", site_weight: float = 0.5, least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with evidence_, posterior_ (of good quality) and keep_, which replace columns of these names."""
    docs = docs.drop("evidence_", "posterior_", "keep_")
    model = fit(docs, labels)
    if model is None:
        return docs.select("*", F.lit(0.0).alias("evidence_"), F.lit(1.0).alias("posterior_"), F.lit(True).alias("keep_"))
    scored = score(docs, model)
    rates, rate = site_rates(score(docs.select("text", F.col(host).alias("of_host"), F.col(path).alias("of_path")), model), "of_host", "of_path")
    names = [free_name(scored.columns, c) for c in ("host_", "path_", "rate_")]
    rates = rates.toDF(*names)
    odds = lambda r: F.log(r / (1 - r))
    inside = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(names[2])))
    joined = scored.join(broadcast_if_small(rates, BROADCAST_ROWS), F.col(host).eqNullSafe(F.col(names[0])) & F.col(path).eqNullSafe(F.col(names[1])), "left")
    posterior = F.col("evidence_") + site_weight * (odds(inside) - odds(F.lit(min(max(rate, 1e-6), 1 - 1e-6))))
    return joined.withColumn("posterior_", 1 / (1 + F.exp(-posterior))).withColumn("keep_", F.col("posterior_") >= least).drop(*names)
