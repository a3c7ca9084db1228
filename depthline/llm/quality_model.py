"""Quality classifier: regularised quadratic discriminant over document statistics.

Whole texts give ``STATISTICS`` (transformed to be roughly normal).  Class means and
covariances are sums over all labelled training rows, added up in Spark; covariances are
shrunk towards the pooled one and the identity, and their Cholesky factors are computed
once and sent along with the scoring tasks.  A score is the logistic function of the
difference of the two log densities (Mahalanobis distance and log determinant).

Defined results: a null text counts as empty and is scored like any other; rows without
a label or with other labels than 0 and 1 are not trained on; without training rows of
both classes every score is 0.5; repeated rows each get their score.  Only ``doc_id``
and ``text`` (and of the labels ``doc_id`` and ``quality``) are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, mix, stored, text_of, word_hashes

STATISTICS = ("words", "word_length", "upper", "digits", "marks", "shouts", "bars", "stops", "commas", "lines", "distinct", "stutter", "repeat3", "high")

# Byte classes counted per text.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b"#*$%&<>", "shouts": b"!", "bars": b"|", "stops": b".", "commas": b",", "lines": b"\n"}


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of different keys per document."""
    own = np.sort(mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1))))
    order = np.argsort(mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1))), kind="stable")
    fresh = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    return np.bincount(doc[order[fresh]], minlength=n)


def statistics(texts: list[str]) -> np.ndarray:
    """``[text, statistic]`` of whole texts."""
    n = len(texts)
    h, bounds = word_hashes(texts)
    words = np.diff(bounds).astype(np.float64)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.float64)
    data = np.frombuffer(b"".join(r + b" " for r in raw), np.uint8)
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    per = lambda x: x / np.maximum(words, 1)
    cols = {"words": np.log1p(words), "word_length": np.log1p(size / np.maximum(words, 1))}
    for name, letters in _CLASSES.items():
        table = np.zeros(256, np.int32)
        table[list(letters)] = 1
        cols[name] = np.log(per(np.add.reduceat(table[data], starts).astype(np.float64)) + 0.01) if n else np.zeros(0)
    high = (data >= 128).astype(np.int32)
    cols["high"] = np.log(per(np.add.reduceat(high, starts).astype(np.float64)) + 0.01) if n else np.zeros(0)
    different = _distinct(h, doc, n)
    cols["distinct"] = np.log(different + 1) / np.log(words + 2)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    cols["stutter"] = np.log(per(np.bincount(doc[1:][same], minlength=n).astype(np.float64)) + 0.01) if len(h) else np.full(n, np.log(0.01))
    inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    trigrams = mix(h[inside] * np.uint64(3) + mix(h[inside + 1] * np.uint64(5) + mix(h[inside + 2]))) if len(inside) else np.zeros(0, np.uint64)
    total = np.bincount(doc[inside], minlength=n)
    cols["repeat3"] = np.log(1 - _distinct(trigrams, doc[inside], n) / np.maximum(total, 1) * (total > 0) - (total == 0) + 0.01)
    return np.stack([cols[c] for c in STATISTICS], axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` with the statistics of every text."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "x": list(statistics(part["t"].tolist()))})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t")).mapInPandas(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors and log priors of the two classes (None: no training rows of both)."""

    means: list[np.ndarray] | None
    factors: list[np.ndarray] | None
    offsets: list[float] | None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.zeros(len(x))
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(offset - 0.5 * (z**2).sum(0) - np.log(np.diag(factor)).sum())
        return logs[1] - logs[0]


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], towards_pooled: float = 0.1, towards_identity: float = 0.02) -> Discriminant:
    """From each class's number of rows, sum and sum of outer products."""
    if any(sums.get(k, (0,))[0] < 2 for k in (0, 1)):
        return Discriminant(None, None, None)
    n = np.array([sums[k][0] for k in (0, 1)], np.float64)
    means = [sums[k][1] / sums[k][0] for k in (0, 1)]
    own = [sums[k][2] / sums[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    scale = np.diag(pooled).copy() + 1e-6
    factors = []
    for k in (0, 1):
        # Few rows lean more on what both classes share.
        a = towards_pooled + (1 - towards_pooled) * len(scale) / (len(scale) + n[k])
        cov = (1 - a) * own[k] + a * pooled
        factors.append(np.linalg.cholesky((1 - towards_identity) * cov + towards_identity * np.diag(scale)))
    return Discriminant(means, factors, [float(np.log(v / n.sum())) for v in n])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all labelled rows that are not held out."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y")).where("y IN (0, 1)").where(~held_out(F.col("doc_id"))).join(stats, "doc_id")

    def add(batches):
        total = {}
        for batch in batches:
            for y, part in batch.groupby("y"):
                x = np.stack(part["x"].to_numpy())
                got = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
                total[y] = total.get(y, 0) + got
        for y, v in total.items():
            yield pd.DataFrame({"y": y, "i": np.arange(len(v)), "v": v})

    summed = rows.select("y", "x").mapInPandas(add, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).toPandas()
    d, sums = len(STATISTICS), {}
    for y, part in summed.groupby("y"):
        v = part.sort_values("i")["v"].to_numpy()
        sums[int(y)] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return fit(sums)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    with Scratch(docs.sparkSession) as scratch:
        stats = stored(document_statistics(docs), "document-statistics")
        model = train(stats, labels)

        def run(batches):
            for batch in batches:
                if len(batch):
                    odds = np.clip(model.log_odds(np.stack(batch["x"].to_numpy())), -500, 500)
                    yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(), "score": 1 / (1 + np.exp(-odds))})

        scored = stats.mapInPandas(run, "doc_id long, score double")
        return scratch.result(scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")), "quality-scores")
