"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk toward the pooled one and
toward a multiple of the identity. The Cholesky factor of each covariance is
made once and sent with the job; a score is the difference of the two
log-densities, each a squared Mahalanobis distance by one triangular solve.
The difference (with the prior) is squashed by z / (1 + |z|), which keeps the
order of far scores where a logistic curve would round them to 0 or 1.

The classes' moments are sums over all labelled rows of the training folds,
added up by Spark; the driver sees one matrix per class. Labels, language,
source and doc_id are never inputs.

Null and empty texts have statistics like any text and get a score. Rows
without a label, with a null id or of the held-out fold do not train. If a
class has fewer than two training rows, every score is the smoothed share of
label 1. Repeated rows each get a score; a repeated label counts as often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from . import textstats

CUT = 0.3


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


@dataclass
class Discriminant:
    means: np.ndarray
    factors: np.ndarray  # lower Cholesky factors
    offset: float  # log prior ratio and half the log-determinants
    flat: float | None = None  # the one score where there is nothing to fit

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        far = [(np.linalg.solve(l, (x - m).T) ** 2).sum(axis=0) for m, l in zip(self.means, self.factors)]
        z = (0.5 * (far[0] - far[1]) + self.offset) / x.shape[1]
        return 0.5 * (1 + z / (1 + np.abs(z)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label the number of rows, sum and sum of outer products of ``stats``; one matrix per class reaches the driver."""
    d = len(textstats.NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
        for batch in batches:
            x, y = np.array(batch["stats"].tolist()).reshape(-1, d), batch["label"].to_numpy()
            for c in total:
                part = x[y == c]
                total[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        for c, t in total.items():
            yield pd.DataFrame({"label": c, "at": np.arange(len(t)), "value": t})

    sums = rows.mapInPandas(run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for c in (0, 1):
        v = sums[sums["label"] == c].sort_values("at")["value"].to_numpy()
        v = v if len(v) else np.zeros(1 + d + d * d)
        out[c] = (v[0], v[1:1 + d], v[1 + d:].reshape(d, d))
    return out


def fit(rows: DataFrame, to_pooled: float = 0.2, to_identity: float = 0.05) -> Discriminant:
    """From labelled training rows (stats, label)."""
    found = moments(rows)
    n = {c: m[0] for c, m in found.items()}
    if min(n.values()) < 2:
        return Discriminant(np.empty(0), np.empty(0), 0.0, (n[1] + 1.0) / (n[0] + n[1] + 2.0))
    means = {c: s / k for c, (k, s, _) in found.items()}
    own = {c: (o - k * np.outer(means[c], means[c])) / (k - 1) for c, (k, _, o) in found.items()}
    pooled = sum((n[c] - 1) * own[c] for c in own) / (n[0] + n[1] - 2)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))  # shrink on the scale of each statistic
    factors = []
    for c in (0, 1):
        s = ((1 - to_pooled) * own[c] + to_pooled * pooled) / np.outer(scale, scale)
        s = (1 - to_identity) * s + to_identity * (np.trace(s) / len(s) + 1e-9) * np.eye(len(s))
        factors.append(np.linalg.cholesky(s * np.outer(scale, scale)))
    logdet = [np.log(np.diag(f)).sum() for f in factors]
    return Discriminant(np.array([means[0], means[1]]), np.array(factors), float(np.log(n[1] / n[0]) + logdet[0] - logdet[1]))


def with_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row."""
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(textstats.statistics_of(texts)))

    return docs.select("doc_id", stats(F.col("text").cast("string")).alias("stats"))


def training(stats: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    rows = stats.where(fold(F.col("doc_id"), folds) != held)
    return rows.join(known, F.col("doc_id") == F.col("_id")).select("stats", "label")


def score_stats(stats: DataFrame, model: Discriminant) -> DataFrame:
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(x.tolist()).reshape(-1, len(textstats.NAMES))))

    return stats.select("doc_id", score("stats").alias("score"))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents."""
    stats = staged(with_stats(docs), "quality-stats")
    model = fit(training(stats, labels, "quality", folds, held))
    rows = score_stats(stats, model)
    return rows.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = CUT) -> DataFrame:
    """Documents that are not rejected, whole rows. Statistics are made again in the scoring pass, so texts are never shuffled."""
    model = fit(training(with_stats(docs), labels, "quality", folds, held))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(textstats.statistics_of(texts)) >= cut)

    return docs.where(good(F.col("text").cast("string")))
