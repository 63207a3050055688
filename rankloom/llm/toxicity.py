"""Toxicity by weak supervision.

Voters: hand-written lexicons, lexicons induced from the labelled training rows
(words and beginnings of words that toxic rows hold far more often, grouped by
strength) and patterns. A generative label model with a hidden class has for
each voter the rates of voting in either class, estimated by expectation
maximisation; a training label is one more voter, trusted but not blindly. Voters that still agree within a class are
correlated: their log-likelihood ratios are divided by one plus the sum of
their positive conditional correlations, and the model is estimated again. A
linear (logistic) classifier is then trained on the posterior labels.

Fitting uses at most ``max_rows`` labelled rows, the first by hash of the id
(the bound makes them safe to broadcast, so no text is shuffled); all texts are
scored whole in one scan. Labels of the held-out fold, language, source and
doc_id are never inputs.

Null and empty texts have no votes and get the score of none. Labels that are
null or neither 0 nor 1 are not read. Without labelled rows of both classes the
hand-written lexicons decide alone. Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import voters as V
from .quality import fold

CUT = 0.3
MAX_ROWS = 50_000


@dataclass
class Model:
    voters: V.Voters
    weights: np.ndarray

    def scores(self, texts) -> np.ndarray:
        x = V.features(*self.voters.counts(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled training rows."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    known = known.where(fold(F.col("_id"), folds) != held).orderBy(F.xxhash64("_id"), "label").limit(max_rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "label")


#: Entries whose counts a task holds before it hands them on.
HELD = 100_000


def entry_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry, bad, fine): toxic and other rows (text, label) that hold an entry, added up over batches as far as ``HELD`` allows."""
    seen = (Counter(), Counter())

    def counted() -> pd.DataFrame:
        keys = list(seen[1].keys() | seen[0].keys())
        return pd.DataFrame({"entry": keys, "bad": [seen[1][k] for k in keys], "fine": [seen[0][k] for k in keys]})

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            seen[label].update({e for t in set(V.tokens_of(text)) for e in V.entries_of(t)})
            if len(seen[0]) + len(seen[1]) >= HELD:
                yield counted()
                for held in seen:
                    held.clear()
    if any(seen):
        yield counted()


def induced(rows: DataFrame, least: int = 3, size: int = 4000, z: float = 4.0) -> dict[str, float]:
    """Entries whose share of toxic rows exceeds their share of others by ``z`` standard errors, at most ``size``, with the ratio of the shares."""
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return {}
    per = rows.mapInPandas(entry_counts, "entry string, bad long, fine long").groupBy("entry").agg(
        F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).where(F.col("bad") >= least)
    p, q = (F.col("bad") + 0.5) / (n[1] + 1), (F.col("fine") + 0.5) / (n[0] + 1)
    both = (F.col("bad") + F.col("fine") + 1) / (n[0] + n[1] + 2)
    per = per.withColumn("z", (p - q) / F.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))).where((F.col("z") >= z) & (p > V.STRENGTHS[0] * q))
    per = per.withColumn("ratio", p / q).orderBy(F.col("z").desc(), "entry").limit(size)
    return {r["entry"]: r["ratio"] for r in per.collect()}


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, right: float = 0.97, wrong: float = 0.02) -> np.ndarray:
    """Posterior of the hidden class of each row, by EM over binary votes with correlations discounted.

    The label of a training row is a voter of fixed rates: ``right`` in toxic rows, ``wrong`` in others.
    """
    said = np.where(labels == 1, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
    posterior = np.where(labels == 1, right, wrong)
    discount = np.ones(votes.shape[1])
    for turn in range(2 * rounds):
        weight = np.array([1 - posterior, posterior])
        mass = weight.sum(axis=1)
        rate = np.clip((weight @ votes + np.array([[0.01], [0.1]])) / (mass[:, None] + 1), 1e-5, 1 - 1e-5)
        if turn == rounds:  # what is left of agreement within a class
            corr = np.zeros((votes.shape[1],) * 2)
            for c in (0, 1):
                d = (votes - rate[c]) * np.sqrt(weight[c])[:, None]
                sd = np.sqrt(np.maximum((d**2).sum(axis=0), 1e-9))
                corr = np.maximum(corr, (d.T @ d) / np.outer(sd, sd))
            np.fill_diagonal(corr, 0)
            discount = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=1))
        odds = said + np.log(mass[1] / mass[0]) + (
            votes * np.log(rate[1] / rate[0]) + (1 - votes) * np.log((1 - rate[1]) / (1 - rate[0]))) @ discount
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; the last column is the constant and is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_rows: int = MAX_ROWS) -> Model:
    rows = sample(docs, labels, folds, held, max_rows)
    voters = V.Voters(induced(rows))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits, sizes = voters.counts(batch["text"])
            yield pd.DataFrame({"hits": list(hits), "size": sizes, "label": batch["label"].to_numpy()})

    got = rows.mapInPandas(vote, "hits array<double>, size double, label int").toPandas()
    y = got["label"].to_numpy()
    if len(set(y)) < 2:
        w = np.zeros(len(voters.names) + 3)
        w[:len(V.LEXICONS)], w[-1] = 1.5, -2.0
        return Model(voters, w)
    hits = np.array(got["hits"].tolist())
    order = np.lexsort(np.column_stack([hits, got["size"], y]).T)  # rows come in any order; sums must not depend on it
    hits, sizes, y = hits[order], got["size"].to_numpy()[order], y[order]
    return Model(voters, logistic(V.features(hits, sizes), label_model((hits > 0).astype(float), y)))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents."""
    model = fit(docs, labels, folds, held)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts))

    rows = docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))
    return rows.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = CUT) -> DataFrame:
    """Documents that are not rejected, whole rows."""
    model = fit(docs, labels, folds, held)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts) < cut)

    return docs.where(clean(F.col("text").cast("string")))
