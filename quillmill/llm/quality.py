"""Quality by compression: dictionaries of good and of bad text, and a calibrated score of the difference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm._compress import Sizer, chosen, dictionary, spread
from quillmill.llm._util import apart, without

#: Added to a text's bytes when the difference is normalised, so that a few bytes of a very short text decide little.
DAMPING = 32


@dataclass(frozen=True)
class QualityModel:
    """contents: dictionaries of label 0 and 1. score = 1 / (1 + exp(-(slope * difference + offset)))."""

    contents: tuple[bytes, bytes]
    slope: float
    offset: float


def difference(text: str, sizer: Sizer) -> float:
    """(size under the bad dictionary - size under the good one) / bytes: higher for better text."""
    n, (bad, good) = sizer.sizes(text)
    return (bad - good) / (n + DAMPING)


def train(docs: DataFrame, labels: DataFrame, texts_per_label: int = 450, calibration_per_label: int = 600, dictionary_bytes: int = 220_000, text_chars: int = 1 << 14) -> QualityModel:
    """Fits the model on ``labels`` (doc_id, quality 0 or 1) and the texts of those documents.

    The sample is bounded: of each label about ``texts_per_label`` documents make the dictionary and about
    ``calibration_per_label`` others the calibration, picked by a hash of doc_id, with at most ``text_chars`` characters
    of each. Labels other than 0 and 1, and documents with both, teach nothing. If a label has no text, every score is
    the share of label 1 (one half without any label).
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    known = known.where(F.col("quality") == F.col("_most")).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.5
    flat = QualityModel((b"", b""), 0.0, float(np.log(max(base, 1e-3) / max(1 - base, 1e-3))))
    if len(counts) < 2:
        return flat
    there = F.create_map(*[F.lit(x) for pair in sorted(counts.items()) for x in pair])
    sample = known.where(chosen(F.col("_id"), texts_per_label + calibration_per_label, there[F.col("quality")]))
    found = docs.select(F.col("doc_id"), F.col("text")).where(F.col("text").isNotNull()).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = found.select("doc_id", "quality", spread(F.col("text"), text_chars).alias("text"), F.xxhash64("doc_id").alias("order")).collect()
    rows = sorted({(r["order"], r["doc_id"], r["quality"], r["text"]) for r in rows})
    share = texts_per_label / (texts_per_label + calibration_per_label)
    parts = {q: [r[3] for r in rows if r[2] == q] for q in (0, 1)}
    if not parts[0] or not parts[1]:
        return flat
    first = {q: max(1, round(len(t) * share)) for q, t in parts.items()}
    contents = tuple(dictionary(parts[q][: first[q]], dictionary_bytes) for q in (0, 1))
    sizer = Sizer(list(contents))
    x, y = [], []
    for q in (0, 1):
        for text in parts[q][first[q] :] or parts[q]:
            x.append(difference(text, sizer))
            y.append(q)
    x, y = np.array(x), np.array(y)
    # beyond the labels' own medians a difference is clear; a few odd texts out there mustn't flatten the slope
    x = np.clip(x, *sorted((np.median(x[y == 0]), np.median(x[y == 1]))))
    weights = np.where(y == 1, base / max(1, (y == 1).sum()), (1 - base) / max(1, (y == 0).sum()))  # as the labels are mixed
    slope, offset = _logistic(x, y, weights)
    return QualityModel(contents, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature by Newton steps, with a little pull towards 0."""
    scale = float(np.abs(x).mean()) or 1.0
    features = np.stack([x / scale, np.ones_like(x)], axis=1)
    weights = weights / weights.sum() * len(x)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        gradient = features.T @ (weights * (y - p)) - 1e-3 * beta
        hessian = (features * (weights * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def score_texts(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1, higher for better text) and predicted (1 if score >= threshold) to all of ``docs``.

    Only the whole text counts; null text is scored as empty, whose difference is 0. Columns of ``docs`` named score or
    predicted are replaced; all others stay as they are. Repeated rows are scored each; an empty table gives no rows.
    """
    rows, of, back = apart(docs)
    scored = rows.withColumn("score", _scores(docs, of("text"), model))
    return scored.select(*without(back, docs, ["score", "predicted"]), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that ``score_texts`` gives ``threshold`` or more, with all their columns as they are."""
    rows, of, back = apart(docs)
    return rows.where(_scores(docs, of("text"), model) >= threshold).select(*back)


def _scores(docs: DataFrame, text: Column, model: QualityModel) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        sizer = Sizer(list(fitted.contents))
        for texts in batches:
            x = np.array([difference(t or "", sizer) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(fitted.slope * x + fitted.offset, -30, 30))))

    return score(F.coalesce(text, F.lit("")))

