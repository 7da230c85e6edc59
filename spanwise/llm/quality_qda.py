"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over a fixed number of transformed statistics. Its covariance is shrunk
towards its diagonal and the pooled covariance, factored once (Cholesky) and cached in the model; a
text's score is the logistic of the log-density difference of the two classes.

Defined results: a null text is scored as the empty text; labels that are null or contradict each
other for one doc_id teach nothing; repeated rows are each scored; rows without a doc_id are scored
and teach nothing; with one class or none in the labels every score is the share of class 1 (0.5
without labels); empty input gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import held_out, let_go, text_bytes
from spanwise.llm.textstats import count

FEATURES = ("word_length", "upper", "symbols", "marks", "same_next", "distinct", "repeats", "dup_lines", "digits")
#: Words (lines for the share of lines) of ordinary text that every share is mixed with, so that a text
#: of a few words, whose shares say little, stays near ordinary.
PRIOR_WORDS, PRIOR_LINES = 30, 10
CUT = 0.3


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, inverse of the covariance's Cholesky factor, log determinant."""

    prior: float
    classes: tuple[tuple[float, np.ndarray, np.ndarray, float], ...]


def transform(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES per text: logs of smoothed shares, so that junk of any strength stays within a few units."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars = c["n_words"] + PRIOR_WORDS, c["word_chars"] + 5 * PRIOR_WORDS
    letters = c["n_upper"] + c["n_lower"] + 5 * PRIOR_WORDS
    return np.column_stack([
        np.log(chars / words),
        np.log(c["n_upper"] / letters + 0.02),
        np.log(c["n_symbols"] / chars + 0.01),
        np.log(c["n_marks"] / chars + 0.02),
        np.log(c["n_same_next"] / words + 0.02),
        np.log((c["n_distinct"] + PRIOR_WORDS) / words),
        np.log(c["n_repeat_words"] / words + 0.02),
        np.log(c["n_dup_lines"] / (c["n_lines"] + PRIOR_LINES) + 0.05),
        np.log(c["n_digits"] / chars + 0.02),
    ])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES as an array, of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            rows = transform(count(*text_bytes(batch.column("text"))))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


def usable_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label 0 or 1 of the rows that may teach: not held out, not null, not contradictory."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other"))
        .where("label = other").select("doc_id", F.col("label").cast("int").alias("label"))
    )


def fit(vectors: DataFrame, labels: DataFrame, column: str = "quality", shrink: float = 0.1, pooled: float = 0.1, ridge: float = 1e-3) -> Model:
    """Learn from every labelled row outside the held-out fold.

    Moments are summed in one aggregation: the driver receives one row of d + d * d numbers per class.
    ``pooled`` draws each covariance to the pooled one, ``shrink`` then to its own diagonal.
    """
    d = len(FEATURES)
    seen = vectors.join(usable_labels(labels, column), "doc_id")
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = seen.groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("ss")
    ).collect()
    moments = {r["label"]: r for r in sums if r["label"] in (0, 1) and r["n"] > 0}
    n1, n0 = (moments[k]["n"] if k in moments else 0 for k in (1, 0))
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    if not n0 or not n1:
        return Model(prior, ())
    means, scatters = [], []
    for k in (0, 1):
        n, mean = moments[k]["n"], np.array(moments[k]["s"]) / moments[k]["n"]
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, moments[k]["ss"], strict=True):
            second[i, j] = second[j, i] = v / n
        means.append(mean)
        scatters.append(second - np.outer(mean, mean))
    both = (n0 * scatters[0] + n1 * scatters[1]) / (n0 + n1)
    classes = []
    for n, mean, own in zip((n0, n1), means, scatters, strict=True):
        cov = (1 - pooled) * own + pooled * both
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(d)
        factor = np.linalg.cholesky(cov)
        classes.append((float(np.log(n / (n0 + n1))), mean, np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Model(prior, tuple(classes))


def log_odds(model: Model, rows: np.ndarray) -> np.ndarray:
    if not model.classes:
        return np.full(len(rows), np.log(model.prior / (1 - model.prior)))
    density = [
        log_prior - 0.5 * (((rows - mean) @ factor.T) ** 2).sum(axis=1) - 0.5 * log_det for log_prior, mean, factor, log_det in model.classes
    ]
    return density[1] - density[0]


def probability(model: Model, rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds(model, rows), -500, 500)))


def score(vectors: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted for rows of ``features``."""

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(probability(model, x.flatten().to_numpy().reshape(len(x), len(FEATURES))))

    out = vectors.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose whole text scores at least ``cut``, all columns unchanged."""

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(probability(model, transform(count(*text_bytes(text)))))

    return docs.where(scored(F.col("text")) >= cut)
