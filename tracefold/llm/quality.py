"""Quality classifier: ordinal cumulative-link regression over hashed text features.

One weight vector scores a text; ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold_k - w.x). The expected grade is the sum of the tail
probabilities P(grade > k); selection keeps a text by P(grade >= ``keep_grade``).

A null, empty or blank text has nothing to train on: it gets a grade like any other and is
never kept. Repeated rows get equal scores; an existing column named
like an output is replaced; every other column passes through. An empty table gives an
empty one; with no labelled rows every non-empty text is kept at the top grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common as C

DIM = 2048
#: Labelled rows, about, that the model is fitted on.
SAMPLE = 6000
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5


def _classes() -> np.ndarray:
    """Code point -> shape: letters and digits fold, punctuation stays apart."""
    out = np.empty(0x250, np.uint8)
    for cp in range(len(out)):
        ch = chr(cp)
        out[cp] = (1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit()
                   else 4 if ch in " \t" else 5 if ch == "\n" else
                   6 if ch.isalpha() else 7 if cp < 32 else 8 + cp % 120)
    return out


_SHAPE = _classes()


def shape_counts(text: str) -> np.ndarray:
    """Hashed counts of shape n-grams, word runs, repeats and length of one text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shapes = _SHAPE[np.minimum(points, len(_SHAPE) - 1)]
    # runs of one shape count as two, so word length does not dilute the pattern
    keep = np.ones(len(shapes), bool)
    keep[2:] = (shapes[2:] != shapes[1:-1]) | (shapes[2:] != shapes[:-2])
    short = shapes[keep].astype(np.uint64)
    counts = sum((C.gram_counts(short, n, DIM) for n in (1, 2, 3, 5)), np.zeros(DIM, np.float32))
    total = max(1, len(short))
    words = text.split()
    same = sum(map(str.__eq__, words[1:], words[:-1]))
    marks = np.array([
        900_000 + min(20, int(20 * same / max(1, len(words)))),
        900_100 + int(20 * len(set(words)) / max(1, len(words))),
        900_200 + min(12, int(np.log2(len(words) + 1))),
    ], np.uint64)
    scale = np.float32(400.0 / total)  # relative counts: a long text is not another kind
    return counts * scale + 60 * C.gram_counts(marks, 1, DIM)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k, one row a text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - (x @ self.weights)[:, None],
                                       -40, 40)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, rounds: int = 400,
                ridge: float = 1e-4) -> OrdinalModel | None:
    """Maximum likelihood by Adam; thresholds stay ordered by construction."""
    if not len(x) or grade.max() < 1:
        return None
    top = int(grade.max())
    n, dim = x.shape
    below = [np.clip((grade <= k).mean(), 1e-3, 1 - 1e-3) for k in range(top)]
    first = np.log(below[0] / (1 - below[0]))
    logits = np.log(np.array(below) / (1 - np.array(below)))
    gaps = np.log(np.maximum(np.diff(logits), 1e-2))
    theta = np.concatenate([np.zeros(dim), [first], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, rounds + 1):
        w, cuts = theta[:dim], theta[dim] + np.concatenate([[0], np.cumsum(np.exp(theta[dim + 1:]))])
        score = x @ w.astype(np.float32)
        upper = np.where(grade < top, sigmoid(cuts[np.minimum(grade, top - 1)] - score), 1.0)
        lower = np.where(grade > 0, sigmoid(cuts[np.maximum(grade - 1, 0)] - score), 0.0)
        # d log(upper - lower) / d cut, written so that it never divides by a tiny gap
        gap = np.maximum(upper - lower, 1e-9)
        du = np.where(grade < top, upper * (1 - upper), 0.0) / gap
        dl = np.where(grade > 0, lower * (1 - lower), 0.0) / gap
        on_cut = np.zeros(top)
        np.add.at(on_cut, np.minimum(grade, top - 1), np.where(grade < top, du, 0))
        np.add.at(on_cut, np.maximum(grade - 1, 0), np.where(grade > 0, -dl, 0))
        grad = np.empty_like(theta)
        grad[:dim] = x.T @ (-(du - dl)).astype(np.float32) / n - ridge * w
        grad[dim] = on_cut.sum() / n
        tail = on_cut[::-1].cumsum()[::-1] / n
        grad[dim + 1:] = tail[1:] * np.exp(theta[dim + 1:])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    cuts = theta[dim] + np.concatenate([[0], np.cumsum(np.exp(theta[dim + 1:]))])
    return OrdinalModel(theta[:dim], cuts)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    """Fit on about ``sample`` rated documents; ``ratings`` has doc_id and grade (from 0)."""
    chosen = C.training_sample(docs, ratings.select("doc_id", F.col("grade").cast("int")), sample)
    counts, (grade,) = C.collected(chosen, shape_counts, ["grade"])
    if not len(grade):
        return None
    return fit_ordinal(C.unit_rows(counts), np.maximum(grade, 0).astype(int))


def classify(docs: DataFrame, model: OrdinalModel | None, keep_grade: int = KEEP_GRADE,
             keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (grade >= keep_grade) and keep."""
    @F.pandas_udf("expected_grade double, tail_probability double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = np.empty((len(part), 2))
            for at in C.chunks(len(part), 256):
                x = C.unit_rows(np.stack([shape_counts(t or "") for t in part.iloc[at]]))
                if model is None:
                    out[at] = 1.0
                    continue
                tails = model.tails(x)
                k = min(max(keep_grade, 1), tails.shape[1]) - 1
                out[at] = np.column_stack([tails.sum(1), tails[:, k]])
            yield pd.DataFrame(out, columns=["expected_grade", "tail_probability"])

    made = docs.drop("expected_grade", "tail_probability", "keep").withColumn(
        "_quality", scored("text"))
    return made.withColumns({
        "expected_grade": F.col("_quality.expected_grade"),
        "tail_probability": F.col("_quality.tail_probability"),
        "keep": (F.col("_quality.tail_probability") >= keep_probability)
        & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)),
    }).drop("_quality")


def label_grades(labels: DataFrame) -> DataFrame:
    """Ratings from the label table: 0 poor text, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(
        F.col("toxic") == 1, 1).otherwise(2).alias("grade"), "quality").dropna().drop("quality")


@C.query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    ratings = label_grades(C.table(spark, sf_dir, "labels")).where(
        ~C.held_out(F.col("doc_id")))
    return classify(docs, train(docs, ratings)).select(
        "doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "expected_grade",
        "tail_probability", "keep")
