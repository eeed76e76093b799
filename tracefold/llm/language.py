"""Language identification by error-correcting output codes over hashed n-grams.

Every language has a codeword; one binary classifier per bit predicts it from the
character n-grams of a text. Decoding takes the codeword with the smallest loss, each bit
weighted by how well it was learned for that language; a small gap to the second one flags
the text as ambiguous.

A text that is null or holds no letter is ``und`` with score 0. Repeated rows get equal
results; existing columns of the output names are replaced; an empty table gives an empty
one. Without any learned language everything is ``und``; with one, it is that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common as C

DIM = 4096
#: Labelled rows per language, about, that the bit classifiers are fitted on.
SAMPLE_PER_LANGUAGE = 1000
AMBIGUOUS_BELOW = 0.2


def gram_features(text: str) -> np.ndarray:
    """Hashed counts of 1- to 3-grams of the lower-cased letters, words parted by blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    small = points < 128
    other = small & ~((points >= 97) & (points <= 122))
    other |= points == 0x2026
    codes = np.where(other, 32, points)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep].astype(np.uint64)
    counts = sum((C.gram_counts(codes, n, DIM) for n in (1, 2, 3)), np.zeros(DIM, np.float32))
    return np.minimum(counts, 60_000)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k codewords of +-1 bits: every two-way split for few languages, else random ones."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 6:
        columns = [[1 if (split >> i) & 1 else -1 for i in range(k)]
                   for split in range(1, 1 << (k - 1))]
        return np.array(columns, float).T
    rng = np.random.default_rng(seed)
    bits = 12 * int(np.ceil(np.log2(k)))
    best, gap = None, -1
    for _ in range(40):  # the set with the largest least distance
        words = rng.choice([-1.0, 1.0], size=(k, bits))
        words[0, np.abs(words.sum(0)) == k] *= -1
        agree = words @ words.T - 2 * bits * np.eye(k)
        if (found := (bits - agree.max()) / 2) > gap:
            best, gap = words, found
    return best


@dataclass(frozen=True)
class CodeModel:
    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        agree = margin[:, None, :] * self.words[None]
        return (np.logaddexp(0, -agree) * self.trust[None]).sum(2)


def fit_codes(x: np.ndarray, names: np.ndarray, rounds: int = 150) -> CodeModel | None:
    """Logistic bit classifiers by Nesterov descent, languages weighted alike."""
    languages = sorted(set(names))
    if not languages:
        return None
    words = codewords(len(languages))
    if not words.shape[1]:
        return CodeModel(languages, words, np.zeros((x.shape[1], 0), np.float32),
                         np.zeros(0), np.ones((1, 0)))
    label = np.searchsorted(languages, names)
    target = words[label]
    share = 1 / np.bincount(label)[label] / len(languages)
    share = share[:, None].astype(np.float32)
    w = np.zeros((x.shape[1], words.shape[1]), np.float32)
    b, ahead_w, ahead_b, rate = np.zeros(words.shape[1]), w.copy(), np.zeros(words.shape[1]), 40.0
    for step in range(1, rounds + 1):
        margin = (x @ ahead_w + ahead_b) * target
        pull = (-target / (1 + np.exp(np.clip(margin, -40, 40))) * share).astype(np.float32)
        new_w = ahead_w - rate * (x.T @ pull + 1e-5 * ahead_w)
        new_b = ahead_b - 0.5 * pull.sum(0)
        push = (step - 1) / (step + 2)
        ahead_w, ahead_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b = new_w, new_b
    right = ((x @ w + b) * target > 0).astype(float)
    trust = np.stack([right[label == i].mean(0) for i in range(len(languages))]) + 1e-6
    return CodeModel(languages, words, w, b, trust / trust.sum(1, keepdims=True))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> CodeModel | None:
    """Fit on about ``per_language`` texts of each language in ``docs`` (doc_id, text, lang)."""
    known = docs.select("doc_id", "text", "lang").dropna()
    sizes = known.groupBy("lang").count()
    share = F.lit(float(per_language)) / F.col("count")
    chosen = known.join(F.broadcast(sizes), "lang").where(
        C.unit_hash(F.col("doc_id"), seed=5) < share).select("doc_id", "text", "lang")
    counts, (names,) = C.collected(chosen, gram_features, ["lang"])
    return fit_codes(C.unit_rows(counts), names) if len(names) else None


def identify(docs: DataFrame, model: CodeModel | None,
             ambiguous_below: float = AMBIGUOUS_BELOW) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous."""
    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, scores, doubt = [], [], []
            for at in C.chunks(len(part), 256):
                texts = [t or "" for t in part.iloc[at]]
                lettered = [model is not None and any(map(str.isalpha, t)) for t in texts]
                if model is None:
                    names += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    doubt += [True] * len(texts)
                    continue
                x = C.unit_rows(np.stack([gram_features(t) for t in texts]))
                loss = model.losses(x)
                chance = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
                chance /= chance.sum(1, keepdims=True)
                best = loss.argmin(1)
                ranked = np.sort(chance, axis=1)
                gap = ranked[:, -1] - (ranked[:, -2] if ranked.shape[1] > 1 else 0)
                for i, ok in enumerate(lettered):
                    names.append(model.languages[best[i]] if ok else "und")
                    scores.append(float(ranked[i, -1]) if ok else 0.0)
                    doubt.append(bool(not ok or gap[i] < ambiguous_below))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": doubt})

    made = docs.drop("lang_pred", "score", "ambiguous").withColumn("_lang", decoded("text"))
    return made.withColumns({c: F.col(f"_lang.{c}") for c in (
        "lang_pred", "score", "ambiguous")}).drop("_lang")


@C.query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs.where(~C.held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
        "ambiguous")
