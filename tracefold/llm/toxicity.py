"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts are folded (case, compatibility forms, accents, look-alike letters, digits and signs
that stand for letters inside a word; everything else becomes a blank). Lexicon entries are
whole words or word beginnings with a weight learned from labelled texts; entries that
only ever follow a few different words (copies of one passage) are not learned. A hit inside
an exception phrase does not count. The summed weight, also normalised by length, goes
through a logistic curve fitted on labelled texts that the lexicon was not learned from.

A null or empty text has no hit and gets the score of a clean text. Repeated rows get equal
scores; existing columns of the output names are replaced; an empty table gives an empty
one. Without labels the built-in entries score alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common as C

#: Labelled rows, about, that lexicon and curve are fitted on.
SAMPLE = 12_000
LEXICON_SIZE = 2000
MIN_CONTEXTS, MIN_WEIGHT, MIN_Z = 6, 1.5, 5.0
THRESHOLD = 0.3

# Entries used when there are no labels to learn from, and their exceptions.
BASE_LEXICON = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless",
                "disgusting", "clown"]
EXCEPTIONS = ["clown fish", "trash can", "trash bin", "trash bag", "moron test"]
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
    "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ε": "e", "ο": "o",
    "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "χ": "x", "ı": "i", "ɡ": "g",
    "ø": "o", "ł": "l", "đ": "d",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_STANDS_FOR = re.compile(r"[0134579@$](?=[0-9@$]*[^\W\d_])")


class _Fold(dict):
    """Code point -> folded letters, a blank for anything else; filled on first use."""

    def __missing__(self, point: int) -> str:
        letters = unicodedata.normalize("NFKD", chr(point).lower())
        out = "".join(HOMOGLYPHS.get(c, c) for c in letters if not unicodedata.combining(c))
        if unicodedata.category(chr(point)) in ("Cf", "Mn"):
            made = ""
        else:
            made = out if out.isalpha() else " "
        self[point] = made
        return made


_FOLD = _Fold()


def fold(text: str) -> str:
    """The folded text, one blank at either end and between words."""
    if any(c in text for c in SUBSTITUTES):
        text = _STANDS_FOR.sub(lambda m: SUBSTITUTES.get(m[0], m[0]), text)
    return f" {' '.join(text.translate(_FOLD).split())} "


def _entries(word: str) -> list[str]:
    """Lexicon entries a word could stand under: itself and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(4, min(9, len(word))))]


def entry_counts(sample: DataFrame) -> DataFrame:
    """entry, toxic and clean counts of texts and words, distinct words before it.

    The words before an entry are told apart by 64 hash bits, which merge in any order.
    """
    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for part in parts:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                words = fold(text).split()
                seen: dict[str, tuple[int, int]] = {}
                before = ""
                for word in words:
                    bit = 1 << (zlib.crc32(before.encode()) & 63)
                    n, bits = seen.get(word, (0, 0))
                    seen[word] = (n + 1, bits | bit)
                    before = word
                in_text: dict[str, list[int]] = {}
                for word, (n, bits) in seen.items():
                    for entry in _entries(word):
                        got = in_text.setdefault(entry, [0, 0])
                        got[0] += n
                        got[1] |= bits
                side = 0 if toxic else 2
                for entry, (n, bits) in in_text.items():
                    got = found.setdefault(entry, [0, 0, 0, 0, 0])
                    got[side] += 1
                    got[side + 1] += n
                    if toxic:
                        got[4] |= bits
            if found:
                out = pd.DataFrame(list(found.values()), dtype="uint64", columns=[
                    "toxic_texts", "toxic_words", "clean_texts", "clean_words", "before"])
                out["before"] = out["before"].astype("int64")
                out.insert(0, "entry", list(found))
                yield out

    partial = sample.select("text", "toxic").mapInPandas(
        counted, "entry string, toxic_texts long, toxic_words long, clean_texts long, "
                 "clean_words long, before long")
    return partial.groupBy("entry").agg(
        *(F.sum(c).alias(c) for c in ("toxic_texts", "toxic_words", "clean_texts",
                                      "clean_words")),
        F.bit_count(F.bit_or("before")).alias("contexts"))


def learned_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """The ``size`` entries at most that set toxic texts apart most surely, with weights."""
    totals = sample.groupBy("toxic").count().collect()
    n = {bool(r["toxic"]): r["count"] for r in totals}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic or not clean:
        return {}
    p, q = (F.col("toxic_texts") + 0.5) / (toxic + 1), (F.col("clean_texts") + 0.5) / (clean + 1)
    odds = F.log(p / (1 - p)) - F.log(q / (1 - q))
    # two-proportion z of the share of toxic and of clean texts that hold the entry
    share = (F.col("toxic_texts") + F.col("clean_texts")) / (toxic + clean)
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / toxic + 1 / clean))
    apart = F.col("toxic_texts") / toxic - F.col("clean_texts") / clean
    chosen = entry_counts(sample).where(F.col("contexts") >= MIN_CONTEXTS).select(
        "entry", F.round(odds, 6).alias("weight"), (apart / spread).alias("z")).where(
        (F.col("weight") >= MIN_WEIGHT) & (F.col("z") >= MIN_Z)).orderBy(
        F.desc(F.round("z", 6)), "entry").limit(size)
    return {r["entry"]: float(r["weight"]) for r in chosen.collect()}


@dataclass(frozen=True)
class ToxicModel:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    curve: np.ndarray


def matcher(lexicon: dict[str, float], exceptions: tuple[str, ...]):
    """Aho-Corasick automaton over entries (with weight) and exception phrases (None)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        automaton.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        folded = fold(phrase)
        automaton.add_word(folded, (len(folded), None))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def match_features(text: str, automaton) -> tuple[float, float, float]:
    """log(1 + weight), weight by root of length, strongest hit of one text."""
    folded = fold(text)
    at_start: dict[int, float] = {}
    void: list[tuple[int, int]] = []
    if len(automaton):
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                void.append((start, end))
            elif weight > at_start.get(start, 0.0):
                at_start[start] = weight
    for a, b in void:
        for start in [s for s in at_start if a <= s < b]:
            del at_start[start]
    total = sum(at_start.values())
    words = folded.count(" ") - 1
    return (float(np.log1p(total)), total / max(1.0, words) ** 0.5,
            max(at_start.values(), default=0.0))


def features(texts: pd.Series, automaton) -> np.ndarray:
    return np.array([match_features(t or "", automaton) for t in texts]).reshape(-1, 3)


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly ridged; (intercept, weights...)."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        pull = design.T @ (toxic - p) - 0.1 * beta
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(bend, pull)
    return beta


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
          exceptions: tuple[str, ...] = tuple(EXCEPTIONS)) -> ToxicModel:
    """Fit on about ``sample`` labelled texts; ``labels`` has doc_id and toxic (0/1)."""
    from tracefold.sources.sinks import stored

    base = ToxicModel({f" {w} ": 3.0 for w in BASE_LEXICON}, exceptions,
                      np.array([-3.0, 1.0, 1.0, 1.0]))
    chosen = stored(C.training_sample(
        docs, labels.select("doc_id", F.col("toxic").cast("int")), sample).select(
        "doc_id", "text", (F.col("toxic") > 0).alias("toxic")), "toxic-sample")
    for_curve = C.unit_hash(F.col("doc_id"), seed=23) < 0.35
    lexicon = learned_lexicon(chosen.where(~for_curve))
    if not lexicon:
        return base
    automaton = None

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nonlocal automaton
        automaton = automaton or matcher(lexicon, exceptions)
        for part in parts:
            out = pd.DataFrame(features(part["text"], automaton), columns=["a", "b", "c"])
            yield out.assign(doc_id=part["doc_id"].to_numpy(), toxic=part["toxic"].to_numpy())

    rows = chosen.where(for_curve).mapInPandas(
        measured, "a double, b double, c double, doc_id long, toxic boolean").toPandas()
    rows = rows.sort_values("doc_id")
    if rows["toxic"].nunique() < 2:
        return ToxicModel(lexicon, exceptions, base.curve)
    return ToxicModel(lexicon, exceptions, fit_curve(
        rows[["a", "b", "c"]].to_numpy(), rows["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = matcher(model.lexicon, model.exceptions)
        for part in parts:
            x = features(part, automaton)
            yield pd.Series(1 / (1 + np.exp(-np.clip(
                model.curve[0] + x @ model.curve[1:], -30, 30))))

    return docs.drop("score", "predicted").withColumn("score", scored("text")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


@C.query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = C.table(spark, sf_dir, "labels").where(~C.held_out(F.col("doc_id")))
    return score(docs, train(docs, labels)).select(
        "doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
