"""Small tables for the edge cases every operator and stage has to take."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["river", "stone", "carry", "window", "yellow", "market", "thirteen", "garden", "letter",
         "morning", "silver", "bridge", "number", "autumn", "little", "paper", "summer", "engine"]


def prose(seed: int, n: int) -> str:
    """n made-up words: pairs of common ones, so that texts of two seeds differ."""
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(WORDS)[:4] for _ in range(n)]
    for i in range(0, n, 11):
        words[i] = words[i].capitalize()
    return " ".join(words) + "."


def documents(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t) if t is not None else None)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def odd_documents(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows."""
    long_text = prose(1, 30_000)
    rows = [
        (None, None, None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4), (4, long_text, "en", "s", len(long_text)),
        (5, prose(2, 60), None, None, None), (5, prose(2, 60), None, None, None),
        (6, "### $$$ 123 %%%", "en", "s", 15), (None, prose(3, 60), "en", "s", 300),
        (7, "single", "en", "s", 6), (8, "\u0000�\U0001f600 ‍", "en", "s", 5),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def save(spark, df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
