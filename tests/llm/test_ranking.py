"""Ranked search: the two trees against brute force, pruning, edge rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import tables as T
from tracefold.llm import ranking as R

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in RUN.findall(text or "")]


def brute(docs, items, k=10):
    """docs and items: (id, text) pairs -> {item_id: [(doc_id, score), ...]}."""
    held = [(i, words(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    counts = [Counter(t) for _, t in held]
    df = Counter(w for c in counts for w in c)
    out = {}
    for item_id, text in items:
        scored = []
        for (doc_id, t), c in zip(held, counts, strict=True):
            m = 25 + 75 * len(t) * n_docs // n_terms
            score = 0
            for w in words(text):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out[item_id] = [(d, -s) for s, _, _, d in sorted(scored, key=lambda r: r[:3])[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        got = out.setdefault(r["item_id"], [])
        got.append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got)
    return out


@pytest.fixture
def corpus():
    rng = random.Random(4)
    docs = [(i, T.prose(i % 170, rng.randint(1, 90))) for i in range(400)]
    docs += [(1000 + i, T.prose(3, 40)) for i in range(60)]  # ties
    items = [(i, T.prose(i * 7 % 170, 25)) for i in range(90)] + [
        (200, "river river RIVER"), (201, "nowhere"), (202, ""), (203, T.prose(3, 40))]
    return docs, items


@pytest.mark.parametrize("pilot, item_bytes", [(10_000, 10**9), (40, 10**9), (40, 3000)])
def test_search_equals_brute_force(spark, corpus, pilot, item_bytes):
    docs, items = corpus
    found = R.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                     spark.createDataFrame(items, ITEMS), pilot=pilot, item_bytes=item_bytes)
    assert result(found) == {i: rows for i, rows in brute(docs, items).items() if rows}


def test_terms():
    text = "A-b_C9 Über straße\tx yİZ \x7f{q}\U0001f600"
    assert [t.decode() for t in R.terms(text)] == words(text)
    assert R.terms(None) == R.terms("") == R.terms(" -- ") == []


def test_trees_prune_most_pairs(monkeypatch):
    """Topics of their own: whole leaves fall below the k-th score, and nothing is lost."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(R, "LEAVES_AT_ONCE", 1)
    weights = np.full(400, 1000)
    docs = [sorted({int(t) for t in rng.integers(40 * (d % 10), 40 * (d % 10) + 40, 12)})
            for d in range(3000)]
    counts = [{int(t): 1 for t in rng.integers(40 * (i % 10), 40 * (i % 10) + 40, 8)}
              for i in range(64)]
    items = R.Items(counts, weights)
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    impact = rng.integers(1, 1_000_000, len(rows))
    tree = R.Documents(np.arange(3000), np.zeros(3000, bool), rows, np.concatenate(docs), impact,
                       weights)
    best, scored = R.Best(64, 10), 0
    place = np.full(400, -1)
    for group in items.groups:
        place[group.cols] = np.arange(len(group.cols))
        scored += tree.search(group, place, best)
        place[group.cols] = -1
    assert scored < 0.5 * 64 * 3000
    value = [dict(zip(d, impact[rows == i].tolist(), strict=True)) for i, d in enumerate(docs)]
    for i, item in enumerate(counts):
        want = sorted(((-sum(1000 * v.get(t, 0) for t in item), d) for d, v in enumerate(value)))
        assert [(-s, d) for s, d in want[:10]] == list(zip(
            best.score[i].tolist(), best.doc[i].tolist(), strict=True))


def test_scores_beyond_double_precision(monkeypatch):
    counts = [{0: 3, 1: 1}]
    exact = R.Items(counts, np.array([5_000_000_000_000, 1]))
    assert exact.groups[0].weights.dtype == np.int64
    assert R.Items(counts, np.array([5, 1])).groups[0].weights.dtype == np.float64


def test_odd_rows(spark):
    docs = T.odd_documents(spark)
    items = [(1, "river"), (2, None), (None, "stone"), (None, "aaa"), (3, "RIVERston single"),
             (3, "RIVERston single"), (4, "123")]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(items, ITEMS)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    once = [(1, "river"), (None, "aaa"), (3, "RIVERston single"), (4, "123")]
    want = {i: r for i, r in brute(rows, once).items() if r}
    assert result(R.search(docs, table)) == want
    clashing = docs.withColumns({c: F.lit("x") for c in ("n", "terms", "tf", "rank", "item_id")})
    assert result(R.search(clashing, table.withColumn("score", F.lit(1)))) == want
    assert R.search(T.empty_documents(spark), table).count() == 0
    assert R.search(docs, table.where("false")).count() == 0
