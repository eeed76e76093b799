"""Packing, sharding and neighbours: round trips, exact sizes, recall."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tests.llm import tables as T
from tracefold.llm import neighbours, packing, sharding


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def check_packing(rows, texts, tokens, sequence):
    """Every id lies in one piece, sequences are gapless, full or a power of two."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at:at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == sequence or at & (at - 1) == 0
        short += at < sequence
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert short <= sequence.bit_length()


@pytest.mark.parametrize("sequence", [64, 1024])
def test_packing_round_trip(spark, tokens, sequence):
    texts = [T.prose(i, 3 + 37 * i % 400) for i in range(80)] + [
        None, "", "<|endoftext|>é\U0001f600", "a <|endoftext|> b<|endoftext|>"]
    rows = packing.pack(T.documents(spark, texts), sequence=sequence).collect()
    check_packing(rows, dict(enumerate(texts)), tokens, sequence)


def test_fast_encoder_gives_the_same_ids(tokens):
    encode = packing.encoder(packing.tokenizer_path())
    for text in ["", "a", " Hello, it's 1234 tests!\n\n\tnew ", "naïve café ‍\U0001f600",
                 "x" * 3000, "<|endoftext|> tail", "Ciónmenteueó. $$$ ###", "a <|endoftext|> b",
                 "<|endoftext|>", " <|endoftext|><|endoftext|>", "<|endoftext", "x<|endoftext|>",
                 "<|endoftext|>|endoftext|>", "a\n<|endoftext|>\n\n b"]:
        assert encode(text) == tokens.encode(text, add_special_tokens=False).ids


def test_patterns_fill_and_never_overdraw():
    rng = np.random.default_rng(5)
    for size in (32, 100):
        histogram = {int(n): int(rng.integers(1, 60)) for n in rng.integers(1, size, 25)}
        chosen = packing.generate_patterns(histogram, size)
        used = {}
        for count, pattern in chosen:
            assert sum(n * k for n, k in pattern.items()) == size
            for n, k in pattern.items():
                used[n] = used.get(n, 0) + k * count
        assert all(used[n] <= histogram[n] for n in used)
        tokens = sum(n * k for n, k in histogram.items())
        assert sum(c for c, _ in chosen) >= 0.6 * tokens / size
    assert packing.generate_patterns({}) == []
    assert packing.knapsack(np.array([np.inf, np.inf, 1.0, 2.5, np.inf, np.inf]), 5)[0] == 3.5


def test_packing_edge_rows(spark):
    rows = packing.pack(T.odd_documents(spark)).collect()
    assert sum(r["start"] == 0 for r in rows) == 11
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(T.empty_documents(spark)).count() == 0


def test_matrix_has_exact_sums_and_follows_the_law():
    counts = sharding.matrix([700, 0, 300, 5], 4, 1)
    assert counts.sum(axis=1).tolist() == [700, 0, 300, 5]
    assert sorted(counts.sum(axis=0).tolist()) == [251, 251, 251, 252]
    first = np.array([sharding.matrix([40, 60], 4, s)[0, 0] for s in range(3000)])
    assert abs(first.mean() - 10) < 0.3  # hypergeometric: n K / N
    assert abs(first.var() - 40 * 0.25 * 0.75 * 60 / 99) < 0.5


def test_draws_follow_the_law_on_both_sides_of_the_limit(monkeypatch):
    """Inverted draws against the exact probabilities, and populations of 10^15."""
    from math import comb

    monkeypatch.setattr(sharding, "SAMPLER_LIMIT", 0)
    for have, rest, n in [(7, 12, 9), (1, 5, 6), (40, 3, 20), (5, 5, 10)]:
        rng = np.random.default_rng(1)
        drawn = np.bincount([sharding.hypergeometric(rng, have, rest, n) for _ in range(20_000)],
                            minlength=n + 1) / 20_000
        law = np.array([comb(have, k) * comb(rest, n - k) / comb(have + rest, n)
                        for k in range(n + 1)])
        assert np.abs(drawn - law).max() < 0.012 and (drawn[law == 0] == 0).all()
    monkeypatch.undo()
    rng = np.random.default_rng(2)
    have, rest, n = 4 * 10**13, 10**15, 5_000_000
    drawn = np.array([sharding.hypergeometric(rng, have, rest, n) for _ in range(3000)])
    p = have / (have + rest)
    assert abs(drawn.mean() - n * p) < 5 * np.sqrt(n * p * (1 - p) / 3000)
    assert abs(drawn.std() / np.sqrt(n * p * (1 - p)) - 1) < 0.05
    counts = sharding.matrix([10**12 + 7] * 3, 5, 1)
    assert counts.sum(axis=1).tolist() == [10**12 + 7] * 3
    assert counts.sum(axis=0).max() - counts.sum(axis=0).min() <= 1


def test_shards_are_exact_gapless_and_mixed(spark):
    rows = spark.range(5003).selectExpr("id AS doc_id").repartition(7)
    out = sharding.shard_rows(rows, 24, 5).toPandas()
    assert sorted(out["doc_id"]) == list(range(5003))
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    # neighbours in the input end in all shards, and slots do not follow the ids
    close = out.sort_values("doc_id")["shard"].to_numpy()
    assert abs((close[1:] == close[:-1]).mean() - 1 / 24) < 0.02
    assert abs(np.corrcoef(out["doc_id"], out["slot"])[0, 1]) < 0.06
    assert sharding.shard_rows(rows.where("false"), 24).count() == 0


def test_sharding_query_on_odd_rows(spark, tmp_path):
    T.save(spark, T.odd_documents(spark), tmp_path, "documents")
    rows = sharding.op4_sharding(spark, str(tmp_path)).collect()
    assert len(rows) == 11
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(8, 0)}


def brute(rows, queries, k):
    out = {}
    for q in queries:
        scored = sorted(((-float(np.dot(rows[q], rows[i])), i) for i in rows if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = {i: rng.integers(-3, 4, 6).astype(float).tolist() for i in range(120)}
    rows |= {i: rows[7] for i in range(200, 240)} | {300: [1.0] * 6}
    rows = {i: v for i, v in rows.items() if any(v)}
    odd = [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None] + [0.0] * 4),
           (904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([*rows.items(), *odd, (300, [1.0] * 6)],
                               "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = neighbours.nearest(df.withColumn("score", F.lit("x")), F.col("vec_id") % 20 == 0).toPandas()
    want = brute(rows, [q for q in rows if q % 20 == 0], 20)
    assert set(got["query_id"]) == set(want)
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21))
        assert part["vec_id"].tolist() == want[q]
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = neighbours.op1_neighbours(spark, sf).toPandas()
    rows = {r["vec_id"]: np.array(r["embedding"], float)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(rows, [q for q in rows if q % 20 == 0], 20)
    found = got.groupby("query_id")["vec_id"].agg(set)
    assert np.mean([len(found[q] & set(v)) / 20 for q, v in want.items()]) >= 0.9


def test_too_few_under_the_leading_bits_go_to_the_root(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ARRAY_ROWS", 8)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)
    rng = np.random.default_rng(8)
    rows = {i: rng.standard_normal(4).tolist() for i in range(200)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, share=20.0).toPandas()
    want = brute(rows, range(0, 200, 20), 5)
    for q, part in got.groupby("query_id"):
        assert part.sort_values("rank")["vec_id"].tolist() == want[q]
