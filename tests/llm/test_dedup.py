"""SimHash near-dedup and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import tables as T
from tracefold.llm import components, simhash


def test_hamming_anchors_cover(spark):
    rng = np.random.default_rng(3)
    for width in (7, 21, 32):
        block = simhash.Block(0, width)
        x = rng.integers(0, 1 << width, 300, dtype=np.uint64)
        home = block.anchors(x)[:, 0]
        flip = np.uint64(1) << rng.integers(0, width, 300).astype(np.uint64)
        for y in (x, x ^ flip):  # at most one bit apart: the home of x is an anchor of y
            assert (block.anchors(y) == home[:, None]).any(axis=1).all()
        code = np.uint64((1 << block.code) - 1)  # covering radius 1 on the coded bits
        assert np.bitwise_count((home ^ x) & code).max() <= 1
        assert ((home ^ x) & ~code == 0).all()


def test_block_values_cross_words():
    words = np.array([[0x8000000000000001, 0x3]], np.uint64)
    assert simhash.block_values(words, simhash.Block(63, 3)).tolist() == [0b111]
    assert [b.low for b in simhash.even_blocks(128, 6)] == [0, 21, 42, 64, 85, 106]


def groups(pairs, n):
    label = list(range(n))
    while True:
        new = label[:]
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        new = [new[x] for x in new]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    n = 60
    pairs = {"chain": [(i + 1, i) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n)],
             "random": rng.integers(0, n, (45, 2)).tolist()}[shape]
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = groups(pairs, n)
    assert all(want[r["node"]] == r["label"] for r in got)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r["node"] for r in got} == linked
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(n=40):
    texts = [T.prose(i, 90) for i in range(n)]
    for i in range(0, n, 4):
        words = texts[i].split()
        words[40] = "changed"
        texts += [" ".join(words), texts[i], texts[i].upper()]
    return texts + ["", " ", None]


def test_fingerprint_classes_equal_brute_force(spark):
    texts = planted()
    rows = simhash.fingerprint_classes(T.documents(spark, texts)).toPandas().sort_values("doc_id")
    marks = [simhash.simhash64(t or "") for t in texts]
    assert [int(x) & (1 << 64) - 1 for x in rows["fingerprint"]] == marks
    pairs = [(i, j) for i in range(len(marks)) for j in range(i)
             if (marks[i] ^ marks[j]).bit_count() <= 2]
    assert rows["component_id"].tolist() == groups(pairs, len(marks))
    assert simhash.simhash64("a b") == simhash.simhash64("A  b\n") and marks[-1] == 0


def test_near_duplicates_equal_brute_force(spark):
    texts = planted()
    kept = simhash.remove_near_duplicates(T.documents(spark, texts)).toPandas()
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)
             if simhash.likeness(texts[i] or "", texts[j] or "") >= 0.8]
    assert sorted(kept["doc_id"]) == sorted(set(groups(pairs, len(texts))))
    assert list(kept.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def assert_kept_equals_brute_force(spark, texts):
    kept = simhash.remove_near_duplicates(T.documents(spark, texts)).toPandas()
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    assert pairs and sorted(kept["doc_id"]) == sorted(set(groups(pairs, len(texts))))


def test_near_duplicates_among_boilerplate(spark):
    """Pairs of likeness 0.81 among hundreds of texts of likeness about 0.72."""
    rng, shared, texts = random.Random(5), T.prose(900, 160), []
    for i in range(150):
        own = [f"own{i}x{k}" for k in range(rng.randint(24, 30))]
        other = own[:]
        for k in range(4):  # each changed word is in five shingles
            other[5 * k + 2] = f"else{i}x{k}"
        texts += [shared + " " + " ".join(own), shared + " " + " ".join(other)]
    assert_kept_equals_brute_force(spark, texts)


def test_near_duplicates_of_appended_and_cut_texts(spark):
    """One stretch added or cut away, down to a likeness of 0.8."""
    texts = []
    for i, least in enumerate(np.linspace(0.8, 0.85, 120)):
        words = T.prose(1_000 + i, (30, 60, 120, 300)[i % 4]).split()
        cut = words[:int(np.ceil(least * (len(words) - 4))) + 4]
        texts += [" ".join(words), " ".join(cut if i % 8 < 4 else words[-len(cut):])]
    assert_kept_equals_brute_force(spark, texts)


def test_edge_rows(spark):
    docs = T.odd_documents(spark)
    rows = simhash.fingerprint_classes(docs).collect()
    assert len(rows) == 11
    none = [r for r in rows if r["fingerprint"] == 0]
    assert {r["component_id"] for r in none} == {1}  # null, empty and blank texts
    kept = simhash.remove_near_duplicates(docs).toPandas()
    assert (kept["doc_id"] == 5).sum() == 1 and kept["text"].fillna("").str.strip().eq("").sum() == 1
    empty = T.empty_documents(spark)
    assert simhash.fingerprint_classes(empty).count() == 0
    assert simhash.remove_near_duplicates(empty).count() == 0


def test_links_at_a_hot_shingle_stay_few(spark):
    """400 texts that may all be alike at one shingle: links of one forest, not all pairs."""
    n = 400
    sketch = simhash.sketch_of(np.arange(100, dtype=np.uint64))
    entries = [(7, i, 100, 0, i, sketch, None) for i in range(n)]
    kind = "key long, node long, n int, at int, label long, sketch binary, other long"
    met = spark.createDataFrame(entries, kind)
    links = [(r["a"], r["b"]) for r in simhash.meeting_links(met, 0.8).collect()]
    assert len(links) == n - 1 and set(groups(links, n)) == {0}
    refused = spark.createDataFrame([(7, a, None, None, None, None, b) for a, b in links], kind)
    again = [(r["a"], r["b"]) for r in simhash.meeting_links(met.union(refused), 0.8).collect()]
    assert len(again) == n - 1 and not set(again) & set(links)


def test_fingerprint_links_equal_brute_force(spark):
    marks = [simhash.simhash64(t or "") for t in planted()]
    rows = spark.createDataFrame([(i, int(np.array([m], np.uint64).view(np.int64)[0]))
                                  for i, m in enumerate(marks)], "node long, fingerprint long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(rows).collect()]
    pairs = [(i, j) for i in range(len(marks)) for j in range(i)
             if (marks[i] ^ marks[j]).bit_count() <= 2]
    assert groups(links, len(marks)) == groups(pairs, len(marks))
    assert all((marks[a] ^ marks[b]).bit_count() <= 2 for a, b in links)


def test_sketches_bound_what_texts_share():
    rng = np.random.default_rng(2)
    for size in (10, 300, 90_000):  # the last one fills its cells
        x = np.unique(rng.integers(0, 4 * size, size).astype(np.uint64) * np.uint64(2654435761))
        y = np.unique(np.concatenate([x[:size // 2], x[:size // 4] + np.uint64(1)]))
        a, b = (np.frombuffer(simhash.sketch_of(h), np.uint8)[None] for h in (x, y))
        assert simhash.may_share(a, b)[0] >= len(np.intersect1d(x, y))


def test_refused_links_stay_with_the_shingle_that_gave_them(spark, monkeypatch):
    """Long texts, each of 42 of the same 60 passages: every pair shares many rare shingles and
    none is alike. A shingle gets back links it gave, not each refused pair that shares it."""
    rng, sizes, checked = random.Random(8), [], []
    passages = [T.prose(2_000 + i, 70) for i in range(60)]
    texts = [" ".join(passages[p] for p in sorted(rng.sample(range(60), 42))) for _ in range(16)]
    texts += [T.prose(5, 90), T.prose(5, 90) + " end"]
    given = simhash.meeting_links
    stored = simhash.stored

    def links(met, least, forests=1):
        entries, refused = (met.where(f"other is {s}null").count() for s in ("", "not "))
        sizes.append((entries, refused, forests))
        return given(met, least, forests)

    def counted(df, name, path=None):
        out = stored(df, name, path)
        if name == "checked-links":
            checked.extend((r["a"], r["b"]) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "meeting_links", links)
    monkeypatch.setattr(simhash, "stored", counted)
    assert_kept_equals_brute_force(spark, texts)
    assert len(checked) == len(set(checked))  # no pair is checked twice
    assert sizes[0][0] > 1_000 and sizes[0][1] <= sizes[0][0]
    before = 1
    for entries, refused, forests in sizes:  # all forests so far, and the neighbours
        assert refused <= sizes[0][0] * (before + forests)
        before += forests
