"""Alignment of two tokenizers, against whole-text encoding and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tests.llm import tables as T
from tracefold.llm import tokens as M

TEXTS = [
    "Hello, it's 1234 tests!", "  two  spaces\n\n\tand tabs ", "naïve café ‍\U0001f600 日本語 ok",
    "<|endoftext|> and <s> plain </s>", "", None, " ", "\n", "x" * 3000, "has ▁ inside", "\u0000\x07 \x1c y",
    "ends with space ", " starts", "a b 　c", "Ciónmenteueó. $$$ ###", "\U00010348\U00010348 é",
    "one\r\ntwo \r three", "é ä", "﻿bom ퟿"]


def plain(texts, path_a, path_b):
    """The contract by loops over whole texts: decoded bytes only, no spans."""
    from tokenizers import Tokenizer
    import sentencepiece

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    table = M._byte_table(a.get_vocab())
    rows, count = [], Counter()
    for text in texts:
        row, links = None, []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [table[i] for i in x]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                       else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                owner_a = [k for k, t in enumerate(bytes_a) for _ in t]
                owner_b = [k for k, t in enumerate(bytes_b) for _ in t]
                links = [(x[i], y[j]) for i, j in dict.fromkeys(zip(owner_a, owner_b, strict=True))]
                groups, i, j, at_a, at_b, gi, gj = [], 0, 0, 0, 0, [], []
                while i < len(x) or j < len(y):
                    if at_a <= at_b:
                        at_a, i, gi = at_a + len(bytes_a[i]), i + 1, [*gi, x[i]]
                    else:
                        at_b, j, gj = at_b + len(bytes_b[j]), j + 1, [*gj, y[j]]
                    if at_a == at_b:
                        groups.append(",".join(map(str, gi)) + "|" + ",".join(map(str, gj)))
                        gi, gj = [], []
                row = (len(x), len(y), len(groups), len(links),
                       hashlib.sha256(";".join(groups).encode()).hexdigest())
        count.update(links)
        rows.append((row, links))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(*row[:4], sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
             row[4]) if row else (0, 0, 0, 0, 0, 0, "") for row, links in rows]


def result(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"],
                          r["count_sum"], r["groups_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("block_pairs", [10**6, 150])
def test_alignment_equals_plain_loops(spark, block_pairs):
    rng = random.Random(3)
    some = "".join(chr(rng.choice([32, 97, 233, 0x4E00, 0x1F600, 10, 0x2581 + 1])) for _ in range(400))
    texts = [*TEXTS, *TEXTS[:3], some, *(T.prose(i, 20 + i) for i in range(30))]
    docs = T.documents(spark, texts).repartition(3)
    got = result(M.alignment(docs, *M.public_files(), block_pairs=block_pairs))
    want = plain(texts, *M.public_files())
    assert got == dict(enumerate(want))
    assert got[9] == (0, 0, 0, 0, 0, 0, "") and got[3][0] > 0


def test_words_agree_with_whole_texts():
    made = M.Aligner(*M.public_files())
    assert made.by_word
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Be", "é", " ", "  ", "\n", "1", "'s", "日", ".", "\U0001f600",
                                   " ", "ton", " "]) for _ in range(rng.randint(1, 60)))
        [words] = list(made([text]))
        whole = made.encoded([text])[0]
        if whole is None:
            assert words == []
            continue
        assert (sum(w[0] for w in words), sum(w[1] for w in words)) == whole[:2]
        assert "".join(w[3] for w in words) == whole[3]
        assert b"".join(w[2] for w in words) == whole[2]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(M, "KEPT_WORDS", 10)
    made = M.Aligner(*M.public_files())
    texts = [T.prose(i % 4, 15) for i in range(12)]
    first = [[w[3] for w in words] for words in made(texts)]
    again = [[w[3] for w in words] for t in texts for words in made([t])]
    assert first == again and len(made.known) < 100


def test_spans_are_certain_except_inside_characters():
    """The coarse cuts alone are right wherever they claim to be."""
    a, b = M.CharacterOffsets(M.public_files()[0]), M.ProtoSpans(M.public_files()[1])
    import numpy as np

    seen = []
    exact = M.refine

    def check(coarse, sizes):
        at = np.flatnonzero(coarse >= 0)
        assert (coarse[at] == np.cumsum(sizes)[at]).all()
        seen.append((len(at), len(coarse)))
        return exact(coarse, sizes)

    M.refine, kept = check, M.refine
    try:
        for text in ["plain words here", "日本語 \U0001f600 é x", "Zürich \U00010348"]:
            a(" " + text), b(text)
    finally:
        M.refine = kept
    assert seen[0][0] == seen[0][1] and seen[1][0] == seen[1][1] and any(n < m for n, m in seen)


def test_edge_rows(spark):
    from pyspark.sql import functions as F

    docs = T.odd_documents(spark).withColumns({"pairs": F.lit(1), "n_a": F.lit(2)})
    got = M.alignment(docs, *M.public_files()).collect()
    assert len(got) == 11
    assert {r["n_links"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert M.alignment(T.empty_documents(spark), *M.public_files()).count() == 0
