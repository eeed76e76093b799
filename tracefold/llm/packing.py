"""Packing by cutting-stock column generation.

Documents become token ids and an end mark (id 0), cut into full sequences and one shorter
tail each. The tails are packed by a linear program over patterns (multisets of tail lengths
that fill a sequence exactly): a knapsack dynamic program prices new columns from the dual
values until none improves. The rounded-down pattern counts are given to the tails by their
rank within their length; what no pattern takes is laid end to end and cut at sequence ends,
and the very last sequence is split at powers of two, so nothing is padded.

The driver sees a histogram of at most ``SEQUENCE`` lengths. A null or empty text is the end
mark alone. Repeated rows are packed separately; an empty table gives an empty result;
columns other than doc_id and text are not used.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.sources.sinks import stored

SEQUENCE = 1024
END_MARK = 0
#: Columns generated at most; the rest is cut freely, so this bounds time, not coverage.
ROUNDS = 900
TOKENIZER = "byte_bpe_50k.json"

# Fixed value: how byte-level vocabularies of this kind part a text before merging.
_BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                       r"|\s+(?!\S)|\s+")

_OUT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text -> ids by a tokenizer file, as the tokenizers library gives them.

    A plain byte-level vocabulary is run by tiktoken, which gives the same ids faster; the
    strings of its added tokens are set apart first, the longest where several begin. Any other
    file is run by the tokenizers library.
    """
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    split, model = config.get("pre_tokenizer") or {}, config["model"]
    added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
    bare = not any(t.get(flag) for t in config.get("added_tokens", [])
                   for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    plain = (model.get("type", "BPE") == "BPE" and split.get("type") == "ByteLevel"
             and split.get("use_regex", True) and not split.get("add_prefix_space")
             and not config.get("normalizer") and bare)
    if plain:
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letter = {chr(b): b for b in shown}
        letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items()
                 if token not in added}
        ordinary = tiktoken.Encoding("file", pat_str=_BYTE_LEVEL_PATTERN, mergeable_ranks=ranks,
                                     special_tokens={}).encode_ordinary
        apart = re.compile("(" + "|".join(map(re.escape, sorted(
            added, key=len, reverse=True))) + ")") if added else None

        def encode(text: str) -> list[int]:
            if not any(content in text for content in added):
                return ordinary(text)
            ids: list[int] = []
            for piece in apart.split(text):
                ids += [added[piece]] if piece in added else ordinary(piece)
            return ids

        return encode
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path)
    return lambda text: tokens.encode(text, add_special_tokens=False).ids


def cut(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Full pieces and tails of every document, numbered within task and length."""
    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(sequence + 1, np.int64)
        for part in parts:
            for at in C.chunks(len(part), 200):
                rows = []
                for doc_id, text in zip(part["doc_id"].iloc[at], part["text"].iloc[at],
                                        strict=True):
                    ids = np.array([*encode(text or ""), END_MARK], "<u4")
                    n = len(ids)
                    for start in range(0, n, sequence):
                        piece = ids[start:start + sequence].tobytes()
                        size = len(piece) // 4
                        rows.append((doc_id, start, size, zlib.crc32(piece), n, task,
                                     seen[size], None if size == sequence else piece))
                        seen[size] += 1
                yield pd.DataFrame(rows, columns=[
                    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", "ids"]
                ).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        pieces, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, "
                "task int, nth long, ids binary")


def knapsack(price: np.ndarray, size: int) -> tuple[float, list[int]]:
    """Cheapest multiset of lengths with exactly this sum; price[l] is inf without length l."""
    best = np.full(size + 1, np.inf)
    best[0] = 0.0
    last = np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        cost = best[c - 1::-1] + price[1:c + 1] if c > 1 else best[:1] + price[1:2]
        k = int(cost.argmin())
        best[c], last[c] = cost[k], k + 1
    if not np.isfinite(best[size]):
        return np.inf, []
    items, c = [], size
    while c:
        items.append(int(last[c]))
        c -= int(last[c])
    return float(best[size]), items


def generate_patterns(histogram: dict[int, int], size: int = SEQUENCE,
                      rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(count, pattern) pairs: whole pattern counts that never use more tails than there are.

    Revised simplex for: most full sequences, each length used at most as often as it
    occurs. The basis starts with the unused tails (slacks); every round prices one column.
    """
    lengths = sorted(n for n in histogram if 0 < n < size)
    if not lengths:
        return []
    m, row = len(lengths), {n: i for i, n in enumerate(lengths)}
    inverse = np.eye(m)
    have = np.array([float(histogram[n]) for n in lengths])
    value = np.zeros(m)
    basis: list[dict[int, int] | None] = [None] * m
    most = float(np.dot(lengths, have)) / size

    def enter(column: np.ndarray, pattern: dict[int, int] | None, gain: float) -> bool:
        move = inverse @ column
        up = move > 1e-9
        if not up.any():
            return False
        ratio = np.where(up, have / np.where(up, move, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        have[:] = np.maximum(have - step * move, 0.0)
        have[out], value[out], basis[out] = step, gain, pattern
        pivot = inverse[out] / move[out]
        move[out] = 0.0
        np.subtract(inverse, np.outer(move, pivot), out=inverse)
        inverse[out] = pivot
        return True

    def enter_items(items: list[int]) -> bool:
        pattern = {n: items.count(n) for n in set(items)}
        column = np.zeros(m)
        for n, k in pattern.items():
            column[row[n]] = k
        return enter(column, pattern, 1.0)

    for n in lengths:  # pairs that fill a sequence, as a first basis
        if 2 * n <= size and size - n in row:
            enter_items([n, size - n])
    for _ in range(rounds):
        dual = value @ inverse
        worst = int(dual.argmin())
        if dual[worst] < -1e-7:  # an unused-tail column comes back
            slack = np.zeros(m)
            slack[worst] = 1.0
            if not enter(slack, None, 0.0):
                break
            continue
        price = np.full(size + 1, np.inf)
        price[lengths] = np.maximum(dual, 0.0)
        cost, items = knapsack(price, size)
        if not items or cost > 1 - 1e-6 or not enter_items(items):
            break
        if float(value @ have) > 0.999 * most:
            break
    return [(int(x + 1e-6), p) for x, p in zip(have.tolist(), basis, strict=True)
            if p is not None and int(x + 1e-6) > 0]


@dataclass(frozen=True)
class Plan:
    """Where a piece goes, by its length and its rank within that length."""
    size: int
    full: int
    taken: dict[int, tuple[np.ndarray, ...]]
    used: np.ndarray
    rest_at: np.ndarray
    rest_first: int
    rest_tokens: int

    def stops(self) -> list[tuple[int, int]]:
        """(first token, sequence id) of every sequence in the last, split stretch."""
        at = self.rest_tokens - self.rest_tokens % self.size
        number, out = self.rest_first + at // self.size, []
        left = self.rest_tokens - at
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                out.append((at, number))
                at, number = at + (1 << bit), number + 1
        return [*out, (at, number)]


def make_plan(histogram: dict[int, int], size: int = SEQUENCE, rounds: int = ROUNDS) -> Plan:
    chosen = generate_patterns(histogram, size, rounds)
    full = histogram.get(size, 0)
    used = np.zeros(size + 1, np.int64)
    used[size] = full
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    number = full
    for count, pattern in sorted(chosen, key=lambda c: (-c[0], sorted(c[1].items()))):
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            fits = min(count, (histogram[n] - int(used[n])) // k)
            if fits < count:
                raise ValueError("a pattern takes more tails than there are")
            spans.setdefault(n, []).append((int(used[n]), k, number, offset))
            used[n] += count * k
            offset += n * k
        number += count
    rest_at = np.zeros(size + 1, np.int64)
    at = 0
    for n in range(1, size):
        rest_at[n] = at
        at += (histogram.get(n, 0) - int(used[n])) * n
    taken = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True))
             for n, rows in spans.items()}
    return Plan(size, full, taken, used, rest_at, number, at)


def assign(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Pieces with rank -> pieces with sequence_id and offset; free tails are cut."""
    stops = np.array(plan.stops(), np.int64)
    whole = plan.rest_tokens - plan.rest_tokens % plan.size

    def free(row, out: list) -> None:
        at = int(plan.rest_at[row.length] + (row.rank - plan.used[row.length]) * row.length)
        done = 0
        while done < row.length:
            if at < whole:
                number, first = plan.rest_first + at // plan.size, at - at % plan.size
                end = first + plan.size
            else:
                k = int(np.searchsorted(stops[:, 0], at, "right")) - 1
                first, number, end = int(stops[k, 0]), int(stops[k, 1]), int(stops[k + 1, 0])
            n = min(row.length - done, end - at)
            out.append((row.doc_id, row.start + done, n,
                        zlib.crc32(row.ids[4 * done:4 * (done + n)]), row.doc_tokens, number,
                        at - first))
            done, at = done + n, at + n

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for part in parts:
            part = part.astype({"doc_id": "Int64"})
            number = np.full(len(part), -1, np.int64)
            offset = np.zeros(len(part), np.int64)
            length, rank = part["length"].to_numpy(), part["rank"].to_numpy()
            fulls = length == plan.size
            number[fulls] = rank[fulls]
            for n in np.unique(length[(rank < plan.used[length]) & ~fulls]):
                rows = np.flatnonzero((length == n) & (rank < plan.used[n]))
                first, each, base, begin = plan.taken[int(n)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                inside = rank[rows] - first[k]
                number[rows] = base[k] + inside // each[k]
                offset[rows] = begin[k] + inside % each[k] * n
            done = part.assign(sequence_id=number, offset=offset)[number >= 0]
            yield done[names]
            out: list = []
            for row in part[number < 0].itertuples(index=False):
                free(row, out)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return ranked.mapInPandas(placed, _OUT)


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE,
         rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stored(cut(docs, path or tokenizer_path(), sequence), "pieces")
    per_task = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "tails")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(
        "before"))
    ranked = pieces.join(starts, ["task", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids",
        (F.col("before") + F.col("nth")).alias("rank"))
    return assign(ranked, make_plan(histogram, sequence, rounds))


@C.query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
