"""Cross-tokenizer alignment by the libraries' own spans.

Each text is encoded by two tokenizers, A (tokenizers library, with character offsets) and B
(sentencepiece, with the spans of its proto). The spans are coarse cuts: a token that ends
where a character ends has its byte offset from them. Tokens inside one character (byte-level
pieces of a multibyte character, byte-fallback tokens) share its span and are set apart by the
decoded bytes of the tokens between the two nearest certain cuts. Cuts that both tokenizers
make part the text into groups; every stretch between two cuts of either is one link.

Texts are taken apart at single spaces between two non-spaces where both vocabularies are known
to cut (``cuts_at_spaces``), so a word is encoded once a task and looked up afterwards; other
vocabularies get whole texts. How often two ids are linked is counted over the whole corpus and
read back in blocks of ``BLOCK_PAIRS`` pairs, so no more than one block is broadcast at once.

The installed sentencepiece calls its immutable proto ``return_type="proto"`` and counts spans
in bytes of the text, older ones in characters; ``_span_unit`` asks the library which.

Edge cases: a text that is null, empty, or that the joined token bytes do not give back (such as
one that holds U+2581 itself) has no tokens: zero counts and an empty ``groups_sha256``. Repeated
rows count as often as they occur. An empty table gives an empty result. Columns other than
doc_id and text are not used. Very long words are encoded whole and not kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.sources.sinks import stored

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words that a task remembers, and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 400_000, 60
#: Texts whose new words are encoded together.
TEXTS_AT_ONCE = 200
#: Pairs of one broadcast block of counts (16 bytes each), and those a task adds up at once.
BLOCK_PAIRS, HELD_PAIRS = 2_000_000, 2_000_000
SPACE = "▁"

_ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, "
            "groups_sha256 string, pairs binary, times binary, n_best long, count_sum long")
_CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Tokens:
    """Ids of one text, and where each token ends, in bytes."""
    ids: np.ndarray
    ends: np.ndarray


def byte_places(text: str) -> np.ndarray:
    """Byte offset of every character's start, and of the end."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(sizes)])


def refine(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends out of coarse ends (-1 where a token ends inside a character).

    Certain ends stay; from each on, the decoded sizes set the next ones apart. Where the two
    contradict each other, the decoded bytes decide.
    """
    exact = np.cumsum(sizes)
    certain = np.flatnonzero(coarse >= 0)
    last = np.searchsorted(certain, np.arange(len(coarse)), "right") - 1
    base = certain[np.maximum(last, 0)] if len(certain) else np.zeros(len(coarse), np.int64)
    ends = np.where(last >= 0, coarse[base] + exact - exact[base], exact)
    return ends if (ends == exact).all() else exact


def _byte_table(vocab: dict[str, int]) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in shown}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else (
            token.encode())
    return out


class CharacterOffsets:
    """A: the tokenizers library, ids with character offsets."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_file(path)
        self.tokens.encode_special_tokens = True
        self.bytes = _byte_table(self.tokens.get_vocab(with_added_tokens=True))
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        pre = str(self.tokens.pre_tokenizer)
        self.cuts_at_spaces = (pre.startswith("ByteLevel") and "use_regex=True" in pre
                               and self.tokens.normalizer is None)

    def __call__(self, text: str) -> Tokens | None:
        made = self.tokens.encode(text, add_special_tokens=False)
        ids = np.array(made.ids, np.int64)
        raw = text.encode()
        if b"".join([self.bytes[i] for i in made.ids]) != raw or not len(ids):
            return None
        spans = np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(ids)
                            ).reshape(-1, 2)
        coarse = spans[:, 1]
        if len(raw) != len(text):
            coarse = byte_places(text)[coarse]
        # a span that the next token's span begins inside ends within a character
        inside = np.zeros(len(ids), bool)
        inside[:-1] = spans[1:, 0] < spans[:-1, 1]
        return Tokens(ids, refine(np.where(inside, -1, coarse), self.size[ids]))


class ProtoSpans:
    """B: sentencepiece, ids with the spans of its proto; it adds a space in front."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.fallback = np.array([self.model.is_byte(i) for i in range(len(pieces))])
        self.bytes = [bytes([int(p[3:5], 16)]) if self.fallback[i] else p.replace(
            SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.unit = self._span_unit()
        # a piece with a space after something else could reach over a word's end
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in pieces) and (
            self.model.decode(self.model.encode("a bﬁ  c")) == "a bﬁ  c")

    def proto(self, text: str):
        try:
            return self.model.encode(text, return_type="proto")
        except TypeError:
            return self.model.encode(text, out_type="immutable_proto")

    def _span_unit(self) -> str:
        last = max((p.end for p in self.proto("é").pieces), default=2)
        return "bytes" if last == 2 else "characters"

    def __call__(self, text: str) -> Tokens | None:
        pieces = [(p.id, p.end) for p in self.proto(text).pieces]
        raw = b" " + text.encode()
        if not pieces or b"".join([self.bytes[i] for i, _ in pieces]) != raw:
            return None
        ids, last = np.fromiter(chain.from_iterable(pieces), np.int64, 2 * len(pieces)
                                ).reshape(-1, 2).T
        if self.unit == "characters":
            last = byte_places(text)[last]
        # the bytes of one character share its span; only the last of them ends where it does
        inside = np.zeros(len(ids), bool)
        inside[:-1] = last[1:] == last[:-1]
        coarse = np.where(inside | self.fallback[ids], -1, last + 1)
        return Tokens(ids, refine(coarse, self.size[ids]))


#: The alignment of one text or word: tokens of A, of B, linked id pairs (64-bit numbers), and
#: groups as text, each with its semicolon.
Word = tuple[int, int, bytes, str]


class Printed:
    """Ids as text, with the mark that follows them in the list of groups."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.size_a, self.size_b = size_a, size_b
        self.text = [f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;"))
                     for mark in marks for i in range(size)]

    def groups(self, a: Tokens, b: Tokens, both: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(printed tokens, A's before B's in every group, and where the groups end in it)."""
        group_a, group_b = np.searchsorted(both, a.ends), np.searchsorted(both, b.ends)
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        codes = np.concatenate([a.ids + self.size_a * last_a,
                                2 * self.size_a + b.ids + self.size_b * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        stops = np.cumsum(np.bincount(group_a) + np.bincount(group_b))
        return list(map(self.text.__getitem__, codes[order].tolist())), stops


def align(a: Tokens, b: Tokens, stops: np.ndarray, printed: Printed) -> list[Word]:
    """The alignment of each stretch between ``stops``, ends that A and B have in common.

    Links are the stretches between neighbouring cuts: each lies in one token of A and of B.
    """
    cuts = np.union1d(a.ends, b.ends)
    at_a, at_b = np.searchsorted(a.ends, cuts), np.searchsorted(b.ends, cuts)
    linked = (a.ids[at_a] << 32 | b.ids[at_b]).tobytes()
    both = np.intersect1d(a.ends, b.ends, assume_unique=True)
    texts, group_stops = printed.groups(a, b, both)
    to = [c.tolist() for c in (
        8 * (np.searchsorted(cuts, stops) + 1), group_stops[np.searchsorted(both, stops)],
        np.searchsorted(a.ends, stops) + 1, np.searchsorted(b.ends, stops) + 1)]
    out, cut, text, n_a, n_b = [], 0, 0, 0, 0
    for next_cut, next_text, next_a, next_b in zip(*to, strict=True):
        out.append((next_a - n_a, next_b - n_b, linked[cut:next_cut],
                    "".join(texts[text:next_text])))
        cut, text, n_a, n_b = next_cut, next_text, next_a, next_b
    return out


class Aligner:
    """Texts -> alignments, word by word where both vocabularies cut at single spaces."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = CharacterOffsets(path_a), ProtoSpans(path_b)
        self.by_word = self.a.cuts_at_spaces and self.b.cuts_at_spaces
        self.printed = Printed(len(self.a.bytes), len(self.b.bytes))
        self.known: dict[str, Word | None] = {}
        self.older: dict[str, Word | None] = {}

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.by_word:
            return [text]
        plain = text.split(" ")
        # single spaces between words without other white space need no pattern
        return plain if plain == text.split() else _CUT.split(text)

    def encoded(self, words: list[str]) -> list[Word | None]:
        """Alignments of words that may stand side by side, parted by single spaces."""
        a, b = self.a(" " + " ".join(words)), self.b(" ".join(words))
        if a is not None and b is not None:
            return align(a, b, np.cumsum([len(w.encode()) + 1 for w in words]), self.printed)
        if len(words) == 1:
            return [None]
        return [self.encoded([w])[0] for w in words]

    def __call__(self, texts: list[str | None]) -> Iterator[list[Word]]:
        """Each text's words in order; none if any of them does not give its text back."""
        parted = [self.words(t) for t in texts]
        if len(self.known) > KEPT_WORDS // 2:  # words in use come back from the older half
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        asked = [w for w in dict.fromkeys(chain.from_iterable(parted)) if w not in known]
        known.update((w, older[w]) for w in asked if w in older)
        new = [w for w in asked if w not in known]
        joined = [w for w in new if not (w[0].isspace() or w[-1].isspace())]
        alone = [w for w in new if w[0].isspace() or w[-1].isspace()]
        if joined and self.by_word:
            known.update(zip(joined, self.encoded(joined), strict=True))
        else:
            alone = new
        for word in alone:
            known[word] = self.encoded([word])[0]
        for words in parted:
            found = [known[w] for w in words]
            yield [] if None in found else found
        for word in new:
            if len(word) > KEPT_LENGTH:
                del known[word]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker: later tasks find the words of the earlier ones."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with counts, digest, and its linked pairs with their numbers."""
    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align_texts = aligner(path_a, path_b)
        for part in parts:
            for at in C.chunks(len(part), TEXTS_AT_ONCE):
                rows = []
                some = part["text"].iloc[at].tolist()
                for doc_id, words in zip(part["doc_id"].iloc[at], align_texts(some), strict=True):
                    if not words:
                        rows.append((doc_id, 0, 0, 0, 0, "", b"", b"", 0, 0))
                        continue
                    of_a, of_b, linked, groups = zip(*words, strict=True)
                    links = np.frombuffer(b"".join(linked), np.int64)
                    pairs, times = np.unique(links, return_counts=True)
                    n_a, n_b = sum(of_a), sum(of_b)
                    # every common cut is counted by A and by B, and ends one stretch
                    rows.append((
                        doc_id, n_a, n_b, n_a + n_b - len(links), len(links),
                        hashlib.sha256("".join(groups)[:-1].encode()).hexdigest(), pairs.tobytes(),
                        times.astype(np.int32).tobytes(), 0, 0))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ALIGNED.split(", ")]
                                   ).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(each, _ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold the pair, added up in the tasks first."""
    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in held)])
            times = np.concatenate([np.zeros(0, np.int64), *(t for _, t in held)])
            pairs, at = np.unique(pairs, return_inverse=True)
            return pairs, np.bincount(at, times, len(pairs)).astype(np.int64)

        for part in parts:
            for some in C.chunks(len(part), 500):
                held.append((np.frombuffer(b"".join(part["pairs"].iloc[some]), np.int64),
                             np.frombuffer(b"".join(part["times"].iloc[some]), np.int32)))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    held = [total()]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield pd.DataFrame(dict(zip(("pair", "n"), held[0], strict=True)))
                        held, size = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("pair", "n"), total(), strict=True)))

    return rows.select("pairs", "times").mapInPandas(add, "pair long, n long").groupBy(
        "pair").agg(F.sum("n").alias("n"))


def add_counts(rows: DataFrame, block: tuple[np.ndarray, np.ndarray], most: np.ndarray,
               first: bool) -> DataFrame:
    """``rows`` with the counts of one block added to count_sum and n_best.

    ``block`` holds pairs (sorted) that are linked twice or more; a pair of no block is linked
    once, which the ``first`` block's pass takes for granted and every block corrects.
    """
    known, count = block

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            summed, best = part["count_sum"].to_numpy().copy(), part["n_best"].to_numpy().copy()
            for i, (p, t) in enumerate(zip(part["pairs"], part["times"], strict=True)):
                pairs, times = np.frombuffer(p, np.int64), np.frombuffer(t, np.int32)
                if not len(pairs):
                    continue
                top = most[pairs & 0xFFFFFFFF]
                if first:
                    summed[i] += times.sum(dtype=np.int64)
                    best[i] += times[top == 1].sum(dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    hit = known[at] == pairs
                    n, k = count[at[hit]], times[hit].astype(np.int64)
                    summed[i] += ((n - 1) * k).sum()
                    best[i] += k[n == top[hit]].sum()
            yield part.assign(count_sum=summed, n_best=best)

    return rows.mapInPandas(add, _ALIGNED)


def alignment(docs: DataFrame, path_a: str, path_b: str,
              block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    rows = stored(aligned(docs, path_a, path_b), "aligned")
    counts = stored(pair_counts(rows), "pair-counts")
    # one number for every id of B: bounded by its vocabulary
    best = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(
        F.max("n").alias("n")).toPandas()
    most = np.zeros(int(best["b"].max()) + 1 if len(best) else 1, np.int64)
    most[best["b"].to_numpy(np.int64)] = best["n"].to_numpy(np.int64)
    several = counts.where("n > 1")
    blocks = max(1, -(-several.count() // block_pairs))
    for i in range(blocks):
        block = several.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).toPandas()
        pairs, n = block["pair"].to_numpy(np.int64), block["n"].to_numpy(np.int64)
        order = np.argsort(pairs)
        rows = add_counts(rows, (pairs[order], n[order]), most, i == 0)
        if i + 1 < blocks:  # the next block is broadcast when this one has left the tasks
            rows = stored(rows, "counted")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       "groups_sha256")


def public_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(FILE_A), public_tokenizers.path(FILE_B)


@C.query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(C.table(spark, sf_dir, "documents"), *public_files())
