"""Ranked lexical search with two trees.

Items (the queries) and documents are sparse vectors over the items' terms. Both sides get a
hierarchy whose nodes hold coordinate maxima: items in groups and subgroups, the documents of a
batch in branches and leaves, each sorted by their heaviest terms so that neighbours are alike.
The product of two nodes' maxima bounds every score between them, so a pair of nodes whose bound
is below the weakest k-th score of its items is left out with all that is under it. Nothing that
could enter a result is: equal scores are settled by the smaller doc_id, and a node that can only
tie is left out only if all its ids are larger.

The documents are read once into term counts (``stored``); nothing of them is shuffled. A pilot
over about ``PILOT`` documents gives each item a k-th score to start from, which only sets how
much is pruned. Every task returns at most k rows an item, and those are ranked across tasks.
Items are taken in blocks of about ``ITEM_BYTES`` of text, which bounds what the driver and the
tasks hold of them; each block is one pass over the documents.

Edge cases: a null text has no terms, and a document without terms counts nowhere. An item
without terms, or whose terms no document holds, has no rows. Of benchmark rows with one item_id
(null is one, too) the smallest text counts. Repeated documents are ranked as often as they
occur; a null doc_id comes last among equal scores. Empty tables give an empty result. Columns
other than doc_id, item_id and text are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.sources.sinks import stored

TOP = 10
#: Text of one block of items, about.
ITEM_BYTES = 2_000_000
#: Documents of a leaf, leaves of a branch; items of a group and of a subgroup.
LEAF, BRANCH = 32, 8
GROUP, SUBGROUP = 64, 8
#: Documents of one tree, and leaves that are scored together.
TREE, LEAVES_AT_ONCE = 8192, 16
#: Documents of the pilot, about.
PILOT = 16_384
#: Scores up to here are exact in double precision.
EXACT = 1 << 53
LAST_ID = np.iinfo(np.int64).max

#: ASCII letters in lower case, digits and bytes beyond ASCII stay; the rest becomes a space.
_LETTERS = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(
    range(128, 256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z lowered."""
    return (text or "").encode().translate(_LETTERS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """A term's share of a score before its weight, for documents of ``n`` terms."""
    m = 25 + (75 * n * documents) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Group:
    """Up to GROUP items: their weighted counts over the terms they have, and the subgroups'
    maxima."""
    items: np.ndarray
    cols: np.ndarray
    weights: np.ndarray
    parts: list[slice]
    most: np.ndarray


class Items:
    """The item tree of one block: groups in order of the items' heaviest terms."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray) -> None:
        self.size, self.weights = len(counts), weights
        heavy = [sorted(((-int(weights[t]) * c, t) for t, c in item.items()))[:2]
                 for item in counts]
        order = sorted((i for i in range(len(counts)) if heavy[i]),
                       key=lambda i: [t for _, t in heavy[i]])
        self.groups = []
        for at in C.chunks(len(order), GROUP):
            some = order[at]
            cols = np.array(sorted({t for i in some for t in counts[i]}), np.int64)
            place = {t: k for k, t in enumerate(cols.tolist())}
            table = np.zeros((len(some), len(cols)), np.int64)
            for row, i in enumerate(some):
                for t, c in counts[i].items():
                    table[row, place[t]] = c * int(weights[t])
            # double products are exact while no bound, so no score, can pass 2^53
            if int(table.max(axis=0).sum()) * 1_000_000 < EXACT:
                table = table.astype(np.float64)
            parts = [slice(a.start, a.stop) for a in C.chunks(len(some), SUBGROUP)]
            self.groups.append(Group(np.array(some), cols, table, parts,
                                     np.stack([table[p].max(axis=0) for p in parts])))


class Best:
    """The k best documents of every item so far: score, then id, null ids last."""

    def __init__(self, items: int, k: int, floor: np.ndarray | None = None) -> None:
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.full((items, k), LAST_ID)
        self.null = np.ones((items, k), bool)
        self.k = k
        #: a score that k documents are known to reach; nothing below it can count
        self.floor = np.ones(items, np.int64) if floor is None else np.maximum(floor, 1)

    def least(self, items: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[items], self.score[items, -1])

    def last_id(self, items: np.ndarray) -> np.ndarray:
        """Largest id that can still enter at a score equal to ``least``."""
        own = self.score[items, -1] >= self.floor[items]
        return np.where(own, self.doc[items, -1], LAST_ID)

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score = np.concatenate([self.score[item], score])
        doc = np.concatenate([self.doc[item], doc])
        null = np.concatenate([self.null[item], null])
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score[item], self.doc[item], self.null[item] = score[order], doc[order], null[order]


class Documents:
    """The tree of one batch of documents; entries (document, term, impact) in its order."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, rows: np.ndarray, term: np.ndarray,
                 impact: np.ndarray, weights: np.ndarray) -> None:
        n = len(ids)
        by_weight = np.lexsort((term, -impact * weights[term], rows))
        start = np.searchsorted(rows[by_weight], np.arange(n))
        first = term[by_weight[start]]
        second = np.minimum(start + 1, len(rows) - 1)
        second = np.where(rows[by_weight[second]] == np.arange(n), term[by_weight[second]], -1)
        order = np.lexsort((ids, null, second, first))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        entry = np.argsort(place[rows], kind="stable")
        self.ids, self.null, self.size = ids[order], null[order], n
        self.row, self.term, self.impact = place[rows][entry], term[entry], impact[entry]
        self.leaves = -(-n // LEAF)
        self.first_id = np.minimum.reduceat(np.where(self.null, LAST_ID, self.ids), np.arange(
            0, n, LEAF))

    def search(self, group: Group, place: np.ndarray, best: Best) -> int:
        """Bring ``best`` up to date for the items of ``group``; returns the pairs scored."""
        at = place[self.term]
        kept = np.flatnonzero(at >= 0)
        row, col, impact = self.row[kept], at[kept], self.impact[kept]
        width, kind = len(group.cols), group.weights.dtype
        branches = -(-self.leaves // BRANCH)
        leaf_most = np.zeros((branches * BRANCH, width), kind)
        np.maximum.at(leaf_most.reshape(-1), row // LEAF * width + col, impact.astype(kind))
        # group against branches, then subgroups against the leaves of those that stay
        branch_most = leaf_most.reshape(branches, BRANCH, width).max(axis=1)
        weakest = best.least(group.items).min()
        bound = branch_most @ group.most.max(axis=0)
        near = np.repeat(bound >= weakest, BRANCH)[:self.leaves]
        leaves = np.flatnonzero(near)
        if not len(leaves):
            return 0
        bounds = leaf_most[leaves] @ group.most.T
        best_first = np.argsort(-bounds.max(axis=1), kind="stable")
        leaves, bounds = leaves[best_first], bounds[best_first]
        edges = np.searchsorted(row, np.arange(self.leaves + 1) * LEAF)
        scored = 0
        for some in C.chunks(len(leaves), LEAVES_AT_ONCE):
            alive = np.zeros((len(leaves[some]), len(group.parts)), bool)
            for p, part in enumerate(group.parts):
                least = best.least(group.items[part])[None]
                last = best.last_id(group.items[part])[None]
                over = bounds[some, p][:, None]
                ties = (over == least) & (self.first_id[leaves[some]][:, None] <= last)
                alive[:, p] = ((over > least) | ties).any(axis=1)
            stays = np.flatnonzero(alive.any(axis=1))
            if not len(stays):
                continue
            parts = np.flatnonzero(alive.any(axis=0))
            chosen = leaves[some][stays]
            count = edges[chosen + 1] - edges[chosen]
            take = np.arange(count.sum()) + np.repeat(edges[chosen] - np.cumsum(count) + count,
                                                      count)
            docs = (chosen[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
            table = np.zeros((len(docs), width), kind)
            table[np.repeat(np.arange(len(chosen)), count) * LEAF + row[take] % LEAF,
                  col[take]] = impact[take]
            members = np.concatenate([np.arange(len(group.items))[group.parts[p]] for p in parts])
            found = table @ group.weights[members].T
            scored += int(alive[stays].sum()) * SUBGROUP * LEAF
            least = best.least(group.items[members])
            hit = found >= least[None]
            for j in np.flatnonzero(hit.any(axis=0)):
                rows = np.flatnonzero(hit[:, j])
                best.add(int(group.items[members[j]]), found[rows, j].astype(np.int64),
                         self.ids[docs[rows]], self.null[docs[rows]])
        return scored


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tf (those of the vocabulary) of every document with
    terms."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        for part in parts:
            for at in C.chunks(len(part), 1000):
                rows = []
                for doc_id, text in zip(part["doc_id"].iloc[at], part["text"].iloc[at],
                                        strict=True):
                    words = terms(text)
                    ids = np.array(list(map(get, words, repeat(-1))), np.int32)
                    found, times = np.unique(ids[ids >= 0], return_counts=True)
                    rows.append((doc_id, len(words), found.tobytes(), times.astype(
                        np.int32).tobytes()))
                made = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tf"]).astype(
                    {"doc_id": "Int64"})
                yield made[made["n"] > 0]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        count, "doc_id long, n long, terms binary, tf binary")


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents holding each term of the vocabulary (one number a term to the driver)."""
    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(size, np.int64)
        for part in parts:
            held += np.bincount(np.frombuffer(b"".join(part["terms"]), np.int32), minlength=size)
        term = np.flatnonzero(held)
        yield pd.DataFrame({"term": term, "df": held[term]})

    found = counted.select("terms").mapInPandas(add, "term int, df long").groupBy("term").agg(
        F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


def trees(parts: Iterator[pd.DataFrame], weights: np.ndarray, documents: int,
          all_terms: int) -> Iterator[Documents]:
    """Trees of up to TREE documents that hold a term of the items."""
    for part in parts:
        part = part[part["terms"].str.len() > 0]
        for at in C.chunks(len(part), TREE):
            some = part.iloc[at]
            term = np.frombuffer(b"".join(some["terms"]), np.int32).astype(np.int64)
            tf = np.frombuffer(b"".join(some["tf"]), np.int32).astype(np.int64)
            rows = np.repeat(np.arange(len(some)), some["terms"].str.len().to_numpy() // 4)
            n = some["n"].to_numpy(np.int64)[rows]
            null = some["doc_id"].isna().to_numpy()
            ids = some["doc_id"].astype("Int64").fillna(LAST_ID).to_numpy(np.int64)
            yield Documents(ids, null, rows, term, impacts(tf, n, documents, all_terms), weights)


def best_documents(counted: DataFrame, items: Items, documents: int, all_terms: int, k: int,
                   floor: np.ndarray | None) -> DataFrame:
    """item (its number), doc_id, score: the k best of every task."""
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(items.size, k, floor)
        place = np.full(len(items.weights), -1, np.int64)
        for tree in trees(parts, items.weights, documents, all_terms):
            for group in items.groups:
                place[group.cols] = np.arange(len(group.cols))
                tree.search(group, place, best)
                place[group.cols] = -1
        item, at = np.nonzero(best.score >= np.maximum(best.floor, 1)[:, None])
        doc = pd.Series(best.doc[item, at], dtype="Int64").mask(best.null[item, at])
        yield pd.DataFrame({"item": item, "doc_id": doc, "score": best.score[item, at]})

    return counted.mapInPandas(find, "item int, doc_id long, score long")


def ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list[tuple], k: int, pilot: int) -> DataFrame:
    """``block``: (item_id, text) rows -> item (place in the block), rank, doc_id, score."""
    words = [Counter(terms(text)) for _, text in block]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    counted = stored(term_counts(docs, vocabulary), "term-counts")
    documents, all_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = document_frequencies(counted, len(vocabulary))
    weights = np.array([weight(documents, int(h)) for h in held], np.int64)
    items = Items([{vocabulary[w]: c for w, c in item.items() if held[vocabulary[w]]}
                   for item in words], weights)
    floor = None
    one_in = documents // max(1, pilot)
    if one_in > 1:
        some = counted.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(one_in)) == 0)
        # the k-th score of some documents is a lower bound of that of all
        tried = ranked(best_documents(some, items, documents, all_terms, k, None), "item", k
                       ).where(F.col("rank") == k).select("item", "score").collect()
        floor = np.zeros(items.size, np.int64)
        for row in tried:
            floor[row["item"]] = row["score"]
    return ranked(best_documents(counted, items, documents, all_terms, k, floor), "item", k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES,
           pilot: int = PILOT) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    texts = stored(items.where("text IS NOT NULL").groupBy(F.col("item_id").cast("long").alias(
        "item_id")).agg(F.min("text").alias("text")), "items")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // item_bytes))
    out = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for i in range(blocks):
        rows = [tuple(r) for r in texts.where(F.pmod(F.xxhash64("item_id"), F.lit(
            blocks)) == i).orderBy("item_id").collect()]
        if any(terms(text) for _, text in rows):
            names = spark.createDataFrame(
                [(n, item_id) for n, (item_id, _) in enumerate(rows)], "item int, item_id long")
            found = _search_block(docs, rows, k, pilot)
            if blocks > 1:
                found = stored(found, "ranked-block")
            out.append(found.join(F.broadcast(names), "item").select(
                "item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out) if len(out) > 2 else out[-1]


_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = (f"regexp_extract_all(translate(text, '{C.UPPER}', '{C.LOWER}'), '{_RUN}')")


@C.query("op11_ranking", f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    {_WORDS} AS t FROM documents WHERE text IS NOT NULL),
  i AS (SELECT item_id, {_WORDS} AS t FROM benchmark WHERE text IS NOT NULL),
  k AS (SELECT count(*) AS N, sum(len(t))::BIGINT AS L FROM d WHERE len(t) > 0),
  q AS (SELECT item_id, term, count(*) AS c
    FROM (SELECT item_id, unnest(t) AS term FROM i) GROUP BY ALL),
  tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, k GROUP BY term, N),
  m AS (SELECT r, doc_id, 25 + (75 * len(t) * N) // L AS m FROM d, k WHERE len(t) > 0),
  s AS (SELECT item_id, doc_id, r,
      sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
  o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id
      ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 10""")
def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
