"""SimHash near-dedup by anchor-point covering.

A fingerprint is cut into blocks. The anchors of a block are the words of a perfect Hamming
code of covering radius 1 (on the longest 2^r - 1 bits that fit) with the left-over bits as
they are. With m blocks, two fingerprints at most 2m - 1 bits apart differ by one bit at most
in some block. Every fingerprint therefore goes to all anchors within covering radius plus
one of each block; its nearest anchor is its home. Homes are compared with everything at
their anchor, so every pair within 2m - 1 bits meets.

Only a spanning forest of the links found in a batch leaves a task: links that join what is
joined already add nothing to the groups. Equal fingerprints count as one.

``fingerprint_classes``: one row per row of the table; a text without words (null, empty,
blank) has fingerprint zero and is linked like any other. ``near_duplicates`` below checks the
links of fingerprints on the whole texts and finds those further apart by shingles. Both give an empty result for an empty table, keep repeated rows as the texts they
repeat, and use no column but doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.llm.components import components
from tracefold.sources.sinks import stored

#: Pairs that a task compares at once.
COMPARE_AT_ONCE = 1_000_000


@dataclass(frozen=True)
class Block:
    """Bits [low, low + width) of a fingerprint; ``code`` of them carry the Hamming code."""
    low: int
    width: int

    @property
    def code(self) -> int:
        return (1 << (self.width + 1).bit_length() - 1) - 1

    def anchors(self, bits: np.ndarray) -> np.ndarray:
        """[n, k] anchors of block values: the home first, then all within radius + 1.

        Flipping one bit and decoding reaches exactly the code words at distance 2 or less;
        an anchor that is reached twice is given as the home again.
        """
        flips = np.concatenate([[0], 1 << np.arange(self.width, dtype=np.uint64)]).astype(np.uint64)
        near = bits[:, None] ^ flips[None]
        syndrome = np.zeros(near.shape, np.uint64)
        for place in range(1, self.code + 1):
            syndrome ^= (near >> np.uint64(place - 1) & np.uint64(1)) * np.uint64(place)
        error = np.where(syndrome > 0, np.uint64(1) << (np.maximum(
            syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        near ^= error
        order = np.sort(near[:, 1:], axis=1)
        again = np.zeros(order.shape, bool)
        again[:, 1:] = order[:, 1:] == order[:, :-1]
        again |= order == near[:, :1]
        return np.concatenate([near[:, :1], np.where(again, near[:, :1], order)], axis=1)


def even_blocks(bits: int, count: int) -> list[Block]:
    edges = [bits * i // count for i in range(count + 1)]
    return [Block(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_values(words: np.ndarray, block: Block) -> np.ndarray:
    """The bits of one block out of [n, w] 64-bit words."""
    word, shift = divmod(block.low, 64)
    out = words[:, word] >> np.uint64(shift)
    if shift + block.width > 64:
        out = out | words[:, word + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << block.width) - 1)


def _matrix(part: pd.DataFrame, letter: str) -> np.ndarray:
    """The 64-bit columns ``letter`` 0, 1, ... as one matrix."""
    names = [c for c in part.columns if c[0] == letter and c[1:].isdigit()]
    return np.stack([part[c].to_numpy() for c in names], axis=1).view(np.uint64)


def anchor_rows(marks: DataFrame, blocks: list[Block]) -> DataFrame:
    """``marks`` (node, w0, ... [, s0, ...]) at all their anchors: key, home, same columns."""
    names = marks.columns

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in C.chunks(len(part), 2000):
                some = part.iloc[at].reset_index(drop=True)
                words = _matrix(some, "w")
                for number, block in enumerate(blocks):
                    anchors = block.anchors(block_values(words, block))
                    home = np.zeros(anchors.shape, bool)
                    home[:, 0] = True
                    keep = home | (anchors != anchors[:, :1])
                    row, _ = np.nonzero(keep)
                    key = anchors[keep] | np.uint64(number) << np.uint64(block.width)
                    out = some.iloc[row].reset_index(drop=True)
                    yield out.assign(key=key.astype(np.int64), home=home[keep])

    return marks.mapInPandas(
        spread, ", ".join(f"{n} long" for n in names) + ", key long, home boolean")


def forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int] | None = None) -> np.ndarray:
    """Which edges, in the given order, join what was apart (union-find), going on from
    ``parent`` if it is given."""
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out[i] = True
    return out


def forests_of(links: pd.DataFrame, count: int) -> Iterator[pd.DataFrame]:
    """``count`` disjoint spanning forests of ``links`` (a, b, apart), closest links first."""
    links = links.drop_duplicates().sort_values(["apart", "a", "b"], kind="stable")
    for _ in range(count):
        joins = forest(links["a"].to_numpy(), links["b"].to_numpy())
        yield links[joins]
        links = links[~joins]


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def anchor_links(marks: DataFrame, blocks: list[Block], most_apart: int,
                 sketch_apart: int | None = None, forests: int = 1) -> DataFrame:
    """Links (a, b) between nodes at most ``most_apart`` bits apart, compared per anchor.

    With ``sketch_apart`` a link must also have sketches at most so many bits apart. One
    forest keeps the groups of all links; where a later check may refuse links, several
    disjoint ``forests`` of the closest ones leave each dropped link so many ways around.
    """
    rows = anchor_rows(marks, blocks)
    rows = rows.repartition("key").sortWithinPartitions("key", F.desc("home"))

    def compared(part: pd.DataFrame) -> pd.DataFrame | None:
        key, home = part["key"].to_numpy(), part["home"].to_numpy()
        node, words = part["node"].to_numpy(), _matrix(part, "w")
        sketch = _matrix(part, "s") if sketch_apart is not None else None
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([starts, [len(key)]]))
        group = np.repeat(np.arange(len(starts)), size)
        homes = np.flatnonzero(home & (size[group] > 1))
        found: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(homes):
            many = np.cumsum(size[group[homes[at:at + COMPARE_AT_ONCE]]])
            n = max(1, int(np.searchsorted(many, COMPARE_AT_ONCE, "right")))
            some = homes[at:at + n]
            at += n
            count = size[group[some]]
            left = np.repeat(some, count)
            inside = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            right = starts[group[left]] + inside
            # a pair of homes is met from both sides
            keep = (node[left] != node[right]) & (~home[right] | (left < right))
            left, right = left[keep], right[keep]
            apart = bits_apart(words[left], words[right])
            keep = apart <= most_apart
            left, right, apart = left[keep], right[keep], apart[keep]
            if sketch is not None and len(left):
                apart = bits_apart(sketch[left], sketch[right])
                keep = apart <= sketch_apart
                left, right, apart = left[keep], right[keep], apart[keep]
            if len(left):
                found.append((node[left], node[right], apart))
        if not found:
            return None
        a, b, apart = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.concat(forests_of(pd.DataFrame(
            {"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": apart}), forests))

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for part in parts:
            last = part["key"].iloc[-1] if len(part) else None
            whole = int(np.searchsorted(part["key"].to_numpy(), last, "left"))
            if whole:  # the last key may go on in the next batch
                out = compared(pd.concat([*rest, part.iloc[:whole]], ignore_index=True))
                rest = []
                if out is not None:
                    yield out
            rest.append(part.iloc[whole:])
        if rest:
            out = compared(pd.concat(rest, ignore_index=True))
            if out is not None:
                yield out

    return rows.mapInPandas(compare, "a long, b long, apart long")


# ---------------------------------------------------------------- fingerprints of shingles


def shingles(text: str, width: int) -> list[bytes]:
    """Shingles of words (A-Z lower-cased, parted by ASCII white space), with repeats."""
    words = text.encode("utf-8").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(width)), strict=False)]


def simhash64(text: str, width: int = 3) -> int:
    """Bit set where more than half of the shingles' XXH64 (seed 42) have it set."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = [digest(s, 42) for s in shingles(text, width)]
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_classes(docs: DataFrame, width: int = 3, most_apart: int = 2) -> DataFrame:
    """doc_id, fingerprint (long) and component_id: the smallest doc_id that is linked."""
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t or "", width) for t in texts],
                                  np.uint64).astype(np.int64))

    marked = stored(docs.select("doc_id", fingerprint("text").alias("fingerprint")),
                    "fingerprints")
    classes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    blocks = even_blocks(64, most_apart // 2 + 1)
    links = stored(anchor_links(classes.select(
        F.col("fingerprint").alias("node"), F.col("fingerprint").alias("w0")),
        blocks, most_apart), "links")
    labels = components(links)
    joined = labels.join(classes, F.col("node") == F.col("fingerprint"))
    first = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = stored(labels.join(first, "label").select("node", "component_id"), "linked")
    mapping = stored(classes.join(linked, F.col("node") == F.col("fingerprint"), "left").select(
        "fingerprint", F.coalesce("component_id", "first").alias("component_id")), "mapping")
    return marked.join(mapping, "fingerprint").select("doc_id", "fingerprint", "component_id")


@C.query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_classes(C.table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


# ------------------------------------------------------- near duplicates by shingle likeness

SHINGLE, LIKENESS = 5, 0.8
#: Texts whose shingles are counted to tell common ones, and how many of those are kept. They
#: only set the order of shingles: any order finds the same pairs.
COUNTED_TEXTS, COMMON_SHINGLES = 5_000, 200_000
#: Against rounding: a bound is never taken higher than it is.
SLACK = 1e-6
#: Cells of a sketch, which counts the shingles of a text by their lowest bits; a cell of FULL or
#: more has no known count. Pairs of sketches that a task holds at once.
SKETCH, FULL, SKETCHES_AT_ONCE = 256, 255, 20_000


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 0) for s in shingles(text, width)], np.uint64))


def likeness(a: str, b: str, width: int = SHINGLE) -> float:
    """Jaccard likeness of the shingle sets; two texts without words are alike."""
    x, y = shingle_hashes(a, width), shingle_hashes(b, width)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sketch_of(hashes: np.ndarray) -> bytes:
    cells = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.minimum(cells, FULL).astype(np.uint8).tobytes()


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that a sample of the texts repeats."""
    one_in = max(1, docs.count() // COUNTED_TEXTS)

    def hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [shingle_hashes(t, width) for t in part["text"]]
            yield pd.DataFrame({"hash": np.concatenate([np.zeros(0, np.uint64), *found]).view(
                np.int64)})

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(
        F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).mapInPandas(hashes, "hash long").groupBy(
        "hash").agg(F.count("*").alias("n")).where("n > 1").orderBy(
        F.desc("n"), "hash").limit(COMMON_SHINGLES).toPandas()
    known = rows["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], rows["n"].to_numpy(np.int64)[order]


def rarest_first(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The same hashes, those that are not common first."""
    known, count = common
    if not len(known):
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return hashes[np.lexsort((hashes, np.where(known[at] == hashes, count[at], 0)))]


def prefix_length(n: int, least: float) -> int:
    """How many shingles, rarest first, hold the first one shared with any text so alike."""
    return n - int(np.ceil(least * n - SLACK)) + 1 if n else 0


def may_be_alike(n: np.ndarray, m: np.ndarray, at: np.ndarray, to: np.ndarray,
                 least: float) -> np.ndarray:
    """Whether sets of n and m shingles can be alike if ``at`` and ``to`` are the places of
    the first one they share: all they share comes from there on."""
    needed = least / (1 + least) * (n + m) - SLACK
    return (n - at >= needed) & (m - to >= needed)


def whole_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by key, cut so that no key goes on in the next one."""
    rest: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        whole = int(np.searchsorted(part["key"].to_numpy(), part["key"].iloc[-1], "left"))
        if whole or rest and rest[-1]["key"].iloc[-1] != part["key"].iloc[0]:
            yield pd.concat([*rest, part.iloc[:whole]], ignore_index=True)
            rest = []
        rest.append(part.iloc[whole:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def group_numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of every row, rows of every group) of sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([starts, [len(keys)]]))
    return np.repeat(np.arange(len(starts)), size), size


def meetings(entries: DataFrame, least: float) -> DataFrame:
    """``entries`` (key, node, n, at) that share their key, with the neighbour in order of size
    that may be alike (``near``, null if none): one link a row, however large the group."""
    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(parts):
            group, size = group_numbers(part["key"].to_numpy())
            part = part[size[group] > 1].reset_index(drop=True)
            key, node = part["key"].to_numpy(), part["node"].to_numpy()
            n, at = part["n"].to_numpy(), part["at"].to_numpy()
            near = np.zeros(len(part), bool)
            near[1:] = (key[1:] == key[:-1]) & may_be_alike(n[1:], n[:-1], at[1:], at[:-1], least)
            yield part.assign(near=pd.Series(np.roll(node, 1), dtype="Int64").where(near))

    return entries.repartition("key").sortWithinPartitions("key", "n", "node").mapInPandas(
        meet, "key long, node long, n int, at int, near long")


def may_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most shingles that texts of these sketches (a row each) can share."""
    least = np.minimum(x, y).astype(np.int64)
    return np.where(least == FULL, 1 << 40, least).sum(axis=1)


def meeting_links(met: DataFrame, least: float, forests: int = 1) -> DataFrame:
    """Links (key, a, b) between entries (key, node, n, at, label, sketch, other) that may be
    alike and have different labels: ``forests`` disjoint spanning forests of the labels of each
    key, so a key gives fewer links than ``forests`` times its entries.

    A row with ``other`` is no entry: it says that node and other have been found not alike.
    Entries of a key's most frequent label are not compared with each other.
    """
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(parts):
            is_entry = whole["other"].isna()
            refused = whole.loc[~is_entry, ["key", "node", "other"]].astype("int64").rename(
                columns={"node": "a", "other": "b"}).drop_duplicates()
            part = whole[is_entry]
            if not len(part):
                continue
            key = part["key"].to_numpy()
            node, label = part["node"].to_numpy(), part["label"].to_numpy().astype(np.int64)
            n, at = part["n"].to_numpy().astype(np.int64), part["at"].to_numpy()
            sketch = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(-1, SKETCH)
            group, _ = group_numbers(key)
            named = pd.DataFrame({"group": group, "label": label})
            place_of = named.groupby(["group", "label"], sort=False).ngroup().to_numpy()
            counts = named.value_counts(["group", "label"]).reset_index()
            most = counts.drop_duplicates("group").set_index("group")["label"]
            home = label != most.reindex(group).to_numpy()
            rows = np.flatnonzero(home)
            place = group << 32 | n  # rows are sorted by it
            low = np.searchsorted(place, group[rows] << 32 | np.ceil(
                least * n[rows] - SLACK).astype(np.int64), "left")
            high = np.searchsorted(place, group[rows] << 32 | np.floor(
                n[rows] / least + SLACK).astype(np.int64), "right")
            joined: list[dict[int, int]] = [{} for _ in range(forests)]
            done = 0
            while done < len(rows):
                many = np.cumsum((high - low)[done:done + COMPARE_AT_ONCE])
                take = slice(done, done + max(1, int(np.searchsorted(
                    many, COMPARE_AT_ONCE, "right"))))
                done = take.stop
                count = (high - low)[take]
                left = np.repeat(rows[take], count)
                right = np.arange(len(left)) - np.repeat(
                    np.cumsum(count) - count - low[take], count)
                keep = (label[left] != label[right]) & (~home[right] | (left < right))
                left, right = left[keep], right[keep]
                keep = may_be_alike(n[left], n[right], at[left], at[right], least)
                left, right = left[keep], right[keep]
                spare = np.concatenate([np.zeros(0, np.float64), *(
                    may_share(sketch[left[c]], sketch[right[c]])
                    - least / (1 + least) * (n[left[c]] + n[right[c]])
                    for c in C.chunks(len(left), SKETCHES_AT_ONCE))])
                keep = spare >= -SLACK
                left, right, spare = left[keep], right[keep], spare[keep]
                links = pd.DataFrame({
                    "key": key[left], "a": np.minimum(node[left], node[right]),
                    "b": np.maximum(node[left], node[right]), "x": place_of[left],
                    "y": place_of[right], "spare": spare, "gap": np.abs(left - right)})
                if len(refused) and len(links):
                    links = links.merge(refused, how="left", indicator="known")
                    links = links[links.pop("known") == "left_only"]
                # chains rather than stars: no text is in very many links
                links = links.sort_values(["spare", "gap", "a", "b"],
                                          ascending=[False, True, True, True])
                for parent in joined:
                    joins = forest(links["x"].to_numpy(), links["y"].to_numpy(), parent)
                    if joins.any():
                        yield links.loc[joins, ["key", "a", "b"]]
                    links = links[~joins]

    return met.repartition("key").sortWithinPartitions("key", "n", "node").mapInPandas(
        compare, "key long, a long, b long")


def fingerprint_links(texts: DataFrame, most_apart: int = 2) -> DataFrame:
    """Links (a, b) of ``texts`` (node, fingerprint) whose SimHash differs in ``most_apart`` bits
    at most: a chain of the texts with equal fingerprints, and the anchors' links of their firsts.
    """
    order = Window.partitionBy("fingerprint").orderBy("node")
    chain = texts.select(F.col("node").alias("b"), F.lag("node").over(order).alias("a")).where(
        "a is not null").select("a", "b")
    firsts = stored(texts.groupBy("fingerprint").agg(F.min("node").alias("node")).select(
        "node", F.col("fingerprint").alias("w0")), "classes")
    return chain.unionByName(anchor_links(firsts, even_blocks(64, most_apart // 2 + 1),
                                          most_apart).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE,
                    least: float = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """(texts, groups): digest, node, first text id of every different text; node, label of
    those that are linked, directly or through others, by a likeness of ``least`` or more.

    SimHash gives the first links (fingerprints at most two bits apart), each checked on the
    whole texts. Texts that an edit of some length put further apart meet at shingles: with all
    shingles in one order (rarest first), two texts so alike share a shingle within their
    prefixes, and its places and the sketches bound what they can share. Neighbours in size at
    every shingle are checked first, then forests of the links between groups still apart, in
    rounds: links that hold join their groups, others are not tried again, until none is left.
    So every pair so alike ends in one group. A pair is checked once, and a shingle remembers
    the links refused of those it gave itself, never all refused pairs that share it: no table
    is longer than the links given, a few for each text at a shingle. A null text counts as
    empty.
    """
    text = F.coalesce("text", F.lit(""))
    common = common_shingles(docs, width)

    @F.pandas_udf("n int, prefix array<long>, sketch binary, fingerprint long")
    def marks(texts: pd.Series) -> pd.DataFrame:
        sets = [rarest_first(shingle_hashes(t, width), common) for t in texts]
        return pd.DataFrame({
            "n": [len(s) for s in sets],
            "prefix": [s[:prefix_length(len(s), least)].view(np.int64) for s in sets],
            "sketch": [sketch_of(s) for s in sets],
            "fingerprint": np.array([simhash64(t) for t in texts], np.uint64).view(np.int64)})

    texts = stored(docs.select("doc_id", F.md5(text).alias("digest"), marks(text).alias(
        "marks")).groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.any_value("marks").alias("marks")).select(
        F.monotonically_increasing_id().alias("node"), "digest", "first", "marks.*"), "texts")
    met = stored(meetings(texts.select("node", "n", F.posexplode("prefix").alias("at", "key")
                                       ).select("key", "node", "n", "at"), least), "meetings")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y, width) for x, y in zip(a, b, strict=True)], dtype=float)

    def checked(links: DataFrame) -> DataFrame:
        # the whole texts of linked documents, once each, for the exact check
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(
            F.col("b").alias("node"))).distinct()
        wanted = texts.select("node", "digest").join(ends, "node")
        whole = stored(docs.select(F.md5(text).alias("digest"), text.alias("text")).join(
            wanted, "digest").dropDuplicates(["node"]).select("node", "text"), "linked-texts")
        left = whole.select(F.col("node").alias("a"), F.col("text").alias("x"))
        right = whole.select(F.col("node").alias("b"), F.col("text").alias("y"))
        return stored(links.join(left, "a").join(right, "b").select(
            "a", "b", (alike("x", "y") >= least).alias("holds")), "checked-links")

    @F.pandas_udf("boolean")
    def sketches_allow(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SKETCH) for s in (x, y))
        return pd.Series(may_share(left, right)
                         >= least / (1 + least) * (n + m).to_numpy() - SLACK)

    def possible(links: DataFrame) -> DataFrame:
        """Links that the sketches of both texts allow to hold."""
        for end, size, sketch in (("a", "n", "x"), ("b", "m", "y")):
            links = links.join(texts.select(F.col("node").alias(end), F.col("n").alias(size),
                                            F.col("sketch").alias(sketch)), end)
        return links.where(sketches_allow("n", "m", "x", "y")).select("a", "b")

    def between_groups(links: DataFrame, labels: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(
                f"of_{end}")), end, "left")
        return links.withColumns({f"of_{end}": F.coalesce(f"of_{end}", end) for end in (
            "a", "b")}).where("of_a <> of_b")

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """``labels`` after joining the groups that ``links`` join."""
        joined = components(between_groups(links, labels).select(
            F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        higher = joined.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        return stored(labels.join(higher, "label", "left").select(
            "node", F.coalesce("higher", "label").alias("label")).unionByName(
            joined.join(labels, "node", "left_anti")), "groups")

    # texts without words have no shingle to meet at; all are alike
    blank = texts.where("n = 0")
    blank = blank.crossJoin(blank.agg(F.min("node").alias("b"))).select(
        F.col("node").alias("a"), "b").where("a <> b")
    first = checked(stored(fingerprint_links(texts.select("node", "fingerprint")).distinct(),
                           "fingerprint-links"))
    labels = components(first.where("holds").select("a", "b").unionByName(blank))
    given = met.where("near IS NOT NULL").select(
        "key", F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b"))
    near = between_groups(given.select("a", "b").distinct(), labels).select("a", "b")
    tried = checked(stored(possible(near).join(first, ["a", "b"], "left_anti"), "near-links"))
    labels = merged(labels, tried.where("holds"))
    verdicts, forests = first.select("a", "b", "holds").unionByName(tried), 1
    refused = stored(given.join(verdicts.where("not holds"), ["a", "b"]).select(
        "key", "a", "b"), "refused")
    entries = met.drop("near")
    while True:
        labelled = entries.select("key", "node", "n", "at").join(labels, "node", "left").select(
            "key", "node", "n", "at", F.coalesce("label", "node").alias("label"))
        # two entries of a key are neighbours, which have been checked
        apart = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias(
            "high"), F.count(F.lit(1)).alias("held")).where(
            "low <> high and held > 2").select("key")
        entries = stored(labelled.join(apart, "key"), "entries-apart")
        rows = entries.join(texts.select("node", "sketch"), "node").unionByName(
            refused.join(apart, "key", "left_semi").select(
                "key", F.col("a").alias("node"), F.col("b").alias("other")),
            allowMissingColumns=True)
        links = stored(meeting_links(rows, least, forests), "links-apart")
        if links.isEmpty():
            return texts, labels
        tried = checked(stored(links.select("a", "b").distinct().join(
            verdicts, ["a", "b"], "left_anti"), "new-links"))
        labels = merged(labels, tried.where("holds"))
        verdicts = verdicts.unionByName(tried)
        # a key without links has none left
        entries = entries.join(links.select("key").distinct(), "key")
        refused = stored(refused.unionByName(links.join(
            verdicts.where("not holds"), ["a", "b"]).select("key", "a", "b")), "refused")
        forests *= 4


def remove_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of copies and near copies: the smallest doc_id's."""
    columns = docs.columns
    texts, groups = near_duplicates(docs)
    tagged = texts.select("node", "digest", "first").join(groups, "node", "left").select(
        F.coalesce("label", "node").alias("label"), "digest", "first")
    stays = stored(tagged.groupBy("label").agg(F.min(F.struct(
        F.col("first").isNull().alias("none"), "first", "digest")).alias("kept")).select(
        F.col("kept.digest").alias("_digest"), F.col("kept.first").alias("_first")), "stays")
    return docs.withColumn("_digest", F.md5(F.coalesce("text", F.lit("")))).join(
        stays, "_digest").where(F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(
        ["_digest"]).select(columns)
