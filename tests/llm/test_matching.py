"""Decontamination, licenses, urls and the pipeline: SQL, planted cases, edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, differences
from tests.llm import tables as T
from tracefold.llm import common as C
from tracefold.llm import decontaminate, licenses, packing, queries, urls

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) == []


def benchmark(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


ASKED = ("A baker in town sold 24 loaves to Anna and 36 loaves to Boris, so how many loaves did "
         "the baker sell to Anna and Boris when every loaf weighs 2 kg in total?")


def test_reparameterised_question_is_found_and_names_must_agree(spark):
    other = ASKED.replace("24", "7.5").replace("36", "91").replace("Anna", "Olga").replace(
        "Boris", "Ivan").replace("2 kg", "9 pounds")
    one_name = ASKED.replace("Anna", "Olga", 1)  # still the item word for word elsewhere
    docs = T.documents(spark, [T.prose(1, 80) + " " + ASKED, T.prose(2, 50) + " " + other,
                               one_name, T.prose(3, 90), ASKED.lower()])
    rows = {r["doc_id"]: r for r in decontaminate.contaminated(docs, benchmark(spark, ASKED)).collect()}
    assert rows[0]["coverage"] == 1 and rows[0]["changed_slots"] == 0
    assert rows[1]["coverage"] > 0.9 and rows[1]["changed_slots"] >= 5
    assert rows[2]["coverage"] > 0.5 and rows[4]["coverage"] == 1 and 3 not in rows
    kept = decontaminate.remove_contaminated(docs, benchmark(spark, ASKED))
    assert [r["doc_id"] for r in kept.collect()] == [3]
    assert kept.columns == docs.columns


OPENING = ("Anna sold 24 loaves in May. Boris sold 36 loaves in June. Anna gave 5 loaves to Boris. "
           "How many loaves are left?")
EQUAL = ("At the fair there were 12 red apples and 12 green pears on the long table, so how many "
         "pieces of fruit did the children count before the rain came?")
GIFTS = ("then Anna gave pens to Boris and Boris lent Anna books and Anna sent Boris maps and "
         "Boris sold Anna toys")


def test_names_at_sentence_starts_equal_slots_and_drift(spark):
    opening = OPENING.replace("Anna", "Olga").replace("Boris", "Ivan").replace(
        "24", "7").replace("36", "9").replace("5", "2")
    equal = EQUAL.replace("12 red", "7 red").replace("12 green", "9 green")
    people = iter(T.WORDS)
    mixed = " ".join(next(people).capitalize() if w in ("Anna", "Boris") else w
                     for w in GIFTS.split())
    steady = GIFTS.replace("Anna", "Olga").replace("Boris", "Ivan")
    docs = T.documents(spark, [opening, equal, mixed, steady, T.prose(5, 300)])
    rows = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(
        docs, benchmark(spark, OPENING, EQUAL, GIFTS)).collect()}
    assert set(rows) == {(0, 0), (1, 1), (3, 2)}
    assert rows[0, 0]["coverage"] > 0.6 and rows[1, 1]["changed_slots"] == 2


@pytest.mark.parametrize("words", [12, 15, 23, 24, 37])
def test_one_inserted_or_deleted_word_at_any_place(spark, words):
    item = T.prose(words, words).lower().rstrip(".").split()
    edits = [item[:i] + ["extra"] + item[i:] for i in range(words + 1)]
    if words > 12:  # a twelve-word item keeps at least three of eight windows
        edits += [item[:i] + item[i + 1:] for i in range(words)]
    docs = T.documents(spark, [" ".join(e) for e in edits])
    rows = decontaminate.contaminated(docs, benchmark(spark, " ".join(item)))
    assert {r["doc_id"] for r in rows.collect()} == set(range(len(edits)))


def by_hand(text, item):
    """The best share of an item's windows in one band, window by window."""
    import re
    from collections import Counter

    def tokens(s):
        raw = re.findall(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+(?:['-][A-Za-z]+)*|[.!?:\n]", s)
        out = []
        for before, t in zip([".", *raw], raw):
            if t not in ".!?:\n":
                kind = ("<num>" if t[0].isdigit() else "<unit>" if before[0].isdigit()
                        and t.lower() in decontaminate.UNITS else "<name>" if t[0].isupper()
                        else t.lower())
                out.append((kind, t.lower()))
        return out

    a, b = tokens(item), tokens(text)
    size = 5 if 12 <= len(a) <= 23 else min(8, len(a))
    total, found = len(a) - size + 1, {}
    for i in range(total):
        for j in range(len(b) - size + 1):
            p, q = a[i:i + size], b[j:j + size]
            slots = [k for k in range(size) if p[k][0] != p[k][1]]
            same = [v for _, v in p] == [v for _, v in q]
            alike = [k for k, _ in p] == [k for k, _ in q] and 1 <= len(slots) <= size // 2
            for cell in (2 * ((j - i) // 16), 2 * ((j - i + 8) // 16) + 1):
                if same:
                    found.setdefault(cell, []).append((i, j, []))
                if alike:
                    found.setdefault(cell, []).append((i, j, [
                        (p[k][1], q[k][1]) for k in slots if p[k][0] == "<name>"]))
    best = 0
    for windows in found.values():
        votes = Counter()
        for pair, i in {(pair, i) for i, _, pairs in windows for pair in pairs}:
            votes[pair] += 1
        agreed = {}
        for (x, y), n in votes.items():
            agreed[x] = max(agreed.get(x, (0, "")), (n, y))
        best = max(best, len({i for i, _, pairs in windows
                              if all(agreed[x][1] == y for x, y in pairs)}))
    return best, total


@pytest.mark.parametrize("anchor_words", [0, 5, 128])
def test_random_edits_equal_a_plain_search(spark, monkeypatch, anchor_words):
    import random

    monkeypatch.setattr(decontaminate, "ANCHOR_WORDS", anchor_words)
    rng = random.Random(4)
    items = [ASKED, OPENING, EQUAL, GIFTS]
    texts, pairs = [], []
    for n in range(160):
        at = n % len(items)
        words = T.prose(n, 10).split() + items[at].split() + T.prose(n + 500, 10).split()
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(words))
            words[k:k + 1] = rng.choice([[], ["extra", words[k]], ["Olga"], ["17"], ["word"]])
        texts.append(" ".join(words))
        pairs.append(at)
    rows = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.contaminated(
        T.documents(spark, texts), benchmark(spark, *items)).collect()}
    want = {}
    for n, text in enumerate(texts):
        for at, item in enumerate(items):
            best, total = by_hand(text, item)
            if best >= 0.5 * total:
                want[n, at] = best
    assert rows == want and 40 < len(want) < 160


def test_tables_of_numbers_match_by_their_values(spark):
    table = "12 14 19 20 25 31 44 58 61 70"
    docs = T.documents(spark, [f"Values: {table}", "Values: 1 2 3 4 5 6 7 8 9 10"])
    rows = decontaminate.contaminated(docs, benchmark(spark, table, "Shorter than that"))
    assert [r["doc_id"] for r in rows.collect()] == [0]


def test_decontamination_edge_rows(spark):
    docs = T.odd_documents(spark).withColumn("item_id", F.lit(1)).withColumn("key", F.lit("k"))
    items = benchmark(spark, None, "", "...", T.prose(2, 60), "single")
    rows = decontaminate.contaminated(docs, items).toPandas()
    assert sorted(zip(rows["doc_id"].fillna(-1), rows["item_id"])) == [(5, 3), (7, 4)]
    assert decontaminate.contaminated(T.empty_documents(spark), items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.remove_contaminated(docs, items.where("false")).count() == 11


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    files = spark.createDataFrame([
        (1, "a/LICENSE", apache), (2, "a/b/c/x.py", T.prose(1, 300)),
        (3, "a/b/LICENSE", mit), (4, "a/y.py", T.prose(2, 300)),
        (5, "d/z.py", T.prose(3, 300) + "\n" + mit + "\n" + T.prose(4, 300)),
        (6, "d/w.py", T.prose(5, 300)), (7, None, T.prose(6, 40)), (8, "ab/q.py", None),
        (9, "top.py", ""), (2, "a/b/c/x.py", T.prose(1, 300)),
    ], "id long, path string, text string")
    rows = licenses.scan_licenses(files.withColumn("license", F.lit("?"))).toPandas()
    got = {r.id: (r.license, r.inherited_from) for r in rows.itertuples()}
    assert got[2] == ("MIT", "a/b/LICENSE") and got[4] == ("Apache-2.0", "a/LICENSE")
    assert got[5][0] == "MIT" and got[6][0] is None
    assert all(got[i][0] is None for i in (7, 8, 9)) and len(rows) == 10
    assert licenses.scan_licenses(files.where("false")).count() == 0


def test_needed_words_lose_no_sentence(spark):
    """With and without the narrowing the same sentences reach the threshold."""
    texts = ["Licensed under the License", "the public", "MIT", "under CC BY-NC 4.0 terms",
             "Version 3 of the GNU license", T.prose(1, 10)]
    files = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)],
                                  "id long, path string, text string")
    narrowed = licenses.scan_licenses(files).select("id", "own_license", "own_score").collect()
    real = licenses.needed_words
    try:
        licenses.needed_words = lambda *_: ["[a-z]+", "[0-9]+"]
        everything = licenses.scan_licenses(files).select(
            "id", "own_license", "own_score").collect()
    finally:
        licenses.needed_words = real
    assert sorted(map(tuple, narrowed), key=str) == sorted(map(tuple, everything), key=str)


def test_words_glued_to_digits_are_not_lost(spark):
    texts = ["CC0", "BSD3", "Apache2.0", "some words first\nApache2.0\nand some after",
             "GPL3", "1.4.0", "4.0cc", T.prose(1, 10)]
    files = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)],
                                  "id long, path string, text string")
    narrowed = {r["id"]: r["own_license"] for r in licenses.scan_licenses(files).collect()}
    assert narrowed[0] == "CC0-1.0"
    real = licenses.needed_words
    try:
        licenses.needed_words = lambda *_: ["[a-z]+", "[0-9]+"]
        everything = {r["id"]: r["own_license"] for r in licenses.scan_licenses(files).collect()}
    finally:
        licenses.needed_words = real
    assert narrowed == everything


def test_urls_edge_rows(spark):
    pages = spark.createDataFrame([
        (1, None), (2, ""), (3, "no scheme.net/en"), (4, "http://Example.NET/en/a?b#c"),
        (5, "https://net/x"), (6, "ftp://a.net"), (7, "http://x.example.com/de/1"),
        (8, "http://m.casino-win.org/fr/"), (9, "http://m.casino-win.org/en/"),
        (9, "http://m.casino-win.org/en/"), (None, "http://notexample.net/en/"),
        (10, "x" * 100_000 + "://a.net/" + "y" * 100_000), (11, "http://a.net?u=http://b.org/fr/"),
    ], "page_id long, url string").withColumn("rule", F.lit("?"))
    rows = urls.filter_urls(pages, urls.HOST_RULES + urls.PATTERN_RULES).toPandas()
    assert len(rows) == 13
    got = {r.page_id: r for r in rows.itertuples()}
    assert all((got[i].host, got[i].path, got[i].verdict) == ("", "", "allow") for i in (1, 2, 3))
    assert (got[4].host, got[4].path, got[4].rule) == ("example.net", "/en/a", "example.net/en/")
    assert (got[5].rule, got[5].verdict) == ("net/", "block")
    assert got[6].rule is None and got[11].rule is None  # an empty path starts with no "/"
    assert got[7].verdict == "block" and got[8].verdict == "allow"
    assert (got[9].rule, got[9].pattern_rule, got[9].verdict) == (None, "casino", "block")
    assert rows[rows["page_id"].isna()]["rule"].tolist() == ["net/"]
    assert got[10].rule == "net/"
    assert urls.filter_urls(pages.where("false"), urls.HOST_RULES).count() == 0


def test_rule_without_literals_is_still_tried(spark):
    pages = spark.createDataFrame([(1, "http://a1.net/"), (2, "http://b.org/")],
                                  "page_id long, url string")
    rules = [urls.Rule("digit", "block", r"[0-9]"), *urls.HOST_RULES]
    rows = urls.filter_urls(pages, rules).toPandas().set_index("page_id")
    assert rows["pattern_rule"].tolist() == ["digit", None]


def pipeline_by_hand(spark, folder):
    """The same stages, each checked on its own input."""
    docs = C.table(spark, folder, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        ids, before = kept.toPandas(), docs.toPandas()
        assert set(ids["doc_id"].dropna()) <= set(before["doc_id"].dropna())
        path = f"{folder}/stage-{name}.parquet"
        kept.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(len(ids))
    return docs, sizes


def test_pipeline_on_planted_cases(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        T.save(spark, C.table(spark, SF, name), tmp_path, name)
    item = C.table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    base = C.table(spark, SF, "documents").where(
        "lang = 'en' AND n_chars BETWEEN 2000 AND 4000").orderBy("doc_id").limit(3).collect()
    fresh = [" ".join(r["text"].split()[::-1]) + "." for r in base]
    near = fresh[0].split()
    near[100] = "other"
    rows = [(10_000, fresh[0]), (10_001, fresh[0]), (10_002, " ".join(near)),
            (10_003, fresh[1] + "\n" + item + "\n" + fresh[1][:300]),
            (10_004, fresh[2].replace(" the ", " the stupid idiot ", 6))]
    planted = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], T.DOCUMENTS)
    T.save(spark, C.table(spark, SF, "documents").unionByName(planted), tmp_path, "documents")
    kept, sizes = pipeline_by_hand(spark, str(tmp_path))
    left = {r["doc_id"] for r in kept.where("doc_id >= 10000").collect()}
    assert left == {10_000}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_pipeline_edge_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    T.save(spark, none, tmp_path, "labels")
    T.save(spark, benchmark(spark, "nothing of that kind here at all, is there now"), tmp_path,
           "benchmark")
    T.save(spark, T.empty_documents(spark), tmp_path, "documents")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    T.save(spark, T.odd_documents(spark), tmp_path, "documents")
    rows = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(rows["doc_id"].dropna()) == {4, 5, 6, 7, 8}
    assert set(rows.columns) >= {"sequence_id", "offset", "ids_crc32"}
    assert packing.SEQUENCE == 1024


def test_extra_columns_pass_all_stages_unchanged(spark, tmp_path):
    """Names that the operators use themselves, and one that a stage's own renaming uses."""
    from pyspark.sql import functions as F

    for name in ("documents", "labels", "benchmark"):
        T.save(spark, C.table(spark, SF, name), tmp_path, name)
    names = ["keep", "score", "predicted", "_first", "_digest", "_key", "label", "node",
             "extra column 1", "found"]
    docs = C.table(spark, SF, "documents")
    more = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).select("doc_id").collect()}
        rows = stage(spark, more, str(tmp_path))
        assert rows.columns == more.columns, name
        assert {r["doc_id"] for r in rows.collect()} == plain
        wrong = [F.col(f"`{n}`") != F.concat(F.lit(n), F.col("doc_id").cast("string"))
                 for n in names]
        bad = wrong[0]
        for w in wrong[1:]:
            bad = bad | w
        assert rows.where(bad).isEmpty(), name
    assert corpus_pipeline.packed(spark, more, str(tmp_path)).count() > 0
