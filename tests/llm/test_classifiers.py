"""Quality, toxicity and language: held-out accuracy, edge cases, parts of the methods."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import tables as T
from tracefold.llm import common as C
from tracefold.llm import language, quality, toxicity

SF = "/root/testdata/sf0.1"


def held(df, spark, columns):
    known = C.table(spark, SF, "documents").select("doc_id", *columns["documents"]).join(
        C.table(spark, SF, "labels").select("doc_id", *columns["labels"]), "doc_id")
    return df.join(known, "doc_id").where("held_out").toPandas()


def test_quality_on_held_out_rows(spark):
    rows = held(quality.op3_quality(spark, SF), spark, {"documents": [], "labels": ["quality"]})
    assert ((rows["quality"] == 1) == rows["keep"]).mean() > 0.97
    assert rows[rows["quality"] == 1]["keep"].mean() > 0.99
    assert rows["expected_grade"].between(0, 2).all()


def test_toxicity_on_held_out_rows(spark):
    rows = held(toxicity.op2_toxicity(spark, SF), spark, {"documents": [], "labels": ["toxic"]})
    toxic = rows["toxic"] == 1
    assert (rows[toxic]["predicted"] == 1).mean() > 0.85
    assert (rows[~toxic]["predicted"] == 1).mean() < 0.02
    assert rows["score"].between(0, 1).all()


def test_language_on_held_out_rows(spark):
    out = language.op6_language(spark, SF)
    rows = out.join(C.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where(
        "held_out").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_ordinal_thresholds_are_ordered_and_tails_fall():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5)).astype(np.float32)
    grade = np.digitize(x @ np.array([2, -1, 0, 0.5, 0]) + rng.logistic(size=600), [-1, 0.5, 2])
    model = quality.fit_ordinal(x, grade)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(x)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert abs((tails.sum(1)).mean() - grade.mean()) < 0.1
    assert quality.fit_ordinal(x, np.zeros(600, int)) is None


@pytest.mark.parametrize("k", [0, 1, 2, 4, 6, 7, 30])
def test_codewords_are_apart(k):
    words = language.codewords(k)
    assert words.shape[0] == k
    if k > 1:
        apart = (words[:, None] != words[None]).sum(2)[~np.eye(k, dtype=bool)]
        assert apart.min() >= (1 if k == 2 else 2)


def test_fold_undoes_disguises():
    assert toxicity.fold("You 1d10t!") == " you idiot "
    assert toxicity.fold("ѕtuріd") == " stupid "
    assert toxicity.fold("ＭＯＲＯＮ m​oron móron") == " moron moron moron "
    assert toxicity.fold("$tup1d 100 $$$ 4") == " stupid "
    assert toxicity.fold("") == "  "


def test_exception_phrase_voids_a_hit():
    automaton = toxicity.matcher({" trash ": 3.0, " idiot ": 2.0}, ("trash can",))
    assert toxicity.match_features("the trash can is full", automaton)[0] == 0
    assert toxicity.match_features("trash talk", automaton)[2] == 3.0
    total, dense, top = toxicity.match_features("trash can, idiot", automaton)
    assert (round(np.expm1(total), 6), top) == (2.0, 2.0) and dense > 0


def test_entries_of_copied_passages_are_not_learned(spark):
    passage = "always the same blorgword here"
    rows = [(i, f"{passage} {T.prose(i, 30)}", True) for i in range(40)]
    rows += [(100 + i, f"{T.prose(500 + i, 15)} frobnik {T.prose(900 + i, 15)}", True)
             for i in range(60)]
    rows += [(1000 + i, T.prose(2000 + i, 30), False) for i in range(400)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    found = toxicity.learned_lexicon(sample)
    assert any("frobnik" in e for e in found) and not any("blorg" in e for e in found)


def test_edge_rows_and_extra_columns(spark):
    docs = T.odd_documents(spark).withColumns({
        c: F.lit("x") for c in ("score", "keep", "lang_pred", "tail_probability", "predicted")})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    graded = quality.classify(docs, quality.train(docs, quality.label_grades(none))).toPandas()
    assert len(graded) == 11 and set(graded[graded["text"].isna()]["keep"]) == {False}
    scored = toxicity.score(docs, toxicity.train(docs, none)).toPandas()
    assert len(scored) == 11 and (scored["predicted"] == 0).all()
    spoken = language.identify(docs, language.train(docs)).toPandas()
    assert set(spoken[spoken["text"].isna() | (spoken["doc_id"] == 6)]["lang_pred"]) == {"und"}
    twice = spoken[spoken["doc_id"] == 5]
    assert len(twice) == 2 and twice["score"].nunique() == 1
    assert set(language.identify(docs, None).toPandas()["lang_pred"]) == {"und"}


def test_empty_tables(spark):
    docs = T.empty_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, quality.train(docs, quality.label_grades(none))).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, none)).count() == 0
    assert language.identify(docs, language.train(docs)).count() == 0
