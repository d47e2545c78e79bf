"""Containment through rare grams against a plain loop."""

import random

from corpusweave.operators import containment
from corpusweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TEXT = "id long, text string"


def found(spark, texts, needles):
    rows = containment.contained_texts(
        spark.createDataFrame(list(enumerate(texts)), TEXT).withColumnRenamed("id", "doc"),
        spark.createDataFrame(list(enumerate(needles)), TEXT).withColumnRenamed("id", "item"),
        "doc", "item",
    ).collect()
    assert len(rows) == len(set(rows))
    return {(r.doc, r.item) for r in rows}


def plain(texts, needles):
    return {(i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if t and n and n in t}


def test_needles_of_every_length(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += [None, "", "a", "é" * 3000, "common passage " * 40, texts[3]]
    # common to all, so that only rare grams tell needles apart
    texts = [t and t + "a sentence that stands at the end of all texts" for t in texts]
    needles = [t[k : k + n] for t in texts if t for n in (1, 2, 3, 7, 8, 15, 16, 31, 32, 33, 90) for k in (rng.randint(0, 40),)]
    needles = rng.sample(needles, 200) + [None, "", "never there", "é" * 40, "sentence that stands at the end of all", "x" * 4000]
    assert found(spark, texts, needles) == plain(texts, needles)


def test_empty_tables(spark):
    assert found(spark, [], ["a"]) == found(spark, ["a"], []) == set()


def test_plan_has_no_pairs(spark):
    text = QUERIES["contain_texts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
