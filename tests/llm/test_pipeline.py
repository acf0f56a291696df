"""The pipeline's stages: each does its work on what the last one kept, and clean documents stay."""

import random
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from quorate.llm import jaccard, language, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10**9, "12 34", "en", "src1", 5), (10**9 + 1, None, "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    stage = [f for _, f in P.STAGES]
    columns = docs.columns
    one = stage[0](spark, docs, SF).cache()
    pred = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, p in pred.items() if p != "und") and one.columns == columns
    two = stage[1](spark, one, SF).cache()
    classes = jaccard.brute_force([(r["doc_id"], r["text"]) for r in one.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for _, c in classes.values()}) and two.columns == columns
    three = stage[2](spark, two, SF).cache()
    assert three.columns == columns and three.count() == two.count()
    assert not [r for r in three.collect() if any(k == "email" for _, k, _ in pii.base_spans(r["text"]))]
    assert three.where(F.length("text") != F.col("n_chars")).count() == 0
    four = stage[3](spark, three, SF).cache()
    assert four.columns == columns and max(Counter(r["doc_id"] for r in four.collect()).values()) <= 2
    five = stage[4](spark, four, SF).collect()
    assert Counter(r["doc_id"] for r in five if r["piece"] == 0) == Counter(r["doc_id"] for r in four.collect())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in P.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0


def test_awkward_rows(spark):
    """Null ids, sources and texts, repeated rows and ids, a column of a stage's own name: each stage keeps its columns."""
    words = "the house near a river stands by some bread that lies on our town below the hill while two of them run past".split()
    text = lambda k: " ".join(random.Random(k).choices(words, k=60)) + f" number {k}"
    rows = [(k, text(k), "en", ["a", None][k % 2], 1, "x") for k in range(24)]
    rows += [(24, None, "en", "a", None, "x"), (25, "", None, None, 0, "x"), (26, "12 34", "en", "a", 5, "x"), (3, text(3), "en", None, 1, "x"), (3, text(40), "en", "a", 1, "y"), (None, text(50), None, None, None, "x"), (None, text(51), "en", "a", 1, "x"), (None, text(51), "en", "b", 1, "x"), (None, text(9), "en", "b", 1, "x"), (27, text(5), "en", "b", 1, "x"), (28, "write to me@here.org " + text(60), "en", "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string").repartition(5)
    stage = [f for _, f in P.STAGES]
    one = stage[0](spark, docs, SF).cache()
    assert one.columns == docs.columns and one.count() == len(rows) - 3
    two = stage[1](spark, one, SF).cache()
    ids = Counter(r["doc_id"] for r in two.collect())
    # Rows of one id with different texts are documents of their own; copies go, those with null ids first.
    assert two.columns == docs.columns and ids[27] == 0 and ids[3] == 2 and ids[None] == 2 and ids[5] == 1
    assert sorted(r["text"] for r in two.where("doc_id = 3").collect()) == sorted([text(3), text(40)])
    assert sorted(r["text"] for r in two.where("doc_id IS NULL").collect()) == sorted([text(50), text(51)])
    three = stage[2](spark, two, SF).cache()
    assert three.columns == docs.columns and Counter(r["doc_id"] for r in three.collect()) == ids
    assert [r["text"] for r in three.where("doc_id = 28").collect()] == ["write to [EMAIL] " + text(60)]
    four = stage[3](spark, three, SF).cache()
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= set(ids) and four.where("source IS NULL").count() > 0
    five = stage[4](spark, four, SF).collect()
    assert Counter(r["doc_id"] for r in five if r["piece"] == 0) == Counter(r["doc_id"] for r in four.collect())
