"""Extractive text operators: tf-idf summaries, context of a name, pooling of the notes of windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quorate.functions.text import sentences
from quorate.sources.shared import lean


@F.arrow_udf(ArrayType(DoubleType()))
def _weighed(texts: pa.Array) -> pa.Array:
    """For each text (the tokens of each of its sentences) the score of each sentence; the texts of a batch at once."""
    said = texts.flatten()
    n, words = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False), pc.list_value_length(said).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(n)), n)
    term = said.flatten().dictionary_encode()
    base = max(len(term.dictionary), 1)
    found, tf = np.unique(np.repeat(np.arange(len(words)), words) * base + term.indices.to_numpy(zero_copy_only=False), return_counts=True)
    sentence, code = np.divmod(found, base)
    _, which, df = np.unique(owner[sentence] * base + code, return_inverse=True, return_counts=True)
    w = tf * (np.log((1 + n[owner[sentence]]) / (1 + df[which])) + 1)
    total, norm = np.bincount(sentence, w, len(words)), np.sqrt(np.bincount(sentence, w * w, len(words)))
    score = np.divide(total, norm, out=np.zeros(len(words)), where=norm > 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(score))


def _scored(docs: DataFrame, text: str, name: Column | None) -> DataFrame:
    """docs with _s (the sentences), _named and _score (of each of them). Texts stay where they lie: a task holds one batch
    of them, whatever the size of its partition."""
    asked = F.lit(None).cast("string") if name is None else name
    named = F.transform("_s", lambda s: F.coalesce(F.contains(F.lower(s), F.lower("_name")), F.lit(False)))
    tokens = F.transform("_s", lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\w\w+"), F.lit(0)))
    rows = lean(docs).select("*", asked.alias("_name"), sentences(F.col(text)).alias("_s"))
    return rows.select(*docs.columns, "_s", named.alias("_named"), _weighed(tokens).alias("_score"))


def sentence_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", name: Column | None = None) -> DataFrame:
    """(key, pos, n, named, score): the sum of a sentence's tf-idf weights over their norm; a document is its own corpus.

    Tokens: lower case, two word characters at least; idf is ln((1 + n) / (1 + df)) + 1. No token: 0. named: whether the
    sentence has `name`, whatever the case. Nothing is shuffled: every count of a document is made where it lies.
    """
    rows = _scored(docs, text, name).select(key, F.size("_s").alias("n"), F.posexplode(F.arrays_zip("_named", "_score")).alias("pos", "_x"))
    return rows.select(key, "pos", "n", F.col("_x._named").alias("named"), F.col("_x._score").alias("score"))


def with_summary(docs: DataFrame, name: Column, k: int = 3, boost: float = 2.0, text: str = "text") -> DataFrame:
    """docs with summary: the k best sentences in their order, those with the name counting `boost` times; short texts
    whole, null texts null.

    Scores count to 9 decimals; of equal ones the later sentence is taken.
    """
    counted = F.transform(
        F.arrays_zip("_named", "_score"),
        lambda x, i: F.struct(F.round(F.when(x["_named"], x["_score"] * boost).otherwise(x["_score"]), 9).alias("score"), i.alias("pos")),
    )
    best = F.slice(F.sort_array(counted, asc=False), 1, k)
    picked = F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: x["pos"])), lambda i: F.get("_s", i)), " ")
    made = _scored(docs, text, name)
    return made.select(*docs.columns, F.when(F.size("_s") > k, picked).otherwise(F.col(text)).alias("summary"))


def summary(docs: DataFrame, name: Column, k: int = 3, boost: float = 2.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, summary) of the texts that are not null, as with_summary has it."""
    return with_summary(docs.where(F.col(text).isNotNull()), name, k, boost, text).select(key, "summary")


def context(text: Column, name: Column, fallback: int = 3) -> Column:
    """The sentences with the name and their neighbours, in order; without any, the first `fallback`. All in one row, in
    time linear in the text."""
    marked = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), F.contains(F.lower(s), F.lower(name)).alias("hit")))

    def pick(m: Column) -> Column:
        hit = m["hit"]
        # Each sentence with what stands before and after it: arrays beside each other, so no place is looked up.
        near = F.arrays_zip(m["s"].alias("s"), hit.alias("hit"), F.concat(F.array(F.lit(False)), hit).alias("before"), F.slice(hit, F.lit(2), F.greatest(F.size(hit), F.lit(1))).alias("after"))
        kept = F.filter(near, lambda x: x["s"].isNotNull() & (x["hit"] | x["before"] | F.coalesce(x["after"], F.lit(False))))
        return F.when(F.array_contains(hit, True), F.transform(kept, lambda x: x["s"])).otherwise(F.slice(m["s"], 1, fallback))

    # The marked sentences are bound to a lambda's variable, so that they are made once.
    return F.array_join(F.get(F.transform(F.array(marked), pick), F.lit(0)), " ")


def pooled_note(df: DataFrame, key: str, note: str, confidence: str) -> DataFrame:
    """Confidence-weighted mean note, rounded half to even, and mean confidence."""
    weight = F.sum(confidence)
    return df.groupBy(key).agg(F.bround(F.try_divide(F.sum(F.col(note) * F.col(confidence)), weight)).cast("int").alias("note"), F.avg(confidence).alias("confidence"))


def pooled_argmax(df: DataFrame, key: str, vector: str, weight: Column) -> DataFrame:
    """Place of the largest entry (the first of equals) of the weighted mean of vectors; entries count to 6 decimals."""
    long = df.select(key, weight.alias("_w"), F.posexplode(vector).alias("place", "_x"))
    mean = long.groupBy(key, "place").agg(F.round(F.try_divide(F.sum(F.col("_x").cast("double") * F.col("_w")), F.sum("_w")), 6).alias("_m"))
    return mean.groupBy(key).agg(F.max(F.struct("_m", (-F.col("place")).alias("_p"))).alias("_b")).select(key, (-F.col("_b._p")).alias("place"), F.col("_b._m").alias("value"))
