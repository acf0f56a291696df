"""Classifiers: pluggable models that label texts in Arrow batches, and what becomes of their labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.text import excerpt, substring_count, windows
from quorate.operators.blocks import CUTS, token_runs
from quorate.operators.extraction import context, pooled_argmax, pooled_note, with_summary
from quorate.sources.shared import saved

#: Labels and their notes, fixed values; any other label counts as NEUTRAL's note.
LABEL_NOTES = {"POSITIVE": 2, "NEUTRAL": 1, "NEGATIVE": 0}
BLOCK = 500
#: Words of a window of the second classifier, and from one window's start to the next one's.
WINDOW, STRIDE = 512, 462
#: What comparison files call the kinds of articles, fixed values.
KIND_NAMES = {"dedicated": "dedie", "dedicated_single": "dedie_unique", "general": "generaliste"}
#: The note that stands for "not asked": the target of a dedicated article is the whole of it.
NOT_ASKED = 9


class Classifier(Protocol):
    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        """(label, confidence) of each text."""


class LengthClassifier:
    """A classifier without a model, for tests and dry runs: the length of the text decides."""

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        return [(("negative", "Neutral", "POSITIVE", "other")[len(t) % 4], (1 + len(t) % 7) / 8) for t in texts]


class SecondClassifier(Protocol):
    def probabilities(self, texts: list[str]) -> list[list[float]]:
        """For each text the probability of each note."""


class LengthProbabilities:
    """A second classifier without a model: the length of the text decides."""

    def probabilities(self, texts: list[str]) -> list[list[float]]:
        return [[(1 + len(t) % 3) / 8, (1 + len(t) % 2) / 8, 1 - (2 + len(t) % 3 + len(t) % 2) / 8] for t in texts]


#: Makers rather than models: each worker makes its own once, then takes batch after batch.
REGISTRY: dict[str, Callable[[], Classifier]] = {"length": LengthClassifier}
SECOND: dict[str, Callable[[], SecondClassifier]] = {"length": LengthProbabilities}


def label_note(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LABEL_NOTES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(label)), F.lit(LABEL_NOTES["NEUTRAL"]))


def labelled(df: DataFrame, text: str, classifier: str) -> DataFrame:
    """Adds label (upper case), confidence and note."""
    make = REGISTRY[classifier]

    @F.pandas_udf("struct<label: string, confidence: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield pd.DataFrame(model.label([t or "" for t in b]), columns=["label", "confidence"])

    df = df.withColumn("_l", run(text))
    return df.withColumns({"label": F.upper("_l.label"), "confidence": F.col("_l.confidence"), "note": label_note(F.col("_l.label"))}).drop("_l")


def sentiment(df: DataFrame, key: str, text: str, classifier: str, block: int = BLOCK, tokenizer: str | None = None) -> DataFrame:
    """(key, label, note, confidence) of whole texts: blocks of `block` words, or of tokens where a tokenizer file is named,
    are labelled and pooled by confidence.

    A blank or null text is NEUTRAL, 1, 1.0 and is not shown to the model. Keys are unique.
    """
    pooled = _pooled(df.select(key, text), key, text, classifier, block, tokenizer)
    back = F.create_map(*[F.lit(x) for label, n in LABEL_NOTES.items() for x in (n, label)])
    out = df.select(key).join(pooled, key, "left")
    note = F.coalesce("note", F.lit(LABEL_NOTES["NEUTRAL"]))
    return out.select(key, F.element_at(back, note).alias("label"), note.alias("note"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def _runs(df: DataFrame, key: str, text: str, size: int, stride: int, kind: str, tokenizer: str | None) -> DataFrame:
    """(key, text) of the runs of words of texts that are not blank, or of tokens of the tokenizer file."""
    if tokenizer:
        cut = CUTS[kind]._replace(size=size, stride=stride)
        return token_runs(df, key, text, tokenizer, {kind: cut}).select(key, F.col("text").alias("_text"))
    # The words are a column of their own: a text is split once, not once more for each of its windows.
    words = df.select(key, F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+", -1), "").alias("_w"))
    return words.select(key, F.explode(windows(F.col("_w"), size, stride)).alias("_b")).select(key, F.array_join("_b.items", " ").alias("_text"))


def _pooled(df: DataFrame, key: str, text: str, classifier: str, block: int = BLOCK, tokenizer: str | None = None) -> DataFrame:
    """(key, note, confidence) of texts that are not blank."""
    blocks = _runs(df, key, text, block, block, "block", tokenizer)
    return pooled_note(labelled(blocks, "_text", classifier), key, "note", "confidence")


def _parts(df: DataFrame, key: str, texts: dict[str, Column]) -> DataFrame:
    """(_id: struct<key, part>, text) of the texts that are not null."""
    parts = F.array(*[F.struct(F.lit(name).alias("part"), text.alias("text")) for name, text in texts.items()])
    return df.select(key, F.inline(parts)).where("text IS NOT NULL").select(F.struct(key, "part").alias("_id"), "text")


def _by_part(notes: DataFrame, key: str, names: Iterable[str]) -> DataFrame:
    """(key, and a column for each of names) of (_id, note)."""
    notes = notes.select(F.col(f"_id.{key}").alias(key), F.col("_id.part").alias("part"), "note")
    return notes.groupBy(key).agg(*[F.max(F.when(F.col("part") == name, F.col("note"))).alias(name) for name in names])


def sentiments(df: DataFrame, key: str, texts: dict[str, Column], classifier: str, tokenizer: str | None = None) -> DataFrame:
    """(key, and a note for each of texts): their blocks are labelled in one pass over df and pooled together. A blank text
    is 1, a null one null; a key all of whose texts are blank or null has no row."""
    return _by_part(_pooled(_parts(df, key, texts), "_id", "text", classifier, tokenizer=tokenizer), key, texts)


def second_note(df: DataFrame, key: str, text: str, classifier: str, tokenizer: str | None = None) -> DataFrame:
    """(key, note): windows of words (or of the tokenizer file's tokens) are judged, their probabilities averaged by each window's highest one; the likeliest
    note. A blank or null text gives no row. Keys are unique."""
    make = SECOND[classifier]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            yield pd.Series(model.probabilities(list(b)))

    parts = _runs(df, key, text, WINDOW, STRIDE, "overlap", tokenizer).select(key, run("_text").alias("_p"))
    return pooled_argmax(parts, key, "_p", F.array_max("_p")).select(key, F.col("place").cast("int").alias("note"))


def article_kind(title: Column, content: Column, name: Column) -> Column:
    """dedicated (the name is in the title and more than once in the content), dedicated_single, or general."""
    inside = F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lower(name))
    n = substring_count(F.lower(F.coalesce(content, F.lit(""))), F.lower(name))
    return F.when(inside & (n > 1), "dedicated").when(inside, "dedicated_single").otherwise("general")


def classified(pairs: DataFrame, classifier: str, tokenizer: str | None = None) -> DataFrame:
    """pairs (pair_id, title, content, name) -> pair_id, kind, note_tfidf, note_targeted, note_full, resume.

    The notes of the summary and of the whole text; for the target that of the sentences about the name, or NOT_ASKED in
    dedicated articles. Pairs without any text give no row. pair_ids are unique. Blocks are of words, or of the tokens of a
    tokenizer file.
    """
    text = F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    d = pairs.select("pair_id", "name", text.alias("text"), article_kind(F.col("title"), F.col("content"), F.col("name")).alias("kind")).where("length(text) > 0")
    # Summaries are written once, as they are labelled and returned. Texts are not: their rows lie where they are read.
    short = saved(with_summary(d, F.col("name")).select("pair_id", "kind", "summary"))
    dedicated = F.col("kind") == "dedicated"
    texts = {"note_full": F.col("text"), "note_targeted": F.when(~dedicated, context(F.col("text"), F.col("name")))}
    rows = _parts(d, "pair_id", texts).unionByName(_parts(short, "pair_id", {"note_tfidf": F.col("summary")}))
    notes = _by_part(_pooled(rows, "_id", "text", classifier, tokenizer=tokenizer), "pair_id", ["note_tfidf", *texts])
    out = short.join(notes, "pair_id", "left")
    neutral = F.lit(LABEL_NOTES["NEUTRAL"])
    target = F.when(dedicated, F.lit(NOT_ASKED)).otherwise(F.coalesce("note_targeted", neutral))
    return out.select("pair_id", "kind", F.coalesce("note_tfidf", neutral).alias("note_tfidf"), target.alias("note_targeted"), F.coalesce("note_full", neutral).alias("note_full"), F.col("summary").alias("resume"))


def comparison(pairs: DataFrame, classifier: str, second: str, tokenizer: str | None = None, second_tokenizer: str | None = None) -> DataFrame:
    """The rows of comparison files: pairs (pair_id, article_id, company_id, title, content, name) with the notes of both
    classifiers. The second one judges a dedicated article as a whole (note_gpu, and divergence_full from the first one's
    note), any other by its context and as a whole (note_targeted_gpu, note_full_gpu). Texts are cut for display."""
    text = F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    d = pairs.withColumns({"_text": text, "_kind": article_kind(F.col("title"), F.col("content"), F.col("name"))})
    about = F.when(F.col("_kind") != "dedicated", context(F.col("_text"), F.col("name")))
    judged = _by_part(second_note(_parts(d, "pair_id", {"_whole": F.col("_text"), "_target": about}), "_id", "text", second, second_tokenizer), "pair_id", ["_whole", "_target"])
    # What is shown of a text is cut before rows are joined, so no text is shuffled whole.
    shown = d.select("pair_id", "article_id", "company_id", "name", "title", excerpt(F.col("_text"), 500, "").alias("texte_brut"))
    d = shown.join(classified(pairs, classifier, tokenizer), "pair_id").join(judged, "pair_id", "left")
    dedicated = F.col("kind") == "dedicated"
    both = ~dedicated & F.col("_target").isNotNull()
    names = F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv])
    alone = F.when(dedicated, F.col("_whole"))
    return d.select(
        "article_id", "company_id", F.col("name").alias("company_name"), F.element_at(names, F.col("kind")).alias("type"), F.coalesce("title", F.lit("")).alias("titre"),
        "note_tfidf", "note_targeted", "note_full", alone.alias("note_gpu"), F.when(both, F.col("_target")).alias("note_targeted_gpu"), F.when(both, F.col("_whole")).alias("note_full_gpu"),
        F.abs(F.col("note_full") - alone).alias("divergence_full"), excerpt(F.col("resume"), 300, "").alias("resume"), "texte_brut",
    )


def classified_events(notes: DataFrame, as_of: Column) -> DataFrame:
    """Events for the log of pairs: the three notes, and the date `as_of`."""
    return notes.withColumns({"event": F.lit("classified"), "date_estim": as_of})
