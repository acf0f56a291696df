"""Prompts and their history: a version's template is known by its content, in the interval in which it was the template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A registry of up to so many intervals is broadcast; beyond, it is joined by version.
BROADCAST_ROWS = 100_000


def history(edits: DataFrame) -> DataFrame:
    """(version, template, template_md5, since, until) from edits (version, template, since): one interval for each time that
    a version's template became another; until is null for the one that holds.

    An edit that changes nothing begins no interval; one that brings an earlier text back does. Of edits at the same time
    the one whose text comes last counts. A null template withdraws the version: from then on there is none.
    """
    edits = edits.groupBy("version", "since").agg(F.max_by("template", F.struct(F.col("template").isNotNull(), "template")).alias("template"))
    order = Window.partitionBy("version").orderBy("since")
    first = F.row_number().over(order) == 1
    new = edits.withColumn("_new", first | ~F.col("template").eqNullSafe(F.lag("template").over(order))).where("_new")
    spans = new.withColumn("until", F.lead("since").over(order)).where("template IS NOT NULL")
    return spans.select("version", "template", F.md5("template").alias("template_md5"), "since", "until")


def as_of(evaluations: DataFrame, registry: DataFrame, version: str = "version", at: str = "at") -> DataFrame:
    """evaluations with template_md5 and prompt_since of the text that its version had at that time; null where it had none
    (yet), or version or time is null. Every row stays, once: a version's intervals do not overlap."""
    spans = registry.select(F.col("version").alias("_v"), F.col("since").alias("prompt_since"), F.col("until").alias("_until"), "template_md5")
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    holds = (F.col(version) == F.col("_v")) & (F.col(at) >= F.col("prompt_since")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return evaluations.join(spans, holds, "left").drop("_v", "_until")


def reworded(evaluations: DataFrame) -> DataFrame:
    """(version, texts, evaluations): versions under which evaluations were made with more than one text, so that their notes
    are not of one prompt. evaluations: as as_of() gives them."""
    said = evaluations.where("template_md5 IS NOT NULL").groupBy("version", "template_md5").agg(F.count("*").alias("n"))
    return said.groupBy("version").agg(F.count("*").alias("texts"), F.sum("n").alias("evaluations")).where("texts > 1")
