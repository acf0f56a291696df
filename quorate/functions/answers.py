"""Rater answers: salvage of their JSON, lax coercion, clean-up, and the rule that may overrule a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTES = (0, 1, 2)
#: Fixed values of the answer format.
SENSES = ("amelioree", "maintenue", "degradee", "aucune")
LEVELS = ("haut", "moyen", "bas")
VARIATION_LIMIT = 30.0
THRESHOLD = 5.0
#: Note by (target, recommendation): the broker grid, fixed values.
GRID = (
    ("releve", "amelioree", None, 2), ("releve", "maintenue", "haut", 2), ("releve", "maintenue", "moyen", 1), ("releve", "degradee", None, 1),
    ("inchange", "amelioree", None, 2), ("inchange", "maintenue", "haut", 1), ("inchange", "maintenue", "moyen", 1), ("inchange", "degradee", None, 0),
    ("abaisse", "amelioree", None, 2), ("abaisse", "maintenue", "haut", 1), ("abaisse", "maintenue", "moyen", 1), ("abaisse", "degradee", None, 0),
)


def salvaged(raw: Column) -> Column:
    """The answer as VARIANT: without its fence, whole, else from the first { to the last }; null if neither parses."""
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^\s*```(?i:json)?\s*", ""), r"\s*```\s*$", "")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds status (ok or failed), note, justification, variation, other_fact, sense, level.

    A note is an integer, a whole decimal, a string of one, or a boolean (1, 0), and in 0, 1, 2; a justification must be a string;
    optional fields must have their kind or be null. Unknown enum values and variations beyond 30 become null. Anything
    that is no object fails, and a failed row has nulls.
    """
    df = df.withColumn("_v", salvaged(F.col(raw)))
    v = F.col("_v")
    text = lambda p: F.try_variant_get(v, p, "string")
    kind = {p: _kind(v, f"$.{p}") for p in ("note_llm", "justification", "variation_cours_pct", "autre_fait_concret", "reco_sens", "reco_niveau")}
    none = lambda p: kind[p].isNull() | (kind[p] == "VOID")
    number = lambda p: F.coalesce(kind[p].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    is_bool = lambda p: F.coalesce(kind[p] == "BOOLEAN", F.lit(False))
    is_text = lambda p: F.coalesce(kind[p] == "STRING", F.lit(False))
    as_double = F.when(is_bool("note_llm"), F.when(text("$.note_llm") == "true", 1.0).otherwise(0.0)).when(number("note_llm") | (is_text("note_llm") & text("$.note_llm").rlike(r"^\s*[+-]?\d+(\.0*)?\s*$")), F.trim(text("$.note_llm")).try_cast("double"))
    fact = F.when(is_bool("autre_fait_concret"), text("$.autre_fait_concret") == "true")
    variation = F.when(number("variation_cours_pct") | is_text("variation_cours_pct"), text("$.variation_cours_pct").try_cast("double"))
    good = (
        F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        & F.coalesce(as_double.isin(*[float(n) for n in NOTES]), F.lit(False))
        & is_text("justification")
        & (none("variation_cours_pct") | variation.isNotNull())
        & (none("autre_fait_concret") | fact.isNotNull())
        & (none("reco_sens") | is_text("reco_sens"))
        & (none("reco_niveau") | is_text("reco_niveau"))
    )
    enum = lambda p, among: F.when(F.lower(F.trim(text(p))).isin(*among), F.lower(F.trim(text(p))))
    df = df.withColumn("_ok", good)
    kept = lambda c: F.when(F.col("_ok"), c)
    return df.withColumns({
        "status": F.when(F.col("_ok"), F.lit("ok")).otherwise(F.lit("failed")),
        "note": kept(as_double.cast("int")),
        "justification": kept(text("$.justification")),
        "variation": kept(F.when(F.abs(variation) <= VARIATION_LIMIT, variation)),
        "other_fact": kept(fact),
        "sense": kept(enum("$.reco_sens", SENSES)),
        "level": kept(enum("$.reco_niveau", LEVELS)),
    }).drop("_v", "_ok")


def overruled(other_fact: Column, sense: Column) -> Column:
    """Whether the rule decides: no other fact is certain and no recommendation moved. Unknown facts: the rater decides."""
    return F.coalesce(~other_fact, F.lit(False)) & (F.coalesce(sense, F.lit("aucune")) == "aucune")


def final_note(note: Column, variation: Column, other_fact: Column, sense: Column, threshold: Column | float = THRESHOLD) -> Column:
    """struct<note, origin>: the rater's note, or 1 below the threshold, and 2 or 0 by the sign beyond it."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    moved = F.coalesce(F.abs(variation) >= limit, F.lit(False))
    by_rule = F.when(~moved, 1).when(variation > 0, 2).otherwise(0)
    rule = overruled(other_fact, sense)
    return F.struct(F.when(rule, by_rule).otherwise(note).cast("int").alias("note"), F.when(rule, F.lit("rule")).otherwise(F.lit("model")).alias("origin"))


def facts_json(variation: Column, other_fact: Column, sense: Column, level: Column) -> Column:
    """The four facts as JSON with explicit nulls; null when all are null."""
    any_ = F.coalesce(variation.cast("string"), other_fact.cast("string"), sense, level).isNotNull()
    one = F.struct(variation.alias("variation_cours_pct"), other_fact.alias("autre_fait_concret"), sense.alias("reco_sens"), level.alias("reco_niveau"))
    return F.when(any_, F.to_json(one, {"ignoreNullFields": "false"}))
