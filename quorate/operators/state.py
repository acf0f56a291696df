"""Evaluations as an append-only log: the current state is a fold, collection is an outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each event sets; what it does not name stays as it was. A failure clears the note but keeps the facts, a
#: submission keeps the old note, a reset clears all but the facts; a reload and a new score leave status and version.
TOUCHES = {
    "ok": ("note", "justification", "version", "extraction"),
    "failed": ("note", "justification", "version"),
    "submitted": ("version",),
    "not_evaluated": ("note", "justification", "version"),
    "reloaded": ("note", "justification"),
    "rescored": ("note",),
}
CLEARS = {("failed", "note"), ("failed", "justification"), ("not_evaluated", "note"), ("not_evaluated", "justification"), ("not_evaluated", "version")}
STATUSES = ("ok", "failed", "submitted", "not_evaluated")
#: The same for what is known of a pair whoever rates it: a new count of mentions puts the classifier's notes to 0.
PAIR_TOUCHES = {"counted": ("nbocc", "note_tfidf", "note_full", "date_estim"), "classified": ("note_tfidf", "note_targeted", "note_full", "date_estim")}
NEVER = "1900-01-01"


def parts(seq: Column, event: str, columns: list[str], touches: dict, clears: set = frozenset()) -> list[Column]:
    """For each column an aggregate: (s: seq, v: value) of the last event that touches it. Such parts merge by max."""
    out = []
    for c in columns:
        by = [s for s, cols in touches.items() if c in cols]
        cleared = [s for s, col in clears if col == c]
        value = F.when(~F.col(event).isin(*cleared), F.col(c)) if cleared else F.col(c)
        out.append(F.max(F.when(F.col(event).isin(*by), F.struct(seq.alias("s"), value.alias("v")))).alias(c))
    return out


def fold(log: DataFrame, key: list[str], seq: Column, event: str, columns: list[str], touches: dict, clears: set = frozenset()) -> list[Column]:
    """For each column an aggregate: the value of the last event that touches it."""
    return [p["v"].alias(c) for c, p in zip(columns, parts(seq, event, columns, touches, clears), strict=True)]


def current(log: DataFrame, key: list[str], seq: Column) -> DataFrame:
    """(key, status, note, justification, version, extraction) after all events, in the order of seq (unique in a key).

    log's `status` names the event; one partial aggregation.
    """
    columns = [c for c in ("note", "justification", "version", "extraction") if c in log.columns]
    status = F.max(F.when(F.col("status").isin(*STATUSES), F.struct(seq.alias("s"), F.col("status").alias("v"))))["v"].alias("status")
    return log.groupBy(*key).agg(status, *fold(log, key, seq, "status", columns, TOUCHES, CLEARS))


def pair_state(log: DataFrame, key: list[str], seq: Column) -> DataFrame:
    """(key, nbocc, note_tfidf, note_targeted, note_full, date_estim) after all `event`s; NEVER where none set a date."""
    columns = ["nbocc", "note_tfidf", "note_targeted", "note_full", "date_estim"]
    s = log.groupBy(*key).agg(*fold(log, key, seq, "event", columns, PAIR_TOUCHES))
    return s.withColumn("date_estim", F.coalesce("date_estim", F.lit(NEVER).cast("date")))


def counted_events(counts: DataFrame, as_of: Column) -> DataFrame:
    """counts (key..., nbocc) as events of a fresh count: the classifier's notes go to 0, the date is `as_of`."""
    zero = F.lit(0)
    return counts.withColumns({"event": F.lit("counted"), "note_tfidf": zero, "note_targeted": F.lit(None).cast("int"), "note_full": zero, "date_estim": as_of})


def rescored_events(pairs: DataFrame, final: Column) -> DataFrame:
    """Events of pairs whose note changes with `final` (struct note, origin)."""
    changed = pairs.withColumn("_final", final).where(~F.col("_final.note").eqNullSafe(F.col("note")))
    return changed.withColumns({"note": F.col("_final.note"), "status": F.lit("rescored")}).drop("_final")


def collected(requests: DataFrame, results: DataFrame, key: str | list[str] = "custom_id") -> DataFrame:
    """Every request with its result; a missing one is failed, a result nobody asked for is ignored."""
    return requests.join(results, key, "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def not_submitted(requests: DataFrame, submitted: DataFrame) -> DataFrame:
    return requests.join(submitted.select("custom_id"), "custom_id", "left_anti")


def last_write(df: DataFrame, key: list[str], order: Column, values: list[str]) -> DataFrame:
    """Of rows with the same key, the values of the last one in `order`."""
    last = F.max(F.struct(order.alias("_o"), *values)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{v}").alias(v) for v in values])


def unambiguous(dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that lead to one value only; null keys, values that are null or 0 lead nowhere."""
    good = dimension.where(F.col(key).isNotNull() & (F.coalesce(F.col(value), F.lit(0)) != 0))
    return good.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_z")).where("_a = _z").select(key, F.col("_a").alias(value))
