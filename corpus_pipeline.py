"""The corpus pipeline: language ID, near duplicates, PII, mixing, packing; each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import jaccard, language, mixing, packing, pii
from quorate.llm.common import saved, table
from quorate.llm.queries import tokenizer_path

#: Up to so many ids are broadcast to the texts; beyond, texts and ids are shuffled.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null text, no letter, or no language to learn from."""
    return language.identify(docs).where("lang_pred <> 'und'").select(*docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a column that tells rows apart, its name, and whether it is a number: it has doc_id's values, or where
    these repeat or are null a number a row, as a written table."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        return saved(docs.withColumn(row, F.monotonically_increasing_id())), row, True
    return docs.withColumn(row, F.col("doc_id")), row, False


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more on five-word shingles, that with the smallest doc_id stays.

    Where ids repeat or are null, rows are told apart by a number: rows of one id with different texts are documents of
    their own. Null ids come last; of rows with equal ids in one class, that with the smaller hash of its text stays.
    """
    rows, row, by_number = _numbered(docs)
    classes = jaccard.jaccard_classes(rows.select(F.col(row).alias("doc_id"), "text"), words=5, percent=80)
    classes = saved(classes.select(F.col("doc_id").alias("_d"), F.col("component_id").alias("_c")))
    gone = classes.where("_d <> _c")
    if by_number:
        rivals = classes.join(gone.select("_c").distinct(), "_c")  # most classes are one row
        first = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(row).alias("at"))
        own = rows.select(F.col(row).alias("_at"), first.alias("_first"))
        stays = rivals.join(own, F.col("_d") == F.col("_at")).groupBy("_c").agg(F.min("_first")["at"].alias("_s"))
        gone = rivals.join(stays, "_c").where("_d <> _s")
    gone = saved(gone.select(F.col("_d").alias("_gone")))
    return rows.join(_small(gone), F.col(row) == F.col("_gone"), "left_anti").select(*docs.columns)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [KIND] in place of personal data; n_chars follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words over its size, rounded; 0 times drops it.

    Texts without words, null ones too, have no size and are dropped. Null sources are a source of their own. Where ids
    repeat or are null, each row is a document of its own.
    """
    rows, row, _ = _numbered(docs)
    taken = mixing.mix(rows.select(F.col(row).alias("doc_id"), "source", "text"))
    times = taken.select(F.col("doc_id").alias("_d"), F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("_times"))
    times = saved(times.where("_times > 0"))
    found = rows.join(_small(times), F.col(row) == F.col("_d"))
    return found.withColumn("_again", F.explode(F.array_repeat(F.lit(True), F.col("_times")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan: a row for each piece, with its sequence and offset there. Null texts are packed as empty ones;
    repeated rows, and rows without an id, are packed each."""
    return packing.pack(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("language ID", keep_identified),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("PII", redact_private),
    ("mixing sources to target weights", mix_to_targets),
    ("best-fit packing", pack_sequences),
]

#: Models and plans of the stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
