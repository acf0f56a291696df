"""Tables, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
#: Bytes of an Arrow batch on its way to a Python worker: it is held on both sides, beside what a task makes of it.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(df: DataFrame) -> DataFrame:
    """df; its session sends Arrow batches of BATCH_BYTES where it names no size, from here on."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; where a local master names none, as in tests, a folder of our own
    that goes when Python ends. On a cluster a machine's own folder would be another one for each executor: an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="quorate-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return f"file://{_OWN_DIR[0]}"


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder, in this application's own folder there."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors and fixes generated ids."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _path_class(jvm):
    return jvm.org.apache.hadoop.fs.Path  # each name on the way is a question to the JVM


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path for it)."""
    p = _path_class(spark.sparkContext._jvm)(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_saved(spark: SparkSession) -> None:
    """Deletes what this application has written below the shared folder. Call it once all results are written: they
    read these tables until then."""
    fs, path = file_system(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    fs.delete(path, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str) -> str | None:
    """A file's first line, without reading on; null where it is empty."""
    fs, p = file_system(spark, path)
    jvm, stream = spark.sparkContext._jvm, fs.open(p)
    try:
        line = jvm.org.apache.hadoop.io.Text()
        return line.toString() if jvm.org.apache.hadoop.util.LineReader(stream, bytearray(b"\n")).readLine(line) else None
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file, whole, unless there is one: of several writers one gets True.

    It is written under another name first. A link (on a plain file system) or a rename (elsewhere) then fails where the
    name is taken.
    """
    fs, p = file_system(spark, path)
    own = f"_{uuid.uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        folder, name = os.path.split(p.toUri().getPath())
        os.makedirs(folder, exist_ok=True)
        own = os.path.join(folder, own)
        try:
            with open(own, "x", encoding="utf-8", newline="") as f:
                f.write(text)
            os.link(own, os.path.join(folder, name))
            return True
        except FileExistsError:
            return False
        finally:
            if os.path.lexists(own):
                os.unlink(own)
    fs.mkdirs(p.getParent())
    own = file_system(spark, f"{p.getParent().toString()}/{own}")[1]
    stream = fs.create(own)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        return bool(fs.rename(own, p))
    finally:
        fs.delete(own, False)
