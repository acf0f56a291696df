"""Files the engine reads and writes: CSV results, alias dictionaries, request and result lines, dumps."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.sources.shared import file_system, first_line, saved

#: Names that files give to raters, fixed values.
RATER_NAMES = {"gemini": "gemini", "haiku": "haiku", "mistral": "mistral", "queen": "queen", "qwen": "queen", "lama": "lama", "llama": "lama", "llm": "lama"}
#: Columns of result files and of comparison files, fixed values.
RESULT_COLUMNS = ("article_id", "entreprise", "prompt_version", "statut", "note_llm", "justification", "longueur_caracteres", "longueur_mots", "texte_extrait")
COMPARISON_COLUMNS = ("article_id", "company_id", "company_name", "type", "titre", "note_tfidf", "note_targeted", "note_full", "note_gpu", "note_targeted_gpu", "note_full_gpu", "divergence_full", "resume", "texte_brut")
#: Places in a part file have so many bits; the number of the part is above them.
PART_BITS = 44
#: What a result file must have to be read.
NEEDED = ("article_id", "entreprise", "note_llm")


def resolved(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths of the patterns, in their order and sorted within each, every path once where it comes first."""
    found: dict[str, None] = {}
    for pattern in patterns:
        fs, path = file_system(spark, pattern)
        for p in sorted(s.getPath().toString() for s in fs.globStatus(path) or []):
            found.setdefault(p)
    return list(found)


def parts_of(spark: SparkSession, path: str) -> list[str]:
    """The path of a file; of a folder that Spark has written those of its part files, in order."""
    fs, p = file_system(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def _literal(path: str) -> str:
    """A path as a pattern that matches it alone."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file: number of the path, at: begin of the block read, id: order in it, value) of the lines of files, in blocks.

    Files are told by number, as the path that a line comes with is encoded: spaces, percent signs and the like.
    """
    lines = spark.read.text([_literal(p) for p in paths], lineSep="\n")
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    uris = [file_system(spark, p)[0].makeQualified(file_system(spark, p)[1]).toUri().toString() for p in paths]
    known = spark.createDataFrame([(u, i) for i, u in enumerate(uris)], "uri string, file int").select(key(F.col("uri")).alias("_uri"), "file")
    lines = lines.select(key(F.col("_metadata.file_path")).alias("_uri"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    return lines.join(F.broadcast(known), "_uri").drop("_uri")  # a row a path, which the driver has


def _placed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, row_ord, at, id, value, whole) of the lines of CSV files: row_ord is the record's, whole: the line is all of it."""
    block = Window.partitionBy("file", "at").orderBy("id")
    upto, before = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = _lines(spark, paths).withColumn("q", quotes)
    lines = lines.withColumn("odd", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    # How many records have begun in the block, should an even (or odd) number of quotes precede the block.
    lines = saved(lines.withColumns({f"begun{k}": F.sum((F.col("odd") == k).cast("long")).over(upto) for k in (0, 1)}))

    order = Window.partitionBy("file").orderBy("at")  # a row a block
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "at").agg(F.sum("q").alias("q"), F.max("begun0").alias("b0"), F.max("begun1").alias("b1"))
    blocks = blocks.withColumn("p", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("begun", F.when(F.col("p") == 0, F.col("b0")).otherwise(F.col("b1")))
    last = F.last(F.when(F.col("begun") > 0, F.struct("at", "begun")), ignorenulls=True).over(earlier)
    blocks = blocks.select(F.col("file").alias("_f"), F.col("at").alias("_at"), "p", last.alias("last"))

    own = F.when(F.col("p") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    placed = lines.join(blocks, (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_at"))).withColumn("own", own)
    # No block has more records than bytes, so its begin and a record's number in it give a place in the file.
    record = F.when(F.col("own") > 0, F.col("at") + F.col("own")).otherwise(F.col("last.at") + F.col("last.begun"))
    return placed.select("file", record.alias("row_ord"), "at", "id", "value", ((F.col("odd") == F.col("p")) & (F.col("q") % 2 == 0)).alias("whole"))


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file: number of the path, row_ord, record) of CSV files: lines, joined where a quoted field holds line ends.

    Files are read in blocks, each by a task of its own. A line begins a record if the quotes before it in its file are
    even in number: blocks sum up theirs, a running sum over one row a block tells what precedes each, and a line then
    knows its record. Records of one line stay where they are; only lines of longer ones, which may lie in several blocks,
    are brought together. row_ord grows with the place in the file. Line ends are \\n or \\r\\n; blank records are left
    out. A quote that is never closed makes the rest of its file one record.
    """
    return _records(_placed(spark, paths))


def _records(placed: DataFrame) -> DataFrame:
    one = placed.where("whole").select("file", "row_ord", F.col("value").alias("record"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "value"))), lambda x: x["value"])
    more = placed.where("NOT whole").groupBy("file", "row_ord").agg(F.array_join(parts, "\n").alias("record"))
    both = one.unionByName(more).withColumn("record", _ended("record"))
    return both.where(F.length(F.trim("record")) > 0)


def _ended(line: str) -> Column:
    return F.regexp_replace(line, "\r$", "")


def cells_of(header: str) -> list[str]:
    """Names of the columns in a file's first line."""
    return [c.strip() for c in next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")]), [])]


def read_columns(spark: SparkSession, paths: list[str], header: list[str], columns: tuple[str, ...]) -> DataFrame:
    """columns as strings (null where header lacks one), file (number of the path) and row_ord of CSV files that all have
    this header."""
    placed = _placed(spark, paths)
    records = _records(placed)
    # Of the lines, so that records are not joined twice; one with quotes left open is not blank.
    said = placed.where(~F.col("whole") | (F.length(F.trim(_ended("value"))) > 0))
    first = said.groupBy("file").agg(F.min("row_ord").alias("_first")).withColumnRenamed("file", "_file")
    rows = records.join(F.broadcast(first), F.col("file") == F.col("_file")).where(F.col("row_ord") > F.col("_first"))  # a row a file
    shape = ", ".join(f"_{k} string" for k in range(len(header)))
    rows = rows.select("file", "row_ord", F.from_csv("record", F.lit(shape), {"escape": '"'}).alias("r"))
    cells = [F.col(f"r._{header.index(c)}").alias(c) if c in header else F.lit(None).cast("string").alias(c) for c in columns]
    return rows.select("file", "row_ord", *cells)


def _heads(spark: SparkSession, paths: list[str]) -> list[tuple]:
    """(path, file_ord, file, rater, header, usable, parts) of each file."""
    out = []
    for i, path in enumerate(paths):
        name, parts = path.rsplit("/", 1)[-1], parts_of(spark, path)
        header = next((line for line in (first_line(spark, part) for part in parts) if line is not None), None)
        found = re.match(r"resultats?_([a-z0-9]+)_", name.lower())
        rater = RATER_NAMES.get(found[1]) if found else None
        out.append((path, i, name, rater, header, rater is not None and set(NEEDED) <= set(cells_of(header or "")), parts))
    return out


def result_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file_ord, file, rater, header, usable) of each file, in order; header: its first line.

    A file may be a folder of part files, each with the header, as Spark writes them in parallel; the folder's name counts.
    A file is usable if its name tells a rater and its header has the columns NEEDED.
    """
    return spark.createDataFrame([h[:6] for h in _heads(spark, paths)], "path string, file_ord int, file string, rater string, header string, usable boolean")


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of usable result files, all columns as strings: RESULT_COLUMNS (null where a file lacks one), file, file_ord,
    row_ord, rater. Columns are found by name, so files may order them as they like; quoted fields may hold quotes and
    line ends. Rows come later in (file_ord, row_ord) if they are later in the files.
    """
    by_header: dict[str, list[tuple]] = {}
    for head in _heads(spark, paths):
        if head[5]:
            by_header.setdefault(head[4], []).append(head)
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in RESULT_COLUMNS) + ", row_ord long, file string, file_ord int, rater string")
    for header, own in by_header.items():
        parts = [(path, (h[2], h[1], h[3], k)) for h in own for k, path in enumerate(h[6])]
        rows = read_columns(spark, [path for path, _ in parts], cells_of(header), RESULT_COLUMNS).withColumnRenamed("file", "_n")
        names = spark.createDataFrame([(n, *told) for n, (_, told) in enumerate(parts)], "_n int, file string, file_ord int, rater string, _part long")
        rows = rows.join(F.broadcast(names), "_n")  # a row a part file
        out = out.unionByName(rows.withColumn("row_ord", F.shiftleft("_part", PART_BITS) + F.col("row_ord")).drop("_n", "_part"))
    return out


def write_results(rows: DataFrame, path: str, columns: tuple[str, ...] = RESULT_COLUMNS) -> None:
    """CSV with a header; fields with quotes or line ends are quoted as read_results reads them, and keep their spaces.
    Appends."""
    rows.select(*columns).write.mode("append").csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def rater_of_file(name: Column) -> Column:
    """resultat(s)_<rater>_... -> the rater, null where the name begins otherwise or has none that is known."""
    found = F.regexp_extract(F.lower(name), r"^resultats?_([a-z0-9]+)_", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RATER_NAMES.items() for x in kv]), found)


def version_of_file(name: Column) -> Column:
    """_V4 or -v4 in a file name -> v4, null without one."""
    return F.when(name.rlike(r"[_-][Vv]\d+"), F.concat(F.lit("v"), F.regexp_extract(name, r"[_-][Vv](\d+)", 1)))


def of_version(rows: DataFrame, version: Column, file: Column) -> DataFrame:
    """Rows of the version that the file's name tells; all rows where it tells none."""
    told = version_of_file(file)
    return rows.where(told.isNull() | version.eqNullSafe(told))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(name, alias) of a JSON object of lists; anything else in it gives no row, a null or broken document none at all,
    nor does a path that is not there. Names are as they stand in the file."""
    fs, p = file_system(spark, path)
    if not fs.globStatus(p):
        return spark.range(0).select(F.lit("").alias("name"), F.lit("").alias("alias"))
    # A file holds one object, or several with line ends between them.
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)", -1)).alias("value"))
    whole = objects.select(F.from_json("value", "map<string, string>").alias("m"))
    lists = whole.select(F.explode("m").alias("name", "v")).where(F.ltrim("v").startswith("["))
    return lists.select("name", F.explode(F.from_json("v", "array<string>")).alias("alias"))


def alias_lists(aliases: DataFrame) -> DataFrame:
    """(name, aliases): trimmed, lower case, distinct, sorted; empty ones go."""
    one = F.lower(F.trim("alias"))
    return aliases.where(F.length(one) > 0).groupBy("name").agg(F.sort_array(F.collect_set(one)).alias("aliases"))


def write_aliases(aliases: DataFrame, path: str) -> None:
    """JSON objects of one name's list each, a line for each, as read_aliases reads them."""
    one = F.to_json(F.create_map("name", "aliases"))
    alias_lists(aliases).select(one.alias("value")).write.text(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """A JSON line for each request."""
    requests.select(F.to_json(F.struct(*requests.columns)).alias("value")).write.text(path)


def read_requests(spark: SparkSession, path: str, shape: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", shape).alias("r")).select("r.*")


def read_chat_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(custom_id, raw, problem) of result lines that have candidates with parts; several parts are joined."""
    shape = "key string, response struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>>, error string"
    keep = [c for c in lines.columns if c != value]
    r = lines.select(*keep, F.from_json(value, shape).alias("r")).where("r.key IS NOT NULL")
    raw = F.array_join(F.get(F.col("r.response.candidates"), F.lit(0))["content"]["parts"]["text"], "")
    return r.select(F.col("r.key").alias("custom_id"), F.when(F.length(raw) > 0, raw).alias("raw"), F.col("r.error").alias("problem"), *keep)


def read_message_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(custom_id, raw, problem) of result lines that have a message with blocks; text blocks are joined."""
    shape = "custom_id string, result struct<type: string, message: struct<content: array<struct<type: string, text: string>>>>"
    keep = [c for c in lines.columns if c != value]
    r = lines.select(*keep, F.from_json(value, shape).alias("r")).where("r.custom_id IS NOT NULL")
    raw = F.array_join(F.filter("r.result.message.content", lambda b: b["type"] == "text")["text"], "")
    good = F.col("r.result.type") == "succeeded"
    return r.select(F.col("r.custom_id").alias("custom_id"), F.when(good & (F.length(raw) > 0), raw).alias("raw"), F.when(~good, F.col("r.result.type")).alias("problem"), *keep)


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Rows of one table of text dumps: the lines between COPY <table> (...) FROM stdin; and \\. of each file, split at
    tabs; \\N is null, and \\t, \\n, \\r and \\\\ are decoded.

    Lines are ordered by (file, place of the block read, place in it), so a dump is read in blocks by many tasks; only
    the marks, two for each table of each file, are sorted together and broadcast.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id")).alias("place"), "value")
    begin = F.col("value").rlike(rf"^COPY (?:\w+\.)?{table} \([^)]*\) FROM stdin;$")
    marks = lines.where(F.col("value").rlike(r"^(COPY .* FROM stdin;|\\\.)$")).select("file", "place", begin.alias("begin"))
    marks = marks.withColumn("end", F.lead("place").over(Window.partitionBy("file").orderBy("place"))).where("begin")
    marks = marks.select(F.col("file").alias("_file"), F.col("place").alias("_from"), "end")
    inside = (F.col("file") == F.col("_file")) & (F.col("place") > F.col("_from")) & (F.col("end").isNull() | (F.col("place") < F.col("end")))
    row = lines.join(F.broadcast(marks), inside).select(F.split("value", "\t", -1).alias("p"))
    cell = lambda k: F.get("p", F.lit(k))
    return row.select(*[F.when(cell(k) != "\\N", _decoded(cell(k))).alias(c) for k, c in enumerate(columns)])


def _decoded(cell: Column) -> Column:
    pieces = F.split(cell, r"\\\\", -1)  # at doubled backslashes, which stand for one
    plain = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(pieces, plain), "\\")
