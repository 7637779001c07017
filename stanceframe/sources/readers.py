"""Sources (SRC-1..9) with explicit schemas (no inference) and explicit order columns.

JSON arrays are split across tasks by ``jsonarray``; line formats (JSONL, CSV) by Spark.  A JSON object per file and
a saved page are read one file per task: the first is a catalogue, the second small by its nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceframe.functions.text import coerce_score, name_from_file
from stanceframe.session import stored
from stanceframe.sources.jsonarray import ITEMS, array_items

PROFILE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("areas_of_specialization", T.ArrayType(T.StringType())),
    T.StructField("areas_of_interest", T.ArrayType(T.StringType())),
    T.StructField("phd_institution", T.StringType()), T.StructField("phd_country", T.StringType()),
    T.StructField("current_institution", T.StringType()),
    T.StructField("current_institution_country", T.StringType()),
    T.StructField("year_of_phd_degree", T.IntegerType()),
])

RESPONSE_MAP_SCHEMA = T.StructType([
    T.StructField("philosopher", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("responses", T.MapType(T.StringType(), T.StringType())),
])

BATCH_OUTPUT_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("status_code", T.IntegerType()),
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))]))),
            T.StructField("usage", T.StructType([T.StructField("prompt_tokens", T.LongType()),
                                                 T.StructField("completion_tokens", T.LongType())]))]))])),
])


def _whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    # the keyword matters: text()'s own wholetext=False default would override an option
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("file_path"),
                               F.col("_metadata.file_name").alias("file_name"), "value")


def read_json_records(spark: SparkSession, path: str, schema: T.StructType = PROFILE_SCHEMA) -> DataFrame:
    """SRC-1: files each holding one JSON array of records -> rows with (file_path, pos); a file is read by
    as many tasks as it has blocks."""
    return array_items(spark, path, schema).select("file_path", "pos", "item.*")


def read_response_map(spark: SparkSession, path: str, schema: T.StructType = RESPONSE_MAP_SCHEMA,
                      map_field: str = "responses") -> DataFrame:
    """SRC-2: records with an open-key answer map -> long (record, question, score).

    The map is read as ``map<string,string>`` and every value coerced on its own, so
    one bad value drops one cell, not the record (``from_json`` to a double map
    would null the whole map)."""
    recs = read_json_records(spark, path, schema)
    keys = [f.name for f in schema.fields if f.name != map_field]
    x = recs.select("file_path", "pos", *keys, F.posexplode(F.map_entries(F.col(map_field))).alias("q_pos", "kv"))
    return x.select("file_path", "pos", *keys, F.col("q_pos").cast("bigint").alias("q_pos"),
                    F.col("kv.key").alias("question"), coerce_score(F.col("kv.value")).alias("score"))


def read_question_options(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: one top-level JSON object question -> options; key order kept as ``q_pos``."""
    t = _whole_files(spark, path)
    m = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return (t.select(F.posexplode(F.map_entries(m)).alias("q_pos", "kv"))
            .select(F.col("q_pos").cast("bigint").alias("q_pos"), F.col("kv.key").alias("question"),
                    F.col("kv.value").alias("options")))


def read_string_array(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: JSON array(s) of plain strings -> (file_path, pos, value)."""
    return array_items(spark, path, T.StringType(), ITEMS).select("file_path", "pos", F.col("item").alias("value"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-5: JSON lines with a fixed schema; blank lines skipped; a malformed line keeps
    its text in ``_corrupt_record`` (PERMISSIVE) instead of failing the job.  Filter on that
    column only after persisting the parsed rows (Spark rejects raw-file queries that
    reference the corrupt-record column alone)."""
    s = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(s).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def read_batch_outputs(spark: SparkSession, path: str, glob: str | None = None,
                       schema: T.StructType = BATCH_OUTPUT_SCHEMA) -> DataFrame:
    """SRC-6: JSONL shard files -> (file_name, line_no, fields..., bad_line).

    Files are read line by line and split across tasks.  The lines are stored with their block's start, so a
    line's number is its place in its block plus the lines of the file's blocks before it.  Blank lines are
    skipped; a line that is not valid JSON is kept with ``bad_line = true`` (counted by
    ``batch_read_errors``), never fatal."""
    t = stored(spark.read.text(path, lineSep="\n", pathGlobFilter=glob).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line")), "jsonl-lines")
    blocks = t.groupBy("file_path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    lines = t.join(blocks, ["file_path", "block"]).withColumn("line_no", F.col("at") + F.col("shift"))
    lines = lines.where(F.trim("line") != "")
    bad = F.get_json_object("line", "$").isNull()
    return lines.select("file_path", "file_name", F.col("line_no").cast("bigint").alias("line_no"),
                        F.from_json("line", schema).alias("rec"), bad.alias("bad_line")).select(
        "file_path", "file_name", "line_no", "rec.*", "bad_line")


def batch_read_errors(outputs: DataFrame) -> DataFrame:
    return outputs.agg(F.count_if("bad_line").cast("bigint").alias("bad_lines"))


def read_html_pages(spark: SparkSession, path: str, glob: str = "*_views.html") -> DataFrame:
    """SRC-7: directory of saved pages -> (file_name, respondent, html); one file per row."""
    t = _whole_files(spark, path, glob)
    return t.select("file_path", "file_name", name_from_file(F.col("file_name")).alias("respondent"),
                    F.col("value").alias("html"))


def read_metrics_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-8: CSV with a header and an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def list_existing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-9: names of files that already exist (metadata only; contents are pruned)."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))
