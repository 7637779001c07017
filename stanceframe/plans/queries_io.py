"""Registered source/sink round trips (SRC-1..9, SNK-1..5).

Each query writes data derived from the test tables to the shared scratch
folder (``spark.checkpoint.dir``) with a library sink, reads it back with the
library reader, and returns what was read; the oracle is the source data.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceframe.operators.cells import first_valid_cells
from stanceframe.sources import readers as R
from stanceframe.sources import sinks as K
from stanceframe.sources import fixtures as FX
from stanceframe.plans.registry import register
from stanceframe.plans.queries_analytics import ALL_CTE, QM_DOUBLES
from stanceframe.plans.queries_text import JBR_SQL, _jbr
from stanceframe.plans.queries_prefs import PREF_CTE, _pairs

SEP = "\x1f"
OUT_COLS = "ord, custom_id, status_code, prompt_tokens, completion_tokens, attempts, raw"
OUT_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("custom_id", T.StringType()),
    T.StructField("status_code", T.IntegerType()), T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()), T.StructField("attempts", T.LongType()),
    T.StructField("raw", T.StringType())])


@register("read_jsonl", f"SELECT {OUT_COLS} FROM fx_outputs")
def q_read_jsonl(spark, sf_dir):
    """SRC-5 (+SNK-2): batch outputs written as JSON lines and read back with a fixed schema."""
    from stanceframe.session import materialize
    p = K.write_jsonl(FX.batch_outputs(spark, sf_dir))
    # Spark refuses raw-JSON queries that reference only the corrupt-record column (a count
    # after this filter would); parse once into the shared folder, then filter
    df = materialize(R.read_jsonl(spark, p, OUT_SCHEMA))
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


@register("write_jsonl", PREF_CTE + "SELECT * FROM pairs")
def q_write_jsonl(spark, sf_dir):
    """SNK-2: preference pairs written as JSONL and read back."""
    pairs = _pairs(spark, sf_dir)
    p = K.write_jsonl(pairs)
    return R.read_jsonl(spark, p, pairs.schema).drop("_corrupt_record")


def _batch_lines(spark, sf_dir):
    o = FX.batch_outputs(spark, sf_dir)
    body = F.struct(F.array(F.struct(F.struct(F.col("raw").alias("content")).alias("message"))).alias("choices"),
                    F.struct(F.col("prompt_tokens"), F.col("completion_tokens")).alias("usage"))
    line = F.to_json(F.struct(F.col("custom_id"), F.struct(F.col("status_code"), body.alias("body")).alias("response")))
    return o.select(F.floor(F.col("ord") / 100).cast("bigint").alias("shard"), "ord", line.alias("value"))


@register("read_batch_outputs", """
SELECT CAST(floor(ord / 100) AS BIGINT) AS shard,
       CAST(row_number() OVER (PARTITION BY floor(ord / 100) ORDER BY ord) - 1 AS BIGINT) AS line_no,
       custom_id, status_code, raw AS content, prompt_tokens, completion_tokens, false AS bad_line
FROM fx_outputs""")
def q_read_batch_outputs(spark, sf_dir):
    """SRC-6: batch outputs as 100-line JSONL shards (a named file each, of one folder), read line by line."""
    from stanceframe.session import scratch_path
    from stanceframe.sources.shards import shard_number, write_shards
    path = write_shards(_batch_lines(spark, sf_dir), scratch_path(spark, "batch-shards"), "ord")
    b = R.read_batch_outputs(spark, path, glob="batch_*.jsonl")
    return b.select(shard_number(F.col("file_name")).alias("shard"), "line_no",
                    "custom_id", F.col("response.status_code").alias("status_code"),
                    F.element_at(F.col("response.body.choices"), 1)["message"]["content"].alias("content"),
                    F.col("response.body.usage.prompt_tokens").alias("prompt_tokens"),
                    F.col("response.body.usage.completion_tokens").alias("completion_tokens"), "bad_line")


@register("read_json_records", """
SELECT name, url, phd_country, current_institution, current_institution_country, year_of_phd_degree FROM fx_profiles""")
def q_read_json_records(spark, sf_dir):
    """SRC-1 (+SNK-1 array layout): profiles written as JSON-array files and read back."""
    p = K.write_json_array(FX.profiles(spark, sf_dir).drop("respondent"))
    return R.read_json_records(spark, p).select("name", "url", "phd_country", "current_institution",
                                                "current_institution_country", "year_of_phd_degree")


@register("read_response_map", """
SELECT lower(replace(c.c_name, '#', '-')) AS philosopher, a.question, a.score
FROM (SELECT respondent, question, min_by(score, ord) AS score FROM fx_answers WHERE model = 'human' GROUP BY ALL) a
JOIN customer c ON c.c_custkey = a.respondent""", ("score",))
def q_read_response_map(spark, sf_dir):
    """SRC-2: per-respondent answer maps written as JSON records, read back as long cells."""
    cells = first_valid_cells(FX.answers(spark, sf_dir).where("model = 'human'"), keys=("respondent", "question"))
    c = FX.table(spark, sf_dir, "customer")
    recs = (cells.groupBy("respondent")
            .agg(F.map_from_entries(F.collect_list(F.struct("question", F.col("score").cast("string"))))
                 .alias("responses"))
            .join(c, F.col("respondent") == F.col("c_custkey"))
            .select(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("philosopher"),
                    F.col("c_name").alias("name"), "responses"))
    p = K.write_json_array(recs)
    return R.read_response_map(spark, p).select("philosopher", "question", "score")


@register("read_question_options", """
SELECT CAST(row_number() OVER (ORDER BY question) - 1 AS BIGINT) AS q_pos, question,
       array_to_string(options, chr(31)) AS options FROM fx_options""")
def q_read_question_options(spark, sf_dir):
    """SRC-3: the question catalogue as one JSON object (sorted), read back in key order."""
    p = K.write_json_object(FX.question_options(spark, sf_dir), "question", "options")
    o = R.read_question_options(spark, p)
    return o.select("q_pos", "question", F.array_join("options", SEP).alias("options"))


@register("read_string_array", "SELECT url FROM fx_profiles")
def q_read_string_array(spark, sf_dir):
    """SRC-4: profile URLs written as JSON string arrays, read back."""
    arr_path = K.write_string_arrays(FX.profiles(spark, sf_dir), "url")
    return R.read_string_array(spark, arr_path).select(F.col("value").alias("url"))


def _pages_written(spark, sf_dir):
    """Every page as a file ``<page_id>_views.html`` of one folder."""
    from stanceframe.session import scratch_path
    from stanceframe.sources.shards import write_named
    pages = FX.table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit("_views.html")).alias("name"),
                                                    F.col("html").alias("value"))
    return write_named(pages, scratch_path(spark, "pages"), lines=False)


def _page_key():
    return F.regexp_extract("file_name", r"^(.*)_views\.html$", 1).alias("page_key")


@register("read_html_pages", "SELECT CAST(page_id AS VARCHAR) AS page_key, html FROM pages")
def q_read_html_pages(spark, sf_dir):
    """SRC-7: every page saved as its own file, read back whole (one row per file)."""
    return R.read_html_pages(spark, _pages_written(spark, sf_dir)).select(_page_key(), "html")


@register("existing_outputs", "SELECT CAST(page_id AS VARCHAR) AS page_key FROM pages")
def q_existing_outputs(spark, sf_dir):
    """SRC-9: names of page files already on disk (metadata only), keyed by page."""
    return R.list_existing(spark, _pages_written(spark, sf_dir), "*_views.html").select(_page_key())


def _metrics_roundtrip(spark, sf_dir, how):
    from stanceframe.operators.compare import quality_metrics
    from stanceframe.plans.queries_analytics import load_cells
    m = quality_metrics(load_cells(spark, sf_dir))
    m = m.checkpoint(eager=True)  # lineage cut: the writer and the returned frame share one result
    if how == "csv":
        return R.read_metrics_csv(spark, K.write_csv(m), m.schema)
    return spark.read.schema(m.schema).json(K.write_json(m))


@register("read_metrics_csv", ALL_CTE + "SELECT * FROM qm", QM_DOUBLES)
def q_read_metrics_csv(spark, sf_dir):
    """SRC-8 (+SNK-3): the metrics table written as CSV with a header and read back."""
    return _metrics_roundtrip(spark, sf_dir, "csv")


@register("write_csv", ALL_CTE + "SELECT * FROM qm", QM_DOUBLES)
def q_write_csv(spark, sf_dir):
    """SNK-3: CSV with header round trip of the metrics table."""
    return _metrics_roundtrip(spark, sf_dir, "csv")


@register("write_json", ALL_CTE + "SELECT * FROM qm", QM_DOUBLES)
def q_write_json(spark, sf_dir):
    """SNK-1: the metrics table written as JSON records and read back."""
    return _metrics_roundtrip(spark, sf_dir, "json")


@register("append_results", JBR_SQL + "SELECT custom_id, success FROM jbr")
def q_append_results(spark, sf_dir):
    """SNK-5: results appended twice by key; the second append adds nothing (idempotent)."""
    from stanceframe.session import scratch_path
    path = scratch_path(spark, "results")
    res = _jbr(spark, sf_dir).select("custom_id", "success")
    K.append_results(res, path, ["custom_id"])
    K.append_results(res, path, ["custom_id"])
    return spark.read.parquet(path)
