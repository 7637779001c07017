"""Registered streaming and generator-hook queries (STR-1, STR-2, UDF-1, UDF-2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stanceframe.operators import batch as B
from stanceframe.operators.generate import generate_answers
from stanceframe.plans import sqltext as S
from stanceframe.plans.queries_text import REQ_SQL, _requests, invalid_message_sql, validate_items_sql
from stanceframe.plans.registry import register
from stanceframe.session import scratch_path
from stanceframe.sources import fixtures as FX
from stanceframe.streaming import ingest as ST


@register("stream_ingest_cells", "SELECT model, respondent, question, score FROM cells", ("score",))
def q_stream_ingest_cells(spark, sf_dir):
    """STR-1: answers land as four successive file drops; a file-source stream keeps the
    first answer per cell (state-store flag per key, parquet file sink)."""
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("landing", "cells-sink", "cells-ckpt"))
    ST.land_in_waves(FX.answers(spark, sf_dir), landing, "ord", waves=4)
    q = ST.stream_ingest_cells(spark, landing, sink, ckpt, max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(sink).select("model", "respondent", "question", "score")


OUTCOME_SQL = """
SELECT CASE CAST(ord % 3 AS INT) WHEN 0 THEN 'human' WHEN 1 THEN 'm1' ELSE 'm2' END AS model,
       CAST(count(*) AS BIGINT) AS processed, CAST(count_if(status_code = 200) AS BIGINT) AS n_success,
       CAST(count_if(status_code <> 200) AS BIGINT) AS n_failed,
       CAST(count_if(status_code = 200 AND attempts > 1) AS BIGINT) AS n_retried,
       sum(completion_tokens / 10.0 + attempts) AS total_time
FROM fx_outputs GROUP BY 1"""


@register("stream_run_outcomes", OUTCOME_SQL, ("total_time",))
def q_stream_run_outcomes(spark, sf_dir):
    """STR-2: running outcome counts per model over a stream of result records."""
    o = FX.batch_outputs(spark, sf_dir)
    recs = o.select(F.when(F.col("ord") % 3 == 0, "human").when(F.col("ord") % 3 == 1, "m1").otherwise("m2")
                    .alias("model"), (F.col("status_code") == 200).alias("success"), "attempts",
                    (F.col("completion_tokens") / 10.0 + F.col("attempts")).alias("generation_time"), "ord")
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("outcomes-landing", "outcomes-sink", "outcomes-ckpt"))
    ST.land_in_waves(recs, landing, "ord", waves=4)
    q = ST.stream_run_outcomes(spark, landing, sink, ckpt, max_files_per_trigger=2)
    q.awaitTermination()
    return ST.latest_outcomes(spark, sink).select(
        "model", *[F.col(c).cast("bigint").alias(c) for c in ("processed", "n_success", "n_failed", "n_retried")],
        F.col("total_time").cast("double").alias("total_time"))


def recorded_answer(prompt: str, temperature: float, max_tokens: int, attempt: int = 1, recorded=None) -> str:
    """The recorded text of this attempt; an attempt without one fails as a call would."""
    text = recorded[attempt - 1] if recorded is not None and len(recorded) >= attempt else None
    if text is None:
        raise LookupError("no recorded output")
    return text


def _recorded_requests(spark, sf_dir, max_retries):
    """Requests with the batch outputs of their respondent and question, one attempt each in their order (null if the call failed)."""
    keys = ["philosopher_name", "question"]
    outputs = (FX.batch_outputs(spark, sf_dir).join(FX.request_mapping(spark, sf_dir), "custom_id")
               .withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("_k") <= max_retries)
               .select(*keys, F.struct("_k", F.when(F.col("status_code") == 200, F.col("raw")).alias("raw")).alias("_a"))
               .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_a")), lambda a: a["raw"]).alias("recorded")))
    return (_requests(spark, sf_dir).join(FX.question_options(spark, sf_dir), "question")
            .join(outputs, keys, "left"))


def _generated(spark, sf_dir):
    return generate_answers(_recorded_requests(spark, sf_dir, 5), recorded_answer, max_retries=5)


# every try of a request judged on its own record; the first valid one ends the request's tries
GENERATED_SQL = REQ_SQL + f"""
, record AS (SELECT m.philosopher_name, m.question, row_number() OVER (PARTITION BY m.philosopher_name, m.question ORDER BY o.ord) AS k,
                    CASE WHEN o.status_code = 200 THEN o.raw END AS raw FROM fx_outputs o JOIN fx_mapping m USING (custom_id)),
  asked AS (SELECT r.custom_id, r.philosopher_name, r.question, o.options, unnest(range(1, 6)) AS k FROM reqs r JOIN fx_options o ON o.question = r.question),
  tried AS (SELECT a.custom_id, a.k, a.options, c.raw, CASE WHEN c.raw IS NOT NULL THEN {S.parse_response_list('c.raw')} END AS items
            FROM asked a LEFT JOIN record c ON c.philosopher_name = a.philosopher_name AND c.question = a.question AND c.k = a.k),
  checked AS (SELECT custom_id, k, raw, items, {validate_items_sql('items', 'options')} AS inv FROM tried),
  judged AS (SELECT custom_id, k, raw, items, inv, raw IS NOT NULL AND len(items) > 0 AND len(inv) = 0 AS valid FROM checked),
  final AS (SELECT custom_id, coalesce(min(CASE WHEN valid THEN k END), 5) AS attempts, bool_or(valid) AS success FROM judged GROUP BY custom_id)
SELECT f.custom_id, f.success, array_to_string(coalesce(j.items, []::VARCHAR[]), chr(31)) AS parsed,
       CASE WHEN f.success THEN NULL WHEN j.raw IS NULL THEN 'Exception after 5 attempts: LookupError: no recorded output'
            WHEN len(j.items) = 0 THEN 'Max retries reached. Last validation: Empty response'
            ELSE 'Max retries reached. Last validation: ' || {invalid_message_sql('j.inv')} END AS error,
       CAST(f.attempts AS INT) AS attempts, CAST(f.attempts AS INT) AS n_logged
FROM final f JOIN judged j ON j.custom_id = f.custom_id AND j.k = f.attempts"""


@register("generate_answers", GENERATED_SQL)
def q_generate_answers(spark, sf_dir):
    """UDF-1: every request answered from the recorded batch outputs with up to 5 validated tries."""
    g = _generated(spark, sf_dir)
    return g.select("custom_id", "success", F.array_join("parsed", "\x1f").alias("parsed"), "error", "attempts",
                    F.size("all_attempts").alias("n_logged"))


@register("first_valid_attempt", """
SELECT custom_id, CASE WHEN status_code = 200 THEN 1 + ord % attempts ELSE attempts END AS attempt, status_code = 200 AS valid,
       CASE WHEN status_code = 200 THEN 'Valid' ELSE 'HTTP ' || status_code END AS validation_msg FROM fx_outputs""")
def q_first_valid_attempt(spark, sf_dir):
    """UDF-2: the first valid attempt of each request's log, else its last attempt.  The logs are shaped from
    the batch outputs: as many attempts as the output counts, valid from some attempt on if it succeeded."""
    ok = F.col("status_code") == 200
    log = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("attempts")), lambda i: F.struct(
        i.alias("attempt"), (ok & (i >= 1 + F.col("ord") % F.col("attempts"))).alias("valid"),
        F.when(~ok, F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
        .when(i >= 1 + F.col("ord") % F.col("attempts"), "Valid").otherwise("Empty response").alias("validation_msg")))
    g = FX.batch_outputs(spark, sf_dir).withColumn("all_attempts", log).withColumn("chosen", B.first_valid_attempt("all_attempts"))
    return g.select("custom_id", F.col("chosen.attempt").alias("attempt"), F.col("chosen.valid").alias("valid"),
                    F.col("chosen.validation_msg").alias("validation_msg"))
