"""Model-evaluation bookkeeping: requests, batch results, rejects, costs, outcomes.

JOIN-5..8, EXP-10..14 applied, AGG-3 on model answers, AGG-15, AGG-16,
AGG-19, SNK-4 (shard numbering), FLT-2, UDF-2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.functions import prompts as P
from stanceframe.functions import text as T
from stanceframe.operators.ordering import dense_index


# --- JOIN-5 / WIN-1: request table ----------------------------------------------

def build_requests(respondents: DataFrame, questions: DataFrame, limit: int | None = None,
                   resp_order: Sequence[str] = ("respondent",), q_order: Sequence[str] = ("question",),
                   site: str = P.DEFAULT_SITE) -> DataFrame:
    """Respondents x questions in respondent-major order, ``req_{n}`` ids, prompts.

    The persona prompt is built once per respondent (before the expansion).  Every
    respondent is expanded to the question positions 0..n-1 and meets the catalogue
    in an equi-join on the position; a small catalogue is broadcast by its measured size.
    Request number n = resp_pos * n_questions + q_pos, so no global window.
    """
    qs = dense_index(questions.select(*q_order, *[c for c in questions.columns if c not in q_order]),
                     list(q_order), "q_pos")
    n_q = qs.count()
    resp = dense_index(respondents, list(resp_order), "resp_pos")
    resp = resp.withColumn("persona_prompt", P.persona_prompt())
    positions = F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint")) if n_q else F.array().cast("array<bigint>")
    drop = [c for c in ("question", "options") if c in resp.columns]
    req = (resp.drop(*drop).withColumn("q_pos", F.explode(positions))
           .join(qs.select("q_pos", "question", "options"), "q_pos")
           .withColumn("req_no", F.col("resp_pos") * F.lit(n_q) + F.col("q_pos")))
    if limit is not None:
        req = req.where(F.col("req_no") < limit)
    return req.select(
        F.concat(F.lit("req_"), F.col("req_no").cast("string")).alias("custom_id"), "req_no",
        F.coalesce(F.col("name"), F.lit("Unknown")).alias("philosopher_name"), "question",
        F.concat(F.col("persona_prompt"), P.question_prompt(F.col("question"), F.col("options"), site)).alias("prompt"))


# --- JOIN-6 / JOIN-7: batch outputs -----------------------------------------------

def join_batch_results(outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """JOIN-6: outputs LEFT JOIN id mapping; status 200 -> success record with the parsed
    list, otherwise an error record ``HTTP <status>``; missing mapping -> ``Unknown``."""
    j = outputs.join(mapping, "custom_id", "left")
    ok = F.col("status_code") == 200
    return j.select(
        "custom_id", "ord",
        F.coalesce(F.col("philosopher_name"), F.lit("")).alias("philosopher_name"),
        F.coalesce(F.col("question"), F.lit("Unknown")).alias("question"),
        ok.alias("success"),
        F.when(ok, T.parse_response_list(F.col("raw"))).otherwise(F.array().cast("array<string>")).alias("parsed"),
        F.when(ok, F.col("raw")).otherwise(F.lit("")).alias("raw"),
        F.when(ok, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).alias("error"),
        F.when(ok, F.col("prompt_tokens")).otherwise(F.lit(0)).cast("bigint").alias("input_tokens"),
        F.when(ok, F.col("completion_tokens")).otherwise(F.lit(0)).cast("bigint").alias("output_tokens"))


REJECT_REASONS = ["no mapping", "non-200 status", "no choices", "empty content", "unparsable"]


def classify_batch_results(outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """JOIN-7: one ``reject_reason`` per output row (NULL = accepted), first failing check wins."""
    j = outputs.join(mapping.withColumn("_mapped", F.lit(True)), "custom_id", "left")
    content = F.col("raw")
    parsed = T.extract_json_list(content)
    reason = (F.when(F.col("_mapped").isNull(), F.lit(REJECT_REASONS[0]))
              .when(F.col("status_code") != 200, F.lit(REJECT_REASONS[1]))
              .when(content.isNull(), F.lit(REJECT_REASONS[2]))
              .when(content == "", F.lit(REJECT_REASONS[3]))
              .when(F.coalesce(F.size(parsed), F.lit(0)) <= 0, F.lit(REJECT_REASONS[4])))
    return j.select("custom_id", "ord", "philosopher_name", "question", "prompt_tokens", "completion_tokens",
                    reason.alias("reject_reason"),
                    F.transform(parsed, lambda x: T.canonicalize_stance(x)).alias("parsed"))


def batch_results_clean(outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Accepted rows, each parsed item rewritten to canonical ``Stance: answer``."""
    return classify_batch_results(outputs, mapping).where(F.col("reject_reason").isNull()).drop("reject_reason")


def batch_reject_counts(outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rejected rows counted by reason."""
    return (classify_batch_results(outputs, mapping).where(F.col("reject_reason").isNotNull())
            .groupBy("reject_reason").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


# --- FLT-2 / AGG-3 on model answers ------------------------------------------------

def usable_responses(records: DataFrame) -> DataFrame:
    """FLT-2: records with a name, a question and ``success``."""
    return records.where((F.coalesce(F.col("philosopher_name"), F.lit("")) != "")
                         & (F.coalesce(F.col("question"), F.lit("")) != "")
                         & F.coalesce(F.col("success"), F.lit(False)))


def answer_items(records: DataFrame) -> DataFrame:
    """Explode usable records into parsed items with stance, cell key and score."""
    u = usable_responses(records)
    # posexplode_outer: a plain explode makes Catalyst infer size(parsed) > 0 on the input and
    # push it below the projection that parses, evaluating the parse several times
    it = (u.select("philosopher_name", "question", "ord", F.posexplode_outer("parsed").alias("item_pos", "item"))
          .where(F.col("item").isNotNull()))
    it = it.withColumn("_s", T.py_strip(F.col("item"))).withColumn("_low", F.lower(F.col("_s")))
    ps = T.parse_stance_prefix(F.col("item"), F.col("_s"), F.col("_low"))
    it = it.select("*", ps["stance"].alias("stance"), ps["answer"].alias("answer")).where(F.col("stance").isNotNull())
    return it.select("philosopher_name", "question", "ord", "item_pos", "item", "stance", "answer",
                     T.cell_key(F.col("question"), F.col("stance"), F.col("answer")).alias("cell_key"),
                     F.coalesce(T.score_stance(F.col("stance")),
                                F.when(F.col("stance") == T.AGNOSTIC, F.lit(0.5))).alias("score"))


def first_valid_model_cells(records: DataFrame) -> DataFrame:
    """AGG-3: first scored item per (respondent name, cell key) by (record, item) order."""
    it = answer_items(records).where(F.col("score").isNotNull())
    return (it.groupBy("philosopher_name", "cell_key")
            .agg(F.min_by(F.col("score"), F.struct("ord", "item_pos")).alias("score"),
                 F.min(F.struct("ord", "item_pos")).alias("first_at")))


# --- JOIN-8 -------------------------------------------------------------------------

def pending_tasks(tasks: DataFrame, completed: DataFrame, limit: int | None = None,
                  keys: Sequence[str] = ("philosopher_name", "question"), order: str = "req_no") -> DataFrame:
    """Tasks minus completed keys (two-column key: no clash when a name holds pipes), then
    the first ``limit`` by task order."""
    rest = tasks.join(completed.select(*keys).distinct(), list(keys), "left_anti")
    if limit is not None:
        rest = rest.orderBy(order).limit(limit)
    return rest


# --- SNK-4 / AGG-19 ---------------------------------------------------------------

def assign_shards(requests: DataFrame, size: int = 100, order: str = "req_no") -> DataFrame:
    """Fixed-size numbered shards: shard = floor(req_no / size)."""
    return requests.withColumn("shard", F.floor(F.col(order) / size).cast("bigint"))


def shard_manifest(sharded: DataFrame, success: str | None = None) -> DataFrame:
    """One row per shard: request count, and a status when a success flag (null: no result yet) is given:
    ``pending`` without any result, ``active`` with some missing, ``completed`` when every request
    succeeded, else ``failed``."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("num_requests")]
    if success is not None:
        done, every = F.count(F.col(success)), F.count(F.lit(1))
        aggs.append(F.when(done == 0, F.lit("pending")).when(done < every, F.lit("active"))
                    .when(F.bool_and(F.col(success)), F.lit("completed")).otherwise(F.lit("failed")).alias("status"))
    return sharded.groupBy("shard").agg(*aggs)


def shard_status(manifest: DataFrame) -> DataFrame:
    """AGG-19: shard counts by status."""
    return manifest.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n_shards"))


# --- AGG-15 / AGG-16 --------------------------------------------------------------

def token_cost(results: DataFrame, price_in: float, price_out: float,
               by: Sequence[str] = ()) -> DataFrame:
    """AGG-15: token totals and cost = tokens / 1e6 * price (prices per million tokens)."""
    g = results.groupBy(*by) if by else results.groupBy()
    agg = g.agg(F.sum("input_tokens").cast("bigint").alias("input_tokens"),
                F.sum("output_tokens").cast("bigint").alias("output_tokens"),
                F.count(F.lit(1)).cast("bigint").alias("n_requests"),
                F.count_if("success").cast("bigint").alias("n_success"))
    return agg.select("*", (F.col("input_tokens") / 1e6 * price_in).alias("input_cost"),
                      (F.col("output_tokens") / 1e6 * price_out).alias("output_cost")) \
        .withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))


def token_cost_by_family(results: DataFrame, prices: DataFrame, family: str = "family") -> DataFrame:
    """AGG-15 with a price table ``(family, price_in, price_out)``: totals per family, then its own prices.

    A family without prices keeps its totals with NULL costs."""
    agg = results.groupBy(family).agg(F.sum("input_tokens").cast("bigint").alias("input_tokens"),
                                      F.sum("output_tokens").cast("bigint").alias("output_tokens"),
                                      F.count(F.lit(1)).cast("bigint").alias("n_requests"),
                                      F.count_if("success").cast("bigint").alias("n_success"))
    x = agg.join(prices.select(family, "price_in", "price_out"), family, "left")
    return (x.withColumn("input_cost", F.col("input_tokens") / 1e6 * F.col("price_in"))
            .withColumn("output_cost", F.col("output_tokens") / 1e6 * F.col("price_out"))
            .withColumn("total_cost", F.col("input_cost") + F.col("output_cost")).drop("price_in", "price_out"))


def run_outcomes(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-16: processed, success, failed, retried (success with attempts > 1), rates, avg time."""
    g = records.groupBy(*by) if by else records.groupBy()
    agg = g.agg(F.count(F.lit(1)).cast("bigint").alias("processed"),
                F.count_if("success").cast("bigint").alias("n_success"),
                F.count_if(~F.col("success")).cast("bigint").alias("n_failed"),
                F.count_if(F.col("success") & (F.col("attempts") > 1)).cast("bigint").alias("n_retried"),
                F.avg("generation_time").alias("avg_time"))
    pct = lambda c: F.try_divide(F.lit(100.0) * F.col(c), F.col("processed").cast("double"))
    return agg.select("*", pct("n_success").alias("pct_success"), pct("n_retried").alias("pct_retried"),
                      pct("n_failed").alias("pct_failed"))


# --- UDF-2 --------------------------------------------------------------------------

def first_valid_attempt(attempts: str = "all_attempts") -> 'F.Column':
    """UDF-2: the first attempt marked valid, else the last attempt (with its error)."""
    a = F.col(attempts)
    valid = F.filter(a, lambda x: F.coalesce(x["valid"], F.lit(False)))
    return F.when(F.size(valid) > 0, F.element_at(valid, 1)).otherwise(F.element_at(a, -1))
