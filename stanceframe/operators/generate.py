"""UDF-1: answers from a caller-supplied text generator, with validation and retries.

Tries run as rounds.  Round k calls ``generate(prompt, temperature, max_tokens)``
(plus ``attempt=k`` when the callable accepts it) for every still-pending request
in one ``mapInArrow`` pass, and the round's output is written at once so
the generator is never called twice for the same try, even when a later stage is
recomputed or an executor is lost.  Parsing and validation are the Catalyst
``parse_response_list`` / ``validate_response``.  A request whose answer did not validate is written with its
prompt and its log so far, which the next round reads: no round joins or shuffles prompts.  The rounds
end when nothing is pending.  The attempt log per request has at most ``max_retries`` entries; it is grouped
by id at the end, without prompts.

No network client ships with the library; the function is the caller's (tests
use a deterministic local one).  A task has at most ``in_flight`` calls under way at a time.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from stanceframe.functions import text as T
from stanceframe.session import materialize

Generator = Callable[..., str]

CALL_FIELDS = [ST.StructField("raw", ST.StringType()), ST.StructField("time", ST.DoubleType()), ST.StructField("error", ST.StringType())]
ATTEMPT = ("struct<attempt:int,parsed:array<string>,raw:string,valid:boolean,validation_msg:string,time:double,error:string>")


def _caller(generate: Generator, attempt: int, temperature: float, max_tokens: int, in_flight: int):
    try:
        takes = set(inspect.signature(generate).parameters)
    except (TypeError, ValueError):
        takes = set()

    def call(request: tuple) -> tuple[str | None, float, str | None]:
        prompt, recorded = request
        t0 = time.time()
        try:
            kw = {k: v for k, v in (("attempt", attempt), ("recorded", recorded)) if k in takes}
            return generate(prompt, temperature, max_tokens, **kw), time.time() - t0, None
        except Exception as e:  # noqa: BLE001 - recorded as a failed try
            return None, 0.0, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # as many calls under way as threads; map() keeps the order.  The other columns pass as they are
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                requests = zip(batch.column("prompt").to_pylist(), batch.column("recorded").to_pylist(), strict=True)
                done = list(map(call, requests) if in_flight == 1 else pool.map(call, requests))
                raws, times, errors = zip(*done, strict=True) if done else ((), (), ())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raws, pa.string()), pa.array(times, pa.float64()), pa.array(errors, pa.string())],
                                                 names=[*batch.schema.names, *(f.name for f in CALL_FIELDS)])
    return run


def generate_answers(requests: DataFrame, generate: Generator, max_retries: int = 5, temperature: float = 0.0,
                     max_tokens: int = 100, in_flight: int = 1) -> DataFrame:
    """Requests ``(custom_id, prompt, options)`` -> one answer record per request:
    ``success, parsed, raw, error, generation_time, attempts, all_attempts``.

    Where requests carry ``recorded`` (texts by attempt), a callable that accepts ``recorded`` gets it too."""
    recorded = F.col("recorded") if "recorded" in requests.columns else F.lit(None)
    pending = requests.select(F.col("custom_id").cast("string").alias("custom_id"), "prompt", F.col("options").cast("array<string>").alias("options"),
                              recorded.cast("array<string>").alias("recorded"), F.array().cast(f"array<{ATTEMPT}>").alias("log"))
    finished = []
    for k in range(1, max_retries + 1):
        called = pending.mapInArrow(_caller(generate, k, temperature, max_tokens, in_flight), ST.StructType(pending.schema.fields + CALL_FIELDS))
        # one step a column, so that none runs again for a use of its result
        judged = called.withColumn("parsed", F.when(F.col("error").isNull(), T.parse_response_list(F.col("raw"))))
        judged = judged.withColumn("v", F.when(F.col("error").isNull(), T.validate_response(F.col("parsed"), F.col("options"))))
        attempt = F.struct(F.lit(k).alias("attempt"), "parsed", "raw", F.col("v.valid").alias("valid"), F.col("v.message").alias("validation_msg"),
                           "time", "error").cast(ATTEMPT)
        is_open = ~F.coalesce(F.col("v.valid"), F.lit(False))
        r = judged.select("custom_id", "prompt", "options", "recorded", F.concat("log", F.array(attempt)).alias("log"), is_open.alias("is_open"))
        if k == max_retries:
            finished.append(materialize(r.select("custom_id", "log")))
            break
        r = materialize(r.select("custom_id", *(F.when(F.col("is_open"), F.col(c)).alias(c) for c in ("prompt", "options", "recorded")), "log", "is_open"))
        finished.append(r.where(~F.col("is_open")).select("custom_id", "log"))
        pending = r.where("is_open").drop("is_open")
        if pending.isEmpty():
            break
    log = finished[0]
    for r in finished[1:]:
        log = log.unionByName(r)
    per = log.groupBy("custom_id").agg(F.array_sort(F.flatten(F.collect_list("log"))).alias("all_attempts"))
    last = F.element_at("all_attempts", -1)
    ok = F.coalesce(last["valid"], F.lit(False))
    n = F.size("all_attempts")
    err = (F.when(ok, F.lit(None).cast("string"))
           .when(last["error"].isNotNull(),
                 F.concat(F.lit(f"Exception after {max_retries} attempts: "), last["error"]))
           .otherwise(F.concat(F.lit("Max retries reached. Last validation: "), last["validation_msg"])))
    return per.select(
        "custom_id", ok.alias("success"),
        F.coalesce(last["parsed"], F.array().cast("array<string>")).alias("parsed"),
        F.coalesce(last["raw"], F.lit("")).alias("raw"), err.alias("error"),
        F.aggregate("all_attempts", F.lit(0.0), lambda acc, a: acc + a["time"]).alias("generation_time"),
        n.cast("int").alias("attempts"), "all_attempts")
