"""Streaming ingest equals the batch rule and is idempotent on replay; generator hook."""

from pyspark.sql import functions as F

from stanceframe.operators import batch as B
from stanceframe.operators.cells import first_valid_cells
from stanceframe.operators.generate import generate_answers
from stanceframe.session import scratch_path
from stanceframe.sources import fixtures as FX
from stanceframe.streaming import ingest as ST

from .conftest import SF001


def test_stream_ingest_matches_batch_and_restarts_cleanly(spark):
    ans = FX.answers(spark, SF001)
    landing, sink = scratch_path(spark, "t-landing"), scratch_path(spark, "t-sink")
    ST.land_in_waves(ans, landing, "ord", waves=3)
    ckpt = scratch_path(spark, "t-ckpt")
    ST.stream_ingest_cells(spark, landing, sink, ckpt).awaitTermination()
    # a restart on the same checkpoint must neither re-emit nor lose rows
    ST.stream_ingest_cells(spark, landing, sink, ckpt).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(sink).select("model", "respondent", "question", "score").collect()))
    want = sorted(map(tuple, first_valid_cells(ans).select("model", "respondent", "question", "score").collect()))
    assert got == want


def test_ingest_passes_no_key_to_python_by_itself(spark):
    """Without expiry the flags are Spark's deduplication state; the smallest ``ord`` of a trigger still wins, null keys too."""
    landing = scratch_path(spark, "dedup-landing")
    rows = [("m", i % 50 or None, "q", float(i), 1000 - i) for i in range(1000)] + [("m", 3, "q", None, 0)]
    spark.createDataFrame(rows, ST.ANSWER_SCHEMA).repartition(4).write.json(landing)
    spark.createDataFrame([("m", 1, "q", -1.0, 0), ("n", 1, "q", 5.0, 7)], ST.ANSWER_SCHEMA).coalesce(1).write.mode("append").json(landing)
    sink = scratch_path(spark, "dedup-sink")
    q = ST.stream_ingest_cells(spark, landing, sink, scratch_path(spark, "dedup-ckpt"), max_files_per_trigger=4)
    q.awaitTermination()
    assert {p["stateOperators"][0]["operatorName"] for p in q.recentProgress} == {"dedupe"}
    got = {(r["model"], r["respondent"]): r["score"] for r in spark.read.parquet(sink).collect()}
    assert got == {**{("m", i or None): 950.0 + i for i in range(50)}, ("n", 1): 5.0}
    # rows reduced several times within a task
    many = spark.range(3 * ST.REDUCE_ROWS).selectExpr("id % 7 as k", "-id as ord").coalesce(1)
    assert sorted(map(tuple, ST._first_of_trigger(many, ["k"]).collect())) == sorted(
        (k, -max(i for i in range(3 * ST.REDUCE_ROWS - 7, 3 * ST.REDUCE_ROWS) if i % 7 == k)) for k in range(7))


def _waves(spark, n, keys_each):
    landing = scratch_path(spark, "ttl-landing")
    for k in range(n):
        rows = [("m", k * keys_each + i, "q", float(k), k * 100 + i) for i in range(keys_each)] + [("m", 0, "q", 9.0, 10_000 + k)]
        spark.createDataFrame(rows, ST.ANSWER_SCHEMA).coalesce(1).write.mode("append").json(landing)
    return landing


def test_ingest_state_expires(spark):
    """Flags that live a moment: the state stays as large as a trigger, and a late duplicate is a first arrival again."""
    landing = _waves(spark, 3, 20)
    got = {}
    for name, ttl in (("short", 1), ("never", None)):
        sink = scratch_path(spark, f"ttl-sink-{name}")
        q = ST.stream_ingest_cells(spark, landing, sink, scratch_path(spark, f"ttl-ckpt-{name}"), expire_after_ms=ttl)
        q.awaitTermination()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
        rows = spark.read.parquet(sink).collect()
        got[name] = (sizes, sorted(r["respondent"] for r in rows))
        first = [r for r in rows if r["respondent"] == 0 and r["ord"] == 0]
        assert len(first) == 1 and first[0]["score"] == 0.0
    assert len(got["never"][0]) == 3 and got["never"][1] == list(range(60))
    assert got["never"][0][-1] == 60 and max(got["short"][0]) < 60
    assert got["short"][1] == sorted([*range(60), 0, 0])


def test_stream_outcomes(spark):
    recs = spark.createDataFrame([("a", True, 1, 1.0, 1), ("a", False, 5, 2.0, 2), ("b", True, 2, None, 3)],
                                 "model string, success boolean, attempts bigint, generation_time double, ord bigint")
    landing, sink = scratch_path(spark, "o-landing"), scratch_path(spark, "o-sink")
    ST.land_in_waves(recs, landing, "ord", waves=2)
    ST.stream_run_outcomes(spark, landing, sink, scratch_path(spark, "o-ckpt")).awaitTermination()
    out = {r["model"]: r for r in ST.latest_outcomes(spark, sink).collect()}
    assert out["a"]["processed"] == 2 and out["a"]["n_failed"] == 1 and out["b"]["n_retried"] == 1


def test_generate_answers_retries(spark):
    def gen(prompt, temperature, max_tokens, attempt=1):
        if prompt == "good":
            return '["Accept: yes"]'
        if prompt == "late":
            return "hmm" if attempt < 3 else '["Accept: yes"]'
        raise RuntimeError("down")

    req = spark.createDataFrame([("r1", "good", ["Accept: yes"]), ("r2", "late", ["Accept: yes"]),
                                 ("r3", "bad", ["Accept: yes"])], "custom_id string, prompt string, options array<string>")
    out = {r["custom_id"]: r for r in generate_answers(req.coalesce(1), gen, max_retries=5)
           .withColumn("chosen", B.first_valid_attempt("all_attempts")).collect()}
    assert out["r1"]["success"] and out["r1"]["attempts"] == 1
    assert out["r2"]["success"] and out["r2"]["attempts"] == 3 and out["r2"]["chosen"]["attempt"] == 3
    assert not out["r3"]["success"] and out["r3"]["attempts"] == 5 and out["r3"]["error"].startswith("Exception")
    assert out["r3"]["chosen"]["attempt"] == 5
    assert [a["validation_msg"] for a in out["r2"]["all_attempts"]][:2] == ["Invalid options: ['hmm']"] * 2


def test_generate_answers_query_returns_recorded_outputs(spark):
    from stanceframe.plans import queries_stream as Q
    from stanceframe.plans import queries_text as QT
    from stanceframe.sources import fixtures as FX
    recorded = {}
    for r in (FX.batch_outputs(spark, SF001).join(FX.request_mapping(spark, SF001), "custom_id").orderBy("ord").collect()):
        recorded.setdefault((r["philosopher_name"], r["question"]), []).append(r["raw"] if r["status_code"] == 200 else None)
    key = {r["custom_id"]: (r["philosopher_name"], r["question"]) for r in QT._requests(spark, SF001).collect()}
    out = Q._generated(spark, SF001).collect()
    assert {r["custom_id"] for r in out} == set(key) and any(r["success"] for r in out)
    for r in out:
        want = [*recorded.get(key[r["custom_id"]], []), None, None, None, None, None][:5]
        log = r["all_attempts"]
        assert [a["raw"] for a in log] == want[:len(log)] and (r["success"] or len(log) == 5)
        assert all((a["error"] is None) == (a["raw"] is not None) for a in log)


def test_later_rounds_neither_join_nor_shuffle_prompts(spark, monkeypatch):
    from stanceframe.operators import generate as G
    plans, real = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    req = spark.createDataFrame([(f"r{i}", "p", ["Accept: yes"]) for i in range(20)], "custom_id string, prompt string, options array<string>")
    out = G.generate_answers(req, lambda p, t, m, attempt=1: "no" if attempt < 3 else '["Accept: yes"]').collect()
    assert {(r["custom_id"], r["attempts"], r["success"]) for r in out} == {(f"r{i}", 3, True) for i in range(20)}
    assert len(plans) == 3 and not any("Join" in p or "Exchange" in p for p in plans)
