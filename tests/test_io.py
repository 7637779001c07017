"""Readers: bad and blank lines in batch shards, JSONL corrupt records, JSON arrays."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceframe.session import materialize, scratch_path
from stanceframe.sources import jsonarray
from stanceframe.sources import readers as R
from stanceframe.sources import sinks as K


def test_batch_outputs_bad_and_blank_lines(spark):
    path = scratch_path(spark, "shard-test")
    lines = ['{"custom_id": "a", "response": {"status_code": 200}}', "", "{not json",
             '{"custom_id": "b", "response": {"status_code": 500}}']
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    df = R.read_batch_outputs(spark, path, glob="part-*")
    rows = sorted((r["line_no"], r["custom_id"], r["bad_line"]) for r in df.collect())
    assert rows == [(0, "a", False), (2, None, True), (3, "b", False)]
    assert R.batch_read_errors(df).first()["bad_lines"] == 1


def test_batch_outputs_are_numbered_across_splits(spark):
    path = scratch_path(spark, "shard-splits")
    for name, n in (("a", 300), ("b", 170)):
        lines = ["" if i % 7 == 3 else f'{{"custom_id": "{name}{i}"}}' for i in range(n)]
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{path}/shard={name}")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = R.read_batch_outputs(spark, path, glob="part-*")
        raw = spark.read.text(path, wholetext=False, pathGlobFilter="part-*")
        assert raw.select("_metadata.file_block_start").distinct().count() > 2  # files are split
        assert all("jsonl-lines" in f for f in df.inputFiles())  # stored lines, not whole files
        got = sorted((r["custom_id"], r["line_no"]) for r in df.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted((f"{name}{i}", i) for name, n in (("a", 300), ("b", 170)) for i in range(n) if i % 7 != 3)


def test_jsonl_corrupt_record_kept(spark):
    path = scratch_path(spark, "jsonl-test")
    spark.createDataFrame([('{"x": 1}',), ("oops",)], "value string").coalesce(1).write.text(path)
    from pyspark.sql import types as T
    df = materialize(R.read_jsonl(spark, path, T.StructType([T.StructField("x", T.LongType())])))
    got = sorted(((r["x"], r["_corrupt_record"]) for r in df.collect()), key=repr)
    assert got == [(1, None), (None, "oops")]


def test_json_array_round_trip(spark):
    df = spark.createDataFrame([("n1", "u1"), ("n2", "u2")], "name string, url string").repartition(2)
    got = sorted((r["name"], r["url"]) for r in R.read_json_records(spark, K.write_json_array(df)).collect())
    assert got == [("n1", "u1"), ("n2", "u2")]


def _hard_text(rng):
    return "".join(rng.choice(['"', "\\", "},", "{", "}", "[", "]", ",", "é", "😀", "\n", " ", "a", "\\\\", '\\"', "},{"]) for _ in range(rng.randint(0, 25)))


def test_one_json_array_is_read_by_many_tasks(spark):
    """Arrays cut into splits of 64 bytes, in several layouts, against Python's own reader."""
    rng = random.Random(8)
    path = scratch_path(spark, "json-split")
    files, texts = {}, {}
    layouts = [dict(), dict(indent=2), dict(separators=(",", ":")), dict(separators=(" , ", " : ")), dict(ensure_ascii=False)]
    for k in range(10):
        recs = [{"name": _hard_text(rng), "tags": [_hard_text(rng) for _ in range(rng.randint(0, 3))],
                 "responses": {f"q{j}": _hard_text(rng) for j in range(rng.randint(0, 3))}} for _ in range(rng.choice([0, 1, 2, 40]))]
        files[f"part-{k}.json"] = recs
        texts[f"part-{k}.json"] = json.dumps(recs, **layouts[k % 5])
    texts["object.json"], files["object.json"] = '{"name": "alone", "tags": [], "responses": {"a": "b"}}', [{"name": "alone", "tags": [], "responses": {"a": "b"}}]
    texts["space.json"], files["space.json"] = " \n [ ] \n", []
    texts["broken.json"], files["broken.json"] = '[{"name": "x"}, {"name": oops}, {"name": "z"}]', None
    for name, text in texts.items():  # files of given names, by Spark's own file system
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = p.getFileSystem(conf).create(p)
        out.write(bytearray(text.encode()))
        out.close()
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
                           T.StructField("responses", T.MapType(T.StringType(), T.StringType()))])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = R.read_json_records(spark, path, schema).collect()
        frag = jsonarray._fragments(spark, path, "},", "part-9.json")
        assert frag.select("block").distinct().count() > 1
        assert jsonarray.segments(spark, path, "},", "part-8.json").count() in (1, len(files["part-8.json"]))
        strings = {}
        for k in range(6):
            items = [_hard_text(rng) for _ in range(rng.choice([0, 1, 50]))]
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-s/{k}.json")
            out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
            out.write(bytearray(json.dumps(items, **layouts[k % 5]).encode()))
            out.close()
            strings[f"{k}.json"] = items
        values = R.read_string_array(spark, path + "-s").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(rows, key=lambda r: (r["file_path"], r["pos"])):
        got.setdefault(r["file_path"].rsplit("/", 1)[1], []).append((r["pos"], {"name": r["name"], "tags": r["tags"], "responses": r["responses"]}))
    broken = got.pop("broken.json")
    assert {v["name"] for _, v in broken} >= {"x", "z"}
    assert got == {f: list(enumerate(recs)) for f, recs in files.items() if recs}
    assert sorted((r["file_path"].rsplit("/", 1)[1], r["pos"], r["value"]) for r in values) == sorted((f, i, v) for f, vs in strings.items() for i, v in enumerate(vs))


def test_many_named_shards_from_few_tasks(spark):
    from stanceframe.sources import shards as SH
    path = scratch_path(spark, "named-shards")
    rows = spark.range(0, 12_000).select((F.col("id") % 3000).alias("shard"), F.concat(F.lit('{"n": '), F.col("id"), F.lit("}")).alias("value"), "id")
    SH.write_shards(rows, path, "id", tasks=8)
    files, base = SH.open_fs(path)
    names = sorted(f.base_name for f in files.get_file_info(SH.fs.FileSelector(base)))
    assert names == sorted(f"batch_{k:04d}.jsonl" for k in range(3000))  # no folder, no attempt left
    m = SH.read_manifest(spark, path).collect()
    assert sorted((r["batch_num"], r["file"], r["num_requests"]) for r in m) == [(k, f"batch_{k:04d}.jsonl", 4) for k in range(3000)]
    with files.open_input_file(f"{base}/batch_0007.jsonl") as f:
        assert [json.loads(x)["n"] for x in f.read().splitlines()] == [7, 3007, 6007, 9007]
    got = SH.read_shards(spark, path).select("shard", F.get_json_object("value", "$.n").cast("bigint").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted((k % 3000, k) for k in range(12_000))
    # a second, smaller write leaves none of the first one's files
    SH.write_shards(rows.where("shard < 2"), path, "id", prefix="later")
    assert sorted(f.base_name for f in files.get_file_info(SH.fs.FileSelector(base))) == ["later_0000.jsonl", "later_0001.jsonl"]


def test_a_failed_shard_job_leaves_no_names(spark):
    from stanceframe.sources import shards as SH
    path = scratch_path(spark, "failed-shards")
    rows = spark.range(0, 100).select((F.col("id") % 10).alias("shard"), F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("value"), "id")
    with pytest.raises(Exception, match="stop"):
        SH.write_shards(rows, path, "id", tasks=3)
    files, base = SH.open_fs(path)
    there = files.get_file_info(SH.fs.FileSelector(base, allow_not_found=True, recursive=True))
    assert not [f for f in there if f.is_file and SH.ATTEMPTS not in f.path]


def test_batch_shards_are_files_of_one_folder(spark, monkeypatch):
    """A folder per shard is listed folder by folder; its shards are named files beside each other."""
    from pyarrow import fs

    from stanceframe import session
    from stanceframe.plans import registry
    from stanceframe.sources.shards import open_fs

    from .conftest import SF001
    made = []
    real = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: made.append((name, real(s, name))) or made[-1][1])
    n = registry.queries()["read_batch_outputs"](spark, SF001).count()
    files, base = open_fs(dict(made)["batch-shards"])
    names = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(base, recursive=True)) if not f.base_name.startswith("."))
    assert n == 1000 and names == [f"batch_{i:04d}.jsonl" for i in range(10)]
