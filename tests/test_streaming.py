"""Health over a stream equals health over the whole log."""

from pyspark.sql import functions as F

from quillspan.operators.routing import health
from quillspan.streaming.health import health_stream

CALLS = [
    ("m", 1, 0.0, True, "rate_limit"), ("m", 2, 10.0, False, "other"), ("m", 3, 20.0, True, "timeout"), ("n", 4, 21.0, False, "other"),
    ("m", 5, 70.0, True, "other"), ("m", 6, 300.0, False, "other"), ("n", 7, 301.0, True, "rate_limit"), ("n", 8, 320.0, False, "other"),
]
SCHEMA = "model string, id long, at_s double, failed boolean, category string"


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "calls")
    for k in range(0, len(CALLS), 3):
        spark.createDataFrame(CALLS[k : k + 3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = health_stream(stream).writeStream.format("memory").queryName("health").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.model, r.at_s, r.usable, r.failures, r.successes) for r in spark.table("health").collect()}
    log = spark.createDataFrame(CALLS, SCHEMA)
    want = {(r.model, r.at_s, r.usable, r.failures, r.successes) for r in health(log, "model").join(log.select("id", "at_s"), "id").collect()}
    assert got == want


def test_availability_of_a_stream_equals_the_batch(spark, tmp_path):
    import random

    from quillspan.operators import routing
    from quillspan.streaming.health import availability_stream

    rng = random.Random(3)
    kinds = [None] * 6 + ["rate_limit", "timeout", "other", "invalid", "invalid", "model_unavailable"]
    log = [("p", f"m{rng.randrange(6)}", rng.choice("xy"), k, 5.0 * k, rng.choice(kinds), rng.choice([None, 500.0])) for k in range(200)]
    schema = "provider string, model string, capability string, id long, at_s double, category string, retry_after double"
    for part in range(2):  # two files, two batches
        spark.createDataFrame(log[part * 100 : part * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = availability_stream(stream).writeStream.format("memory").queryName("availability").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.id: r.why_not for r in spark.table("availability").collect()}
    assert got == {r.id: r.why_not for r in routing.availability(spark.createDataFrame(log, schema)).collect()}


def test_late_rows_leave_windows(spark, tmp_path):
    from quillspan.streaming.health import tumbling_counts

    for part, rows in enumerate(([("a", 0), ("a", 30), ("b", 500)], [("b", 505)], [("a", 10), ("b", 510)])):
        spark.createDataFrame(rows, "kind string, s long").selectExpr("kind", "timestamp_seconds(s) as at").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = tumbling_counts(stream, "at", "kind", "1 minute", "2 minutes").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.kind, r["count"]) for r in spark.table("counts").collect()} == {("a", 2)}  # the late row is dropped, the open window waits


def test_calls_of_jobs_as_a_stream_equal_the_batch(spark, tmp_path):
    import random

    from quillspan.operators import routing
    from quillspan.streaming.health import job_stream

    rng = random.Random(5)
    kinds = [None] * 8 + ["rate_limit", "timeout", "other", "invalid", "invalid", "model_unavailable", "provider_auth", "bad_request", "too_large", "auth", "not_configured"]
    log = [(f"j{rng.randrange(12)}", rng.choice("pq"), f"m{rng.randrange(3)}", rng.choice("xy"), k, 5.0 * k, rng.choice(kinds), rng.choice([None, 500.0])) for k in range(300)]
    schema = "job string, provider string, model string, capability string, id long, at_s double, category string, retry_after double"
    for part in range(3):
        spark.createDataFrame(log[part * 100 : part * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    job_stream(stream).writeStream.format("memory").queryName("jobs").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = {r.id: r.why_not for r in spark.table("jobs").collect()}
    assert got == {r.id: r.why_not for r in routing.availability(spark.createDataFrame(log, schema), "job").collect()}
    assert set(got.values()) == {None, "ended", "provider", "model", "quality", "resting"}


def test_refused_calls_rest_45_seconds_whatever_is_asked(spark):
    from quillspan.operators import routing

    calls = [("p", "m", "x", 1, 0.0, "bad_request", 500.0), ("p", "m", "x", 2, 44.0, "too_large", 500.0), ("p", "m", "x", 3, 90.0, None, None), ("p", "m", "x", 4, 91.0, "auth", None), ("p", "m", "x", 5, 92.0, None, None)]
    log = spark.createDataFrame(calls, "provider string, model string, capability string, id long, at_s double, category string, retry_after double")
    assert {r.id: r.why_not for r in routing.availability(log).collect()} == {1: None, 2: "resting", 3: None, 4: None, 5: None}
    assert {r.id: r.why_not for r in routing.availability(log.withColumn("job", F.lit("j")), "job").collect()} == {1: None, 2: "resting", 3: None, 4: None, 5: "ended"}
