"""Queries against their SQL on small tables with odd rows, and plans that must not move words between machines."""

from itertools import accumulate

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspan.functions import numbers
from quillspan.operators import boundaries, contracts
from quillspan.plans import registry
from quillspan.sources import adapters
from tests.test_queries import rows_of


def agree(spark, home, name, **tables):
    """The query's rows, after they were found equal to those of its SQL."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{home}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{home}/{t}.parquet'")
    df, relation = registry.QUERIES[name](spark, str(home)), con.sql(registry.ORACLES[name])
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(list(relation.columns), relation.fetchall())
    return got


def test_grey_values_are_cut_off_after_a_product_of_floats(spark, tmp_path):
    # 1000 times 0.21 is below 210 as a double and 210 as a float.
    v = np.float32(0.21)
    assert int(float(v) * 1000) == 209 and int(v * np.float32(1000)) == 210
    agree(spark, tmp_path, "grey_pictures", embeddings={"vec_id": [1], "embedding": pa.array([[v, -v]], pa.list_(pa.float32())), "label": [0]})


def test_a_first_turn_without_content_has_no_likeness(spark, tmp_path):
    c = {"conv_id": [1, 1, 2, 2], "turn": [0, 1, 0, 1], "role": ["user", "assistant"] * 2, "text": ["the", "hello world", None, ""]}
    got = agree(spark, tmp_path, "turn_likeness", conversations=c)
    assert sorted(got, key=lambda r: (r[0], r[2])) == [(1, None, 0), (1, 0, 1), (2, None, 0), (2, 0, 1)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["word_timeline", "word_at_time", "caption_groups", "caption_at", "segment_now", "vtt_lines", "srt_lines", "chunk_words"])
def test_words_and_captions_are_not_shuffled_and_texts_are_split_once(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "Exchange" not in plan and plan.count("split(") == 1


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1000, 2081])
def test_running_values_over_blocks(spark, n):
    row = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("a") if n else F.expr("cast(array() as array<int>)").alias("a"))
    sums = row.select(numbers.running(F.transform("a", lambda x: x * 7 % 11), lambda a, b: a + b, "bigint").alias("s")).first().s
    most = row.select(numbers.running(F.transform("a", lambda x: x * 7 % 11), F.greatest, "int").alias("s")).first().s
    values = [x * 7 % 11 for x in range(1, n + 1)]
    assert sums == list(accumulate(values)) and most == list(accumulate(values, max))


@pytest.mark.parametrize("name", ["fallback_windows", "refined_clips", "boundary_report"])
def test_boundaries_are_found_in_the_transcripts_row(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "Exchange" not in plan and plan.count("split(") == 1


def test_silences_in_any_order_are_found_by_their_edges(spark):
    quiet = [(4.0, 5.0), (1.0, 2.0), (1.5, 1.8), (8.0, 8.5), (4.0, 5.0)]
    row = spark.createDataFrame([(quiet,)], "q array<struct<start_s: double, end_s: double>>")
    for t in (0.9, 1.9, 4.6, 5.2, 8.1, 20.0):
        for edge in ("start_s", "end_s"):
            near, of = boundaries._nearest(F.col("q"), edge, F.lit(t)), boundaries._nearest_of(boundaries.by_edges(F.col("q")), edge, F.lit(t))
            got = row.select(near.alias("a"), of.alias("b")).first()
            assert (got.a and got.a[-2:]) == (got.b and got.b[-2:])
        both = row.select(boundaries.silence_in(F.col("q"), F.lit(1.2), F.lit(t)).alias("a"), boundaries.silence_of(boundaries.by_edges(F.col("q")), F.lit(1.2), F.lit(t)).alias("b")).first()
        assert both.a == pytest.approx(both.b)


def test_render_plans_are_not_shuffled(spark):
    plan = plan_of(registry.QUERIES["render_plan"](spark, SF))
    assert "Exchange" not in plan and plan.count("split(") == 1


def test_pieces_are_cut_once_for_a_batch_of_documents(spark):
    plan = plan_of(registry.QUERIES["render_plan"](spark, SF))
    assert plan.count("MapInArrow") == 1 and "array_sort(" not in plan and "explode" not in plan


def test_render_plans_make_no_texts_of_captions(spark):
    assert "array_join(" not in plan_of(registry.QUERIES["render_plan"](spark, SF))


def test_words_begin_where_the_one_before_ends(spark):
    rows = adapters.timed(spark, SF).collect()
    assert all(r.starts == [0.0, *r.ends[:-1]] and len(r.tokens) == len(r.starts) for r in rows)


def test_render_plans_of_odd_texts(spark, tmp_path):
    texts = [None, "", " \t\n", "one", "a. b! c? d", "x " * 400, " ".join(f"w{k}{'.' * (k % 9 == 0)}" for k in range(900)), "…" * 5 + " " + "y" * 3000]
    agree(spark, tmp_path, "render_plan", documents={"doc_id": list(range(len(texts))), "text": texts})
    assert {r.doc_id for r in registry.QUERIES["render_plan"](spark, str(tmp_path)).select("doc_id").collect()} == {3, 4, 5, 6, 7}


def test_streamed_bodies_are_made_once(spark):
    plan = plan_of(registry.QUERIES["sse_deltas"](spark, SF))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_replies_are_parsed_once(spark):
    rows = spark.range(5).select("id", F.col("id").cast("string").alias("text"))
    assert plan_of(contracts.entries(rows, ["id"], ["scores"])).count("ArrowEvalPython") == 1


def test_speech_replies_are_made_and_read_once(spark):
    plan = plan_of(registry.QUERIES["speech_replies"](spark, SF))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and plan.count("from_json(") == 1


def test_a_stage_reads_the_rows_of_some_jobs_by_one_join(spark, tmp_path):
    from quillspan.sources import stages

    home = str(tmp_path / "home")
    jobs = spark.createDataFrame([("a", "x"), ("b", "y")], "job_id string, text string")
    stages.run(jobs, [stages.Stage("s", lambda rows: rows)], home)
    some = stages.artifact(spark, home, "s", jobs.filter("job_id = 'b'").select("job_id"))
    assert [(r.job_id, r.text) for r in some.collect()] == [("b", "y")]
