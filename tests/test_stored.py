"""Speech replies, files that arrive, staged jobs cut short, chunks as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import speech
from quillspan.sources import recognition, stages
from quillspan.streaming import arrivals, chunks


# --- replies of a speech service ----------------------------------------------------------------------------------------------


def by_hand(reply):
    words, texts = [], []
    for place, result in enumerate((reply or {}).get("results") or []):
        best = next(iter(result.get("alternatives") or []), None)
        if best is None:
            continue
        if (best.get("transcript") or "").strip():
            texts.append(best["transcript"].strip())
        for w in best.get("words") or []:
            if (w.get("word") or "").strip():
                words.append((place, w["word"].strip(), (w.get("start_time") or 0) / 1000, (w.get("end_time") or 0) / 1000))
    return " ".join(texts), words


def test_replies_equal_a_loop(spark):
    rng = random.Random(2)
    word = lambda: rng.choice([{"word": "a", "start_time": 10, "end_time": 20}, {"word": " b　"}, {"word": ""}, {"start_time": 5}, {"word": None, "end_time": 7}])
    alternative = lambda: {"transcript": rng.choice([" hello ", "", None, "x"]), "words": rng.choice([None, [], [word() for _ in range(4)]])}
    replies = [{"results": [{"alternatives": rng.choice([None, [], [alternative(), alternative()]])} for _ in range(rng.randrange(4))]} for _ in range(60)]
    replies += [{}, {"results": None}, {"results": []}, {"results": [{}]}]
    rows = [(k, json.dumps(r)) for k, r in enumerate(replies)] + [(900, None), (901, "broken {")]
    got = {r.k: (r.text, [tuple(w) for w in r.words]) for r in recognition.recognised(spark.createDataFrame(rows, "k int, reply string"), ["k"]).collect()}
    assert got == {k: by_hand(r) for k, r in enumerate(replies)} | {900: ("", []), 901: ("", [])}


# --- files that arrive --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("at_once", [True, False])
def test_the_last_file_takes_the_slot(spark, tmp_path, at_once):
    import os

    drop, slot, checkpoint = (str(tmp_path / x) for x in ("drop", "slot", "checkpoint"))
    os.makedirs(drop)
    assert arrivals.held(spark, slot).collect() == []
    for k, name in enumerate(("z-first", "a-second")):
        with open(f"{drop}/{name}", "wb") as f:
            f.write(name.encode())
        os.utime(f"{drop}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
        if not at_once:
            arrivals.watch(spark, drop, slot, checkpoint).awaitTermination(120)
            assert [bytes(r.content).decode() for r in arrivals.held(spark, slot).collect()] == [name]
    arrivals.watch(spark, drop, slot, checkpoint).awaitTermination(120)
    assert [bytes(r.content).decode() for r in arrivals.held(spark, slot).collect()] == ["a-second"]
    # Nothing new: the checkpoint knows both files, and the slot stays as it is.
    before = os.listdir(slot)
    query = arrivals.watch(spark, drop, slot, checkpoint)
    query.awaitTermination(120)
    assert os.listdir(slot) == before and not query.recentProgress[-1]["numInputRows"] if query.recentProgress else True


def test_a_version_cut_short_is_not_read(spark, tmp_path):
    import os

    drop, slot = str(tmp_path / "drop"), str(tmp_path / "slot")
    os.makedirs(drop)
    with open(f"{drop}/one", "wb") as f:
        f.write(b"one")
    arrivals.watch(spark, drop, slot, str(tmp_path / "c")).awaitTermination(120)
    os.makedirs(f"{slot}/arrival=7")  # a later micro-batch that died while it wrote
    assert [bytes(r.content) for r in arrivals.held(spark, slot).collect()] == [b"one"]


# --- staged jobs --------------------------------------------------------------------------------------------------------------


class Cut(Exception):
    pass


class Steps:
    """Three stages that note the jobs they work on and may die after having begun."""

    def __init__(self, dies=None):
        self.dies, self.worked = dies, []

    def stages(self, versions=("1", "1", "1")):
        makers = [
            lambda rows: rows.select("job_id", F.explode(F.split("text", " ")).alias("word")),
            lambda rows: rows.groupBy("job_id", "word").count(),
            lambda rows: rows.groupBy("job_id").agg(F.max("count").alias("most")),
        ]

        def noting(name, make):
            def run(rows):
                self.worked.append((name, sorted(r.job_id for r in rows.select("job_id").distinct().collect())))
                if name == self.dies:
                    raise Cut
                return make(rows)

            return run

        return [stages.Stage(n, noting(n, m), v) for n, m, v in zip(("words", "counts", "most"), makers, versions, strict=True)]


JOBS = [("u1/a", "x y x"), ("u1/b", "p"), ("u2/a", "q q q"), ("u2/b", "")]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("dies", ["words", "counts", "most"])
def test_a_run_cut_short_goes_on_and_ends_the_same(spark, tmp_path, dies):
    jobs = spark.createDataFrame(JOBS, "job_id string, text string")
    whole = rows(stages.run(jobs, Steps().stages(), str(tmp_path / "whole")))
    home, cut = str(tmp_path / "cut"), Steps(dies)
    with pytest.raises(Cut):
        stages.run(jobs, cut.stages(), home)
    again = Steps()
    assert rows(stages.run(jobs, again.stages(), home)) == whole == [("u1/a", 2), ("u1/b", 1), ("u2/a", 3), ("u2/b", 1)]
    names = ["words", "counts", "most"]
    assert [n for n, _ in again.worked] == names[names.index(dies) :]  # earlier stages are not worked on again
    for name in names:
        assert rows(stages.artifact(spark, home, name)) == rows(stages.artifact(spark, str(tmp_path / "whole"), name))


def test_a_run_whose_manifest_is_missing_is_not_read(spark, tmp_path):
    import shutil

    jobs, home = spark.createDataFrame(JOBS, "job_id string, text string"), str(tmp_path / "home")
    want = rows(stages.run(jobs, Steps().stages(), home))
    shutil.rmtree(f"{home}/manifest/run=2")  # the run of the second stage died between its rows and its manifest
    again = Steps()
    assert rows(stages.run(jobs, again.stages(), home)) == want and [n for n, _ in again.worked] == ["counts"]
    assert rows(stages.artifact(spark, home, "counts")) == [("u1/a", "x", 2), ("u1/a", "y", 1), ("u1/b", "p", 1), ("u2/a", "q", 3), ("u2/b", "", 1)]


def test_only_what_changed_is_done_again(spark, tmp_path):
    home = str(tmp_path / "home")
    stages.run(spark.createDataFrame(JOBS, "job_id string, text string"), Steps().stages(), home)
    changed = spark.createDataFrame([("u1/a", "x x x x"), *JOBS[1:], ("u3/a", "new")], "job_id string, text string")
    again = Steps()
    got = rows(stages.run(changed, again.stages(), home))
    assert got == [("u1/a", 4), ("u1/b", 1), ("u2/a", 3), ("u2/b", 1), ("u3/a", 1)]
    assert again.worked == [(n, ["u1/a", "u3/a"]) for n in ("words", "counts", "most")]
    newer = Steps()
    assert rows(stages.run(changed, newer.stages(("1", "2", "1")), home)) == got
    assert [n for n, _ in newer.worked] == ["counts", "most"] and len(newer.worked[0][1]) == 5


def test_removal_by_prefix_reaches_every_stage_and_vacuum_its_rows(spark, tmp_path):
    home, names = str(tmp_path / "home"), ["words", "counts", "most"]
    jobs = spark.createDataFrame(JOBS, "job_id string, text string")
    stages.run(jobs, Steps().stages(), home)
    stages.remove(spark, home, "u1/")
    for name in names:
        assert {r.job_id for r in stages.artifact(spark, home, name).collect()} == {"u2/a", "u2/b"}
        assert {r.job_id for r in spark.read.parquet(f"{home}/{name}").collect()} > {"u2/a", "u2/b"}
    stages.vacuum(spark, home, names)
    for name in names:
        spark.catalog.clearCache()
        assert {r.job_id for r in spark.read.parquet(f"{home}/{name}").collect()} == {"u2/a", "u2/b"}
    again = Steps()
    assert len(rows(stages.run(jobs, again.stages(), home))) == 4 and again.worked[0] == ("words", ["u1/a", "u1/b"])


def test_fingerprints_tell_rows_and_nulls_but_not_order(spark):
    schema = "job_id string, a string, b string"
    prints = lambda *r: stages.fingerprints(spark.createDataFrame(list(r), schema)).first().fingerprint
    one, two = ("j", "x", None), ("j", None, "x")
    assert prints(one, two) == prints(two, one)
    assert len({prints(one), prints(two), prints(one, two), prints(one, one)}) == 4


# --- chunks as a stream -------------------------------------------------------------------------------------------------------


def test_chunks_that_arrive_late_or_twice_equal_the_batch(spark, tmp_path):
    rng = random.Random(7)
    words = [(d, i, 0.5 * i, 0.5 * i + 0.4) for d in range(3) for i in range(120)]
    bounds = [(d, c, 20.0 * c, 20.0 * c + 20) for d in range(3) for c in range(3)]
    heard = [
        (d, c, i, s, e, a, b, c == 2) for d, c, a, b in bounds for k, i, s, e in words if k == d and s < b + 1 and e > a - 1
    ]
    batch = speech.owned(
        spark.createDataFrame([h[:5] for h in heard], "doc_id int, chunk int, idx int, start_s double, end_s double"),
        spark.createDataFrame(bounds, "doc_id int, chunk int, chunk_start double, chunk_end double"), "doc_id",
    )
    schema = "doc_id int, chunk int, idx int, start_s double, end_s double, chunk_start double, chunk_end double, is_last boolean, sent timestamp"
    # Every chunk is sent at its own time; a third of them is sent again, and some come a batch or two after later ones.
    sent = [(d, c, rng.randrange(50)) for d, c, *_ in bounds] + [(d, c, rng.randrange(50)) for d, c, *_ in bounds[::3]]
    rng.shuffle(sent)
    for part in range(3):
        rows = [(*h, f"2024-01-01 00:00:{at:02d}") for d, c, at in sent[part::3] for h in heard if h[:2] == (d, c)]
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("sent", F.to_timestamp("sent")).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = chunks.owned_stream(stream, "doc_id", "sent", "2 minutes").select("doc_id", "chunk", "idx")
    out.writeStream.format("memory").queryName("owned").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert rows_of(spark.table("owned")) == rows_of(batch.select("doc_id", "chunk", "idx"))
    assert len(batch.collect()) == len(words)


def rows_of(df):
    return sorted(map(tuple, df.collect()))
