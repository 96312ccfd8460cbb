"""Operators of the review screens on small rows."""

from pyspark.sql import functions as F

from quillspan.operators import review


def test_runners_up_leave_picks_and_their_moments_out(spark):
    rows = [(1, 1, 0.0, 10.0, 0.9), (1, 2, 5.0, 15.0, 0.8), (1, 3, 9.0, 19.0, 0.7), (1, 4, 30.0, 30.0, 0.6), (2, 5, 0.0, 1.0, 0.1)]
    clips = spark.createDataFrame(rows, "job long, id long, start_s double, end_s double, score double")
    got = [(r.id, r.place) for r in review.runners_up(clips, "job", "id", 1, 12).orderBy("id").collect()]
    assert got == [(3, 1), (4, 2)]  # 3 shares a tenth with the pick; clip 4 has no length and so no overlap; job 2 has nothing else


def test_runners_up_of_nothing(spark):
    none = spark.createDataFrame([], "job long, id long, start_s double, end_s double, score double")
    assert review.runners_up(none, "job", "id", 3, 12).count() == 0


def test_position_between_before_and_after_keyframes(spark):
    frames = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, 30.0), (1, 3.0, 50.0)], "clip long, t double, x double")
    points = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.0), (1, 3.0), (1, 9.0), (2, 1.0)], "clip long, t double")
    got = [(r.clip, r.t, r.x) for r in review.position_at(points, frames, ["clip"]).orderBy("clip", "t").collect()]
    assert got == [(1, 0.0, 10.0), (1, 1.0, 10.0), (1, 2.0, 30.0), (1, 3.0, 50.0), (1, 9.0, 50.0), (2, 1.0, 0.0)]


def test_progress_never_falls_and_unknown_stages_keep_it(spark):
    rows = [(1, 1, "prepare", 0.5), (1, 2, "make", 2.0), (1, 3, "listen", 0.1), (1, 4, "rest", None), (2, 1, None, 0.5)]
    p = review.progress(spark.createDataFrame(rows, "job long, n long, stage string, fraction double"), "job", ["n"])
    assert [r.progress for r in p.orderBy("job", "n").collect()] == [0.06, 1.0, 1.0, 1.0, 0.0]


def test_time_left_is_shown_late_and_a_minute_at_least(spark):
    rows = [(10.0, 0.5, 0.5), (100.0, 0.02, 0.5), (100.0, 0.25, 0.25), (100.0, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "e double, g double, d double").select(review.seconds_left(F.col("e"), F.col("g"), F.col("d")).alias("s"))
    assert [r.s for r in df.collect()] == [None, None, 300.0, 60.0]


def test_lines_are_filled_greedily(spark):
    def lines(words, width):
        out = []
        for w in words:
            if out and len(out[-1]) + 1 + len(w) <= width:
                out[-1] += " " + w
            else:
                out.append(w)
        return out

    for words in ([], ["a"], ["abcdefghij"], "to be or not to be that is the question".split(), ["é" * 9, "a", "b"]):
        array = F.array(*map(F.lit, words)) if words else F.expr("cast(array() as array<string>)")
        assert spark.range(1).select(review.wrapped(array, 8).alias("x")).first().x == lines(words, 8)


def test_pairs_match_in_either_orientation(spark):
    asked = spark.createDataFrame([(1, 2), (3, 3), (5, 4)], "a long, b long")
    answers = spark.createDataFrame([(2, 1, "x"), (1, 2, "y"), (3, 3, "z"), (1, 5, "w")], "a long, b long, said string")
    got = sorted((r.a, r.b, r.said) for r in review.symmetric(asked, answers, "a", "b").collect())
    assert got == [(1, 2, "x"), (1, 2, "y"), (3, 3, "z")]


def test_tracks_need_time_or_observations(spark):
    rows = [(1, 0.0, 2.0, 3.0), (1, 0.6, 2.0, 5.0), (2, 0.0, 1.0, 1.0), (3, 0.0, 1.0, 1.0), (3, 0.1, 1.0, 1.0), (3, 0.2, 1.0, 1.0)]
    p = review.prominence(spark.createDataFrame(rows, "track long, t double, w double, h double"), ["track"])
    assert {r.track: (r.n, round(r.prominence, 6)) for r in p.collect()} == {1: (2, 5.6), 3: (3, 0.3)}
