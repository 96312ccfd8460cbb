"""Operators against plain Python, and the expectations that users of timed transcripts know."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import numbers, spans, text
from quillspan.operators import energy, intervals, layout, replies, selection, sequence, series
from quillspan.sources import store, wire


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def talk(spark, n):
    """n sentences of eight words: 0.35 s long, 0.4 s apart, 0.3 s more after each sentence."""
    rows, t = [], 0.0
    for s in range(n):
        for k in range(8):
            rows.append((1, len(rows), f"w{s}_{k}" + "." * (k == 7), t, t + 0.35))
            t += 0.4
        t += 0.3
    return spark.createDataFrame(rows, "doc_id long, idx int, text string, start_s double, end_s double")


def test_coercions(spark):
    for value, want in (("85", 0.85), ("7", 0.7), (".4", 0.4), ("", 0.0), ("true", 1.0), ("x", None), ("-3", 0.0), ("inf", None)):
        assert one(spark, numbers.unit(F.lit(value))) == want
    for value, want in (("0.5", 5.0), ("1", 1.0), ("85", 8.5), ("true", None), (None, None)):
        assert one(spark, numbers.ten(F.lit(value).cast("string"))) == want
    assert one(spark, numbers.half_up(F.lit(-0.5))) == 0 and one(spark, numbers.half_up(F.lit(2.5))) == 3
    for value, want in (("s12", 12), ("12", 12), (" S3 ", 3), ("x1", None)):
        assert one(spark, text.sentence_ref(F.lit(value))) == want


def test_spans(spark):
    f = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, spans.word_iou(*(F.lit(x) for x in (0, 40, 2, 42)))) == pytest.approx(39 / 43)
    assert one(spark, spans.overlap_of_shorter(*f(0, 10, 8, 12))) == 0.5
    assert one(spark, spans.overlap_of_shorter(*f(0, 0, 0, 5))) == 0.0
    w, h = spans.crop_size(F.lit(1920), F.lit(1080), 9, 16)
    assert (one(spark, w), one(spark, h)) == (608, 1080)
    w, h = spans.crop_size(F.lit(1080), F.lit(1920), 9, 16)
    assert (one(spark, w), one(spark, h)) == (1080, 1920)


def test_sentences_and_captions(spark):
    words = talk(spark, 10)
    lists = words.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("tokens"))
    found = sequence.sentences(lists).orderBy("sid").collect()
    assert len(found) == 10 and (found[2]["first"], found[2]["last"]) == (16, 23)
    groups = sequence.caption_groups(talk(spark, 2), 4).orderBy("grp").collect()
    assert [len(g.text.split()) for g in groups] == [4, 4, 4, 4]
    srt = sequence.srt(talk(spark, 2)).first().srt
    assert srt.startswith("1\n00:00:00,000 --> ")
    assert one(spark, text.srt_to_vtt(F.lit(srt))).startswith("WEBVTT\n\n00:00:00.000 --> ")


def sentences_by_hand(tokens):
    import re

    out, first = [], 0
    for k, w in enumerate(tokens):
        n = k - first + 1
        stop, soft = re.search(r"[.!?…।]+[\"'”’)\]]*$", w), re.search(r"[.!?…।,;:—–]+[\"'”’)\]]*$", w)
        if stop or (n >= 20 and soft) or n >= 35 or k == len(tokens) - 1:
            out.append((first, k))
            first = k + 1
    return out


def test_sentence_fold_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice(["a", "b,", "c.", "d", "e", "f"] if k % 2 else ["a", "b,", "e"]) for _ in range(rng.randint(1, 150))]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    got = {}
    for r in sequence.sentences(df).orderBy("sid").collect():
        got.setdefault(r.doc_id, []).append((r["first"], r["last"]))
    assert got == {k: sentences_by_hand(t) for k, t in rows}


def test_repaired_words(spark):
    rows = [(1, 0, "one", 0.64, 0.64), (1, 1, "two", 0.72, 0.72), (1, 2, "three", 1.04, 1.04), (1, 3, " ", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, text string, start_s double, end_s double")
    out = sequence.repaired(df, ["doc_id"], ["start_s", "idx"]).orderBy("start_s").collect()
    assert len(out) == 3 and all(r.end_s > r.start_s for r in out) and 0.64 < out[0].end_s <= 0.72


def test_windows_cover_all_words(spark):
    lists = talk(spark, 400).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start_s", "end_s"))).alias("w")).select(
        "doc_id", F.col("w.start_s").alias("starts"), F.col("w.end_s").alias("ends")
    )
    found = sequence.transcript_windows(lists, 120.0, 20.0).orderBy("win").collect()
    assert found[0]["first"] == 0 and found[-1]["last"] == 3199
    assert all(b["first"] <= a["last"] < b["last"] for a, b in zip(found, found[1:]))  # noqa: B905


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, a := rng.random() * 50, a + rng.random() * 9) for k in range(150)]
    left = spark.createDataFrame(rows, "key int, a int, a0 double, a1 double")
    right = left.toDF("key", "b", "b0", "b1")
    got = {(r.a, r.b) for r in intervals.overlap_join(left, right, ["key"], ("a0", "a1"), ("b0", "b1"), 4.0).collect()}
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    assert got == want
    assert "Nested" not in intervals.overlap_join(left, right, ["key"], ("a0", "a1"), ("b0", "b1"), 4.0)._jdf.queryExecution().toString()


def test_silences_and_cuts(spark):
    db = [-30.0] * 40 + [-90.0] * 20 + [-30.0] * 40 + [-90.0] * 5 + [-100.0] + [-30.0] * 100
    e = spark.createDataFrame([(1, k, v) for k, v in enumerate(db)], "user_id int, frame int, db double")
    found = [(r.start_s, r.end_s) for r in energy.silences(e, "user_id", 0.02).collect()]
    assert found == [(0.8, 1.2)]
    quiet = spark.createDataFrame([(1, 470.0, 471.0), (1, 950.0, 952.0), (1, 500.0, 500.5)], "v int, start_s double, end_s double")
    length = spark.createDataFrame([(1, 1400.0)], "v int, duration_s double")
    cuts = [r.at_s for r in energy.plan_cuts(quiet, length, "v", 480.0, 45.0).orderBy("cut").collect()]
    assert cuts == [470.5, 951.0]


def test_moment_energy(spark):
    db = [-10.0 if 1500 <= k < 1650 else -30.0 for k in range(3000)]
    e = spark.createDataFrame([(1, k, v) for k, v in enumerate(db)], "v int, frame int, db double")
    m = spark.createDataFrame([(1, 0, 25.0, 40.0), (1, 1, 0.0, 20.0)], "v int, moment int, start_s double, end_s double")
    got = {r.moment: r.energy for r in energy.moment_energy(e, m, "v", 0.02).collect()}
    assert got[0] > 0.8 and got[1] == 0


def test_selection_invariants(spark):
    rows = [(1, k, 15.0 * k, 15.0 * k + 25, 0.3 + k % 7 / 10, "discovered", "other", [f"w{k}"]) for k in range(30)]
    pool = spark.createDataFrame(rows, "job int, id int, start_s double, end_s double, quality double, tier string, kind string, words array<string>")
    got = selection.select(pool, ["job"], 10).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11))
    for a in got:
        for b in got:
            if a.id < b.id:
                assert max(0, min(a.end_s, b.end_s) - max(a.start_s, b.start_s)) / 25 <= 0.15
    judged = spark.createDataFrame(
        [(1, 1, 0.0, 20.0, 0.7, "judged_keep", "x", ["a"]), (1, 2, 100.0, 120.0, 0.9, "judged_reject", "y", ["b"])], pool.schema
    )
    assert selection.select(judged, ["job"], 2).orderBy("rank").first().id == 1


def merged_by_hand(rows):
    kept = []
    for i, a, b, p in sorted(rows, key=lambda r: (-r[3], r[1], r[0])):
        for k in kept:
            both = max(0.0, min(b, k["b"]) - max(a, k["a"]))
            if both / ((b - a) + (k["b"] - k["a"]) - both) > 0.4:
                k["n"] += 1
                k["p"] = min(1.0, max(k["p"], p) + min(0.09, 0.03 * (k["n"] - 1)))
                break
        else:
            kept.append({"i": i, "a": a, "b": b, "p": p, "n": 1})
    return sorted((k["i"], k["n"], round(k["p"], 9)) for k in kept)


def test_merging_by_islands_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, a := rng.random() * 60, a + 2 + rng.random() * 8, round(rng.random(), 3)) for k in range(80)]
    df = spark.createDataFrame([(1, *r) for r in rows], "job int, id int, start_s double, end_s double, prior double")
    got = selection.merge_duplicates(intervals.islands(df, ["job"], "start_s", "end_s", ["id"]), ["job"]).collect()
    assert sorted((r.id, r.proposals, round(r.prior, 9)) for r in got) == merged_by_hand(rows)


def test_replies():
    reply = '<think>{"a": 1}</think>```json\n{"x": {"y": "} \\" ,"}, "z": [1, 2,],}\n``` {"later": 1}'
    assert replies.first_object(reply.split("</think>")[1]) == '{"x": {"y": "} \\" ,"}, "z": [1, 2]}'
    cut = 'text {"content_type": "talk", "candidates": [{"a": 1}, {"b": "]"}, {"c": '
    assert replies.first_object(cut) == '{"a": 1}'  # the outer one never ends, so the next brace counts; the list is salvaged
    assert replies._read(cut, ["candidates"])["items"] == ['{"a": 1}', '{"b": "]"}']
    assert replies.salvaged_items(cut, ["clips", "candidates"]) == '[{"a": 1}, {"b": "]"}]'
    assert replies.first_object(None) is None and replies.salvaged_items(None, ["a"]) is None
    assert replies.first_object('Use { to open. {"a": 1}') == '{"a": 1}'  # on to the next brace
    beyond = '{"candidates": [{"a": 1}], "note": {"b": 2}, "c'
    assert replies.salvaged_items(beyond, ["candidates"]) == '[{"a": 1}]'  # not past the end of the list
    prose = 'the "candidates" list [{"x": 0}] is: "candidates": [{"a": 1}, {"b": }, {"c": 3}'
    assert replies.salvaged_items(prose, ["candidates"]) == '[{"a": 1}]'  # a named list, up to a broken item
    assert replies.first_object('{"a": NaN} {"b": 1}') == '{"b": 1}'
    assert replies._read("nothing", ["a"]) is None and replies._read('{"b": 1}', ["a"])["items"] is None
    cut_off = replies._read('{"content_type": "talk", "a": [{"x": 1}, {"y"', ["a"])
    assert cut_off["items"] == ['{"x": 1}'] and cut_off["content_type"] == "talk"


def test_reading_a_reply_takes_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        reply = '{"candidates": [' + '{"a": [1, 2,], "b": "x, ]"},' * n
        began = time.perf_counter()
        assert len(replies._salvaged(reply, ["candidates"])) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_wire(spark):
    chunks = spark.createDataFrame([(1, 0, "data: {\"a\""), (1, 1, ": 1}\r\n: note\nda"), (1, 2, "ta: x\ndata: rest")], "sid int, seq int, body string")
    assert [r.payload for r in wire.event_lines(chunks, "sid").orderBy("line").collect()] == ['{"a": 1}', "x"]
    events = spark.createDataFrame([(1, 0, "Hel", None), (1, 1, "lo", None), (1, 2, None, "stop")], "sid int, line int, content string, finish string")
    assert tuple(wire.deltas(events, "sid").first()) == (1, "Hello", "stop")
    parts = spark.createDataFrame([(1, 0, 10), (1, 1, 10)], "k int, part int, length long")
    bodies = spark.createDataFrame([(1, "x" * 15)], "k int, body string")
    assert [r.ok for r in wire.framed(parts, bodies, "k").collect()] == [False, False]


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda j, v: spark.createDataFrame([(j, v)], "job_id string, v int")
    store.save(rows("a", 1).union(rows("b", 2)), path)
    store.save(rows("a", 3), path)
    assert {tuple(r) for r in store.load(spark, path).select("job_id", "v").collect()} == {("a", 3), ("b", 2)}
    store.remove(spark, [path], "a")
    assert [r.v for r in store.load(spark, path).collect()] == [2]


def test_logs_texts_and_newest_rows(spark, tmp_path):
    rows = spark.createDataFrame([(k, "x" * (400 if k == 2 else 3)) for k in range(5)], "at int, detail string")
    store.append_log(rows, f"{tmp_path}/log")
    store.append_log(rows.filter("at > 3"), f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 6 and log.agg(F.max(F.length("detail"))).first()[0] == 300
    assert [r["at"] for r in store.newest_first(log, "at", 3).collect()] == [4, 4, 3]
    store.write_text(rows.filter("at = 1"), "detail", f"{tmp_path}/text")
    assert [r.value for r in spark.read.text(f"{tmp_path}/text").collect()] == ["xxx"]
    assert store.cut(rows).count() == 5


def test_smoothing_and_shots(spark):
    rng = random.Random(5)
    points = [(k / 5, 500 + rng.choice([-6, 6]) * 1.0) for k in range(50)]
    df = spark.createDataFrame([(k, *p) for p in points for k in (1, 2)], "k int, t double, v double").repartition(3)
    out = [r.v for r in series.smoothed(df, ["k"]).filter("k = 2").orderBy("t").collect()]
    assert max(out) - min(out) < 12 and len(out) == 50
    step = series.Smoother()
    assert out == [step(*p) for p in points]
    shots = one(spark, series.shots(F.array(F.lit(5.0), F.lit(5.3)), F.lit(10.0)))
    assert [(s.start, s.end) for s in shots] == [(0.0, 5.3), (5.3, 10.0)]
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in ((0.0, 0.0), (2.0, 10.0))))
    assert [one(spark, series.interpolate(keys, F.lit(t))) for t in (-1.0, 0.5, 2.0, 9.0)] == [0.0, 2.5, 10.0, 10.0]


def faces(spark, *people):
    rows = [(1, k / 3, x, 400.0, w, 150.0) for x, w in people for k in range(24)]
    return spark.createDataFrame(rows, "clip long, t double, x double, y double, w double, h double")


def test_layouts(spark):
    shots = spark.createDataFrame([(1, 0, 0.0, 8.0, 24)], "clip long, shot int, start double, end double, samples int")
    plan = lambda f, **k: layout.plan(layout.tracks(f), shots, 1920, 1080, **k).first()
    assert layout.prominent(layout.tracks(faces(spark, (300.0, 120.0), (1600.0, 120.0)))).count() == 2
    assert plan(faces(spark, (1300.0, 120.0))).layout == "face"
    stack = plan(faces(spark, (300.0, 200.0), (1600.0, 200.0)))
    assert stack.layout == "stack" and stack.top.x < stack.bottom.x
    assert plan(faces(spark, (900.0, 100.0), (1050.0, 100.0))).layout == "together"
    assert plan(faces(spark, (1750.0, 120.0)), allow_split=True).layout == "split"
    assert plan(faces(spark, (1750.0, 120.0)).filter("false")).layout == "centre"


def refined_by_hand(starts, ends, stops, first, last, least, most):
    """The boundary rules as plain loops, without silences."""
    n = len(stops)
    a = max(0, min(first, n - 1))
    b = max(a, min(last, n - 1))

    def snap(index, tries, edge, stop_at, is_edge):
        if is_edge(index):
            return edge
        for off in range(13):
            for c in tries(index, off):
                if is_edge(c):
                    return edge
                if 0 <= c < n and stop_at(c):
                    return c
        return index

    a = snap(a, lambda i, o: (i - o, i + o), 0, lambda c: stops[c - 1], lambda c: c <= 0)
    b = snap(b, lambda i, o: (i + o, i - o), n - 1, lambda c: stops[c], lambda c: c >= n - 1)
    if b <= a:
        return None
    lasts = lambda k: ends[k] - starts[a]
    if lasts(b) > most:
        fits = [k for k in range(a + 1, b + 1) if lasts(k) <= most]
        at_stop = [k for k in fits if stops[k]]
        if not fits:
            return None
        b = max(at_stop or fits)
    if lasts(b) < least:
        for k in range(b + 1, n):
            if lasts(k) > most:
                break
            if stops[k]:
                b = k
                if lasts(b) >= least:
                    break
    if not least <= lasts(b) <= most:
        return None
    start = max(0.0, starts[a] - 0.25)
    return a, b, round(start, 6), round(min(ends[b] + 0.35, start + most), 6)


def test_refined_boundaries_equal_loops(spark):
    from quillspan.operators import boundaries

    rng, rows, want = random.Random(7), [], {}
    for d in range(12):
        n = rng.randint(1, 120)
        starts = [0.4 * k for k in range(n)]
        ends = [s + 0.35 for s in starts]
        stops = [rng.random() < (0.15 if d % 3 else 0.02) for _ in range(n)]
        for _ in range(25):
            first, last = rng.randint(-3, n + 2), rng.randint(-3, n + 5)
            key = len(rows)
            rows.append((key, first, last, starts, ends, stops))
            want[key] = refined_by_hand(starts, ends, stops, first, last, 5.0, 12.0)
    df = spark.createDataFrame(rows, "k int, first int, last int, starts array<double>, ends array<double>, stops array<boolean>")
    none = F.expr("cast(array() as array<struct<start_s: double, end_s: double>>)")
    c = boundaries.refine(F.col("first"), F.col("last"), F.col("starts"), F.col("ends"), F.col("stops"), none, 5.0, 12.0)
    got = {r.k: r.c and (r.c["first"], r.c["last"], round(r.c.start_s, 6), round(r.c.end_s, 6)) for r in df.select("k", c.alias("c")).collect()}
    assert got == want and any(want.values())


def test_silences_pull_edges(spark):
    from quillspan.operators import boundaries

    quiet = F.array(*(F.struct(F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for a, b in ((1.0, 2.0), (5.0, 5.6))))
    assert one(spark, boundaries.align_start(F.lit(2.1), quiet)) == pytest.approx(1.88)
    assert one(spark, boundaries.align_end(F.lit(5.1), quiet)) == pytest.approx(5.28)
    assert one(spark, boundaries.align_start(F.lit(9.0), quiet)) == 8.75 and one(spark, boundaries.align_end(F.lit(9.0), quiet)) == 9.35


def test_filler_windows(spark):
    from quillspan.operators import boundaries

    rows = boundaries.filler_windows(boundaries.transcripts(talk(spark, 120)), 15.0, 40.0).orderBy("win").collect()
    assert len(rows) > 5 and all(r.score <= 0.45 for r in rows)
    assert all(a.end_s <= b.start_s for a, b in zip(rows, rows[1:]))  # noqa: B905


def test_presentation(spark):
    from quillspan.functions import presentation as p

    dims = F.create_map(F.lit("hook"), F.lit(9.0), F.lit("payoff"), F.lit(8.0), F.lit("emotion"), F.lit(4.0))
    assert one(spark, p.reasons(F.lit(0.9), dims, F.lit("ai"))) == [p.LOUD_REASON, p.REASONS["hook"], p.REASONS["payoff"]]
    assert one(spark, p.hashtags(F.lit("clutch play"), F.lit("x"), F.lit("gaming"))) == ["#clutch", "#play", "#gaming", "#streamer", "#shorts"]
    costs = F.create_map(F.lit("topic"), F.lit(0.1), F.lit("crowding"), F.lit(0.0))
    assert one(spark, p.explain(F.lit(0.5), F.lit("scored"), costs)) == "quality 0.50 (scored), -0.10 topic"
    assert one(spark, p.tagged(F.lit(3), F.lit("hi"), "s")) == "[s3] hi" and one(spark, p.tagged(F.lit(3), F.lit("hi"))) == "[3]hi"


def test_speaker_turns(spark):
    rows = []
    for k in range(200):
        t = k / 10
        for person in (0, 1):
            speaks = (t < 10) == (person == 0)
            rows.append((1, person, t, 0.5 + (0.2 if k % 2 else -0.2) * speaks))
    mouths = spark.createDataFrame(rows, "clip int, person int, t double, mouth double")
    turns = series.speaker_turns(mouths, spark.createDataFrame([(1, 20.0)], "clip int, duration_s double")).orderBy("turn").collect()
    assert [r.person for r in turns] == [0, 1] and turns[0].start_s == 0 and turns[-1].end_s == 20.0


def test_pick_texts_of_whole_documents_with_and_without_labels(spark, tmp_path):
    from quillspan.plans.clips import pick_texts

    late = "and the " * 20 + "glacier"  # its only content word begins after 160 characters
    docs = [(1, late, "en", "web", 10), (2, late, "de", "web", 20), (3, None, "en", "web", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in pick_texts(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].tags.split()[0] == got[2].tags.split()[0] == "#glacier"
    assert "(scored)" in got[1].why and "(fallback)" in got[2].why
    assert got[2].caption == '"' + ("and the " * 8)[:-5] + '" · de'


def test_scan_of_two_levels_equals_a_loop_and_deals_a_hot_key(spark):
    import random

    from quillspan.operators import intervals

    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), None if rng.random() < 0.03 else rng.choice([rng.uniform(-50, 50), float(rng.randrange(5))]), k, rng.choice([None, None, k]), rng.randrange(3)) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, t double, id int, v int, s int")
    place = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    for before in (False, True):
        for backward in (False, True):
            out = intervals.running(df, ["key"], "t", [F.col("t"), F.col("id")], {"last": F.col("v")}, {"sum": F.col("s")}, before, backward, 7.0)
            got = {r.id: (r["last"], r["sum"]) for r in out.collect()}
            for key in ("hot", "cold", None):
                last, total = None, 0
                for r in sorted((r for r in rows if r[0] == key), key=place, reverse=backward):
                    seen = (last, total)
                    last, total = (last if r[3] is None else r[3]), total + r[4]
                    assert got[r[2]] == (seen if before else (last, total))
    # All rows of one key: the windows over rows are dealt by slice, so no task has them all.
    one = spark.range(20_000).selectExpr("'hot' as key", "cast(id as double) as t", "cast(id as int) as id", "id as v")
    dealt = intervals.running(one, ["key"], "t", [F.col("t")], {"last": F.col("v")}, slice_s=500.0)
    assert "_slice" in dealt._jdf.queryExecution().executedPlan().toString().split("Window")[1]
    sizes = [len(p) for p in dealt.select("id").rdd.glom().collect()]
    assert max(sizes) < 20_000 * 0.75 and sum(sizes) == 20_000


def test_rounds_of_dominance_equal_the_fold(spark):
    from quillspan.operators import selection

    rng = random.Random(11)
    rows = []
    for job in range(4):
        for k in range(60):
            start = rng.choice([rng.uniform(0, 60), float(rng.randrange(60))])
            rows.append((job, k, start, start + rng.choice([1.0, 5.0, 20.0]), rng.choice([0.0, 0.3, rng.random(), 1.0])))
    rows += [(9, k, 1.0 * k, 1.0 * k + 1.9, 1.0 - k / 100) for k in range(40)]  # every span beats the next
    df = intervals.islands(spark.createDataFrame(rows, "job int, id int, start_s double, end_s double, prior double"), ["job"], "start_s", "end_s", ["id"])
    tidy = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    for most in (0, 5):
        assert tidy(selection.merge_duplicates(df, ["job"], most=most, width_s=7.0)) == tidy(selection.merge_duplicates(df, ["job"]))
        scored = df.withColumnRenamed("prior", "score")
        assert tidy(selection.without_overlaps(scored, ["job"], most=most, width_s=7.0)) == tidy(selection.without_overlaps(scored, ["job"]))


def test_one_island_of_many_spans_goes_by_rounds(spark):
    from quillspan.operators import selection

    n = 100_000  # spans of three seconds, one a second: one island, and no row may hold it
    df = spark.range(n).selectExpr("1 as job", "id", "cast(id as double) as start_s", "id + 3.0D as end_s", "pmod(xxhash64(id), 100003) / 100003.0D as score", "1 as island")
    kept = selection.without_overlaps(df, ["job"], most=1000, width_s=100.0)
    starts = sorted(r.start_s for r in kept.select("start_s").collect())
    gaps = {int(b - a) for a, b in zip(starts, starts[1:], strict=False)}
    assert min(gaps) >= 3 and max(gaps) <= 5  # apart, and no room for one more
