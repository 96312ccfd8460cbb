"""Selection, links, layouts, contracts, speech and routing against loops and small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import boundaries, contracts, layout, routing, selection, series, speech
from quillspan.sources import media, settings

POOL = "job int, id long, start_s double, end_s double, quality double, tier string, kind string, words array<string>, topics array<string>"


def chosen_by_hand(pool, n, links):
    """The greedy rule over rows (id, start, end, quality, tier, kind, words, topics) as plain loops."""
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    over = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[1], b[1])) / min(a[2] - a[1], b[2] - b[1])
    r4 = lambda x: math.floor(x * 10_000 + 0.5) / 10_000
    rows, picked = sorted(pool, key=lambda r: (-r[3], r[1], r[0])), []
    while len(picked) < n:
        best = None
        for c in rows:
            if any(p[0] == c[0] or over(c, p) > 0.15 for p in picked):
                continue
            story = like = crowd = 0.0
            kinds = 0
            for p in picked:
                risk, flagged = links.get((min(c[0], p[0]), max(c[0], p[0])), (0.0, False))
                if flagged or risk >= 0.5:
                    story = max(story, 0.4 * max(risk, 0.75))
                like = max(like, 0.2 * min(1.0, 2 * max(jaccard(c[6], p[6]), jaccard(c[7], p[7]))))
                kinds += c[5] == p[5] != "other"
                gap = max(p[1] - c[2], c[1] - p[2], 0.0)
                if gap < 45:
                    crowd = max(crowd, 0.05 * (1 - gap / 45))
            cost = r4(story) + r4(like) + r4(min(kinds * 0.03, 0.09)) + r4(crowd)
            points = c[3] + selection.TIER_ADJUST[c[4]] - cost
            if best is None or (points, -c[1]) > best[:2]:
                best = (points, -c[1], c)
        if best is None:
            break
        picked.append(best[2])
    return {p[0] for p in picked}


def test_selection_equals_a_loop_and_fills_up(spark):
    rng = random.Random(4)
    tiers = ["scored", "triaged", "discovered", "judged_keep"]
    pools, links = {}, {}
    for job in range(12):
        pools[job] = [
            (k, s := rng.random() * 300, s + 10 + rng.random() * 30, round(rng.random(), 3), rng.choice(tiers), rng.choice(["a", "b", "other"]), rng.sample("pqrstu", 3), rng.sample("xyz", 1))
            for k in range(rng.randint(2, 16))
        ]
        links[job] = {(a, b): (rng.choice([0.2, 0.6, 0.9]), rng.random() < 0.2) for a in range(16) for b in range(a + 1, 16) if rng.random() < 0.2}
    df = spark.createDataFrame([(j, *r) for j, rows in pools.items() for r in rows], POOL)
    risks = spark.createDataFrame([(j, a, b, *v) for j, known in links.items() for (a, b), v in known.items()], "job int, a long, b long, p double, flagged boolean")
    linked = selection.with_links(df, ["job"], risks)
    got = {}
    for r in selection.select(linked, ["job"], 5).collect():
        got.setdefault(r.job, set()).add(r.id)
    assert got == {j: chosen_by_hand(rows, 5, links[j]) for j, rows in pools.items()}
    filler = spark.createDataFrame([(j, 1000 + k, 1000.0 + 50 * k, 1030.0 + 50 * k, 0.1, "fallback", "other", ["f"], ["f"]) for j in range(13) for k in range(6)], POOL)
    full = selection.exactly(linked, filler, ["job"], 5).collect()
    for job in range(13):  # the last has no pool at all
        mine = [r for r in full if r.job == job]
        assert len(mine) == 5 and sorted(r["rank"] for r in mine) == [1, 2, 3, 4, 5]
        assert all(min(a.end_s, b.end_s) - max(a.start_s, b.start_s) <= 0.15 * min(a.end_s - a.start_s, b.end_s - b.start_s) for a in mine for b in mine if a.id < b.id)


def linked_by_hand(boxes):
    """Tracks of one clip's (t, x, y, w, h), frame by frame."""
    open_tracks, out, count = [], {}, 0
    for t in sorted({b[0] for b in boxes}):
        frame = sorted(b for b in boxes if b[0] == t)
        open_tracks = [o for o in open_tracks if t - o[1] <= layout.MAX_GAP_S]
        pairs = sorted(((-layout.likeness(o[2], b[1:]), k, j) for k, o in enumerate(open_tracks) for j, b in enumerate(frame)))
        used, taken = set(), {}
        for p, k, j in pairs:
            if p < 0 and k not in used and j not in taken:
                used.add(k)
                taken[j] = open_tracks[k]
        for j, b in enumerate(frame):
            track = taken.get(j)
            if track is None:
                track = [count, t, b[1:]]
                count += 1
                open_tracks.append(track)
            track[1:] = [t, b[1:]]
            out[b] = track[0]
    return out


def test_links_equal_a_loop(spark):
    rng, rows = random.Random(6), []
    for clip in range(5):
        people = [[rng.random() * 1500, rng.random() * 500] for _ in range(rng.randint(1, 4))]
        t = 0.0
        for _ in range(40):
            t += rng.choice([1 / 3, 1 / 3, 1 / 3, 0.7, 2.0])
            for p in people:
                p[0] += rng.random() * 60 - 30
                if rng.random() < 0.8:
                    rows.append((clip, t, p[0], p[1], 100.0 + rng.random() * 20, 120.0))
    df = spark.createDataFrame(rows, "clip long, t double, x double, y double, w double, h double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames and clips across batches
    try:
        got = layout.tracks(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for clip in range(5):
        want, pairs = linked_by_hand([r[1:] for r in rows if r[0] == clip]), {}
        for r in got:
            if r.clip == clip:
                pairs.setdefault(want[(r.t, r.x, r.y, r.w, r.h)], set()).add(r.track)
        assert all(len(v) == 1 for v in pairs.values()) and len(set.union(*pairs.values())) == len(pairs)


def test_following_the_speaker_and_key_frames(spark):
    rows = []
    for k in range(36):  # twelve seconds; the left one talks for the first six
        t = k / 3
        for x, talks in ((200.0, t < 6), (1500.0, t >= 6)):
            rows.append((1, t, x, 400.0, 120.0, 150.0, (k % 2) * 0.2 if talks else 0.1))
    df = spark.createDataFrame(rows, "clip long, t double, x double, y double, w double, h double, mouth double")
    shots = spark.createDataFrame([(1, 0, 0.0, 12.0, 36)], "clip long, shot int, start double, end double, samples int")
    tracked = layout.tracks(df)
    planned = layout.plan(tracked, shots, 1920, 1080)
    assert planned.first().layout == "speaker"
    turns = layout.speaker_segments(tracked, planned, shots).orderBy("turn").collect()
    assert [(r.track, r.start, r.end) for r in turns] == [(0, 0.0, 6.0), (1, 6.0, 12.0)]
    moving = spark.createDataFrame([(1, k / 3, 200.0 + 15 * k, 400.0, 120.0, 150.0) for k in range(36)], "clip long, t double, x double, y double, w double, h double")
    segments = spark.createDataFrame([(1, 0, 0, 0.0, 6.2), (1, 1, 0, 6.2, 12.0)], "clip long, segment int, track long, start double, end double")
    keys = layout.keyframes(layout.tracks(moving), segments, 1920, 1080).orderBy("segment", "t").collect()
    first = [k for k in keys if k.segment == 0]
    raw = [(k / 3, min(max(200.0 + 15 * k + 60 - 304, 0.0), 1920 - 608.0)) for k in range(36) if k / 3 < 6.2]
    step = series.Smoother()
    want = [(t, step(t, v)) for t, v in raw]
    assert [(k.t, k.x) for k in first] == [*want, (6.2, want[-1][1])]
    assert keys[len(first)].t == 6.2 and keys[-1].t == 12.0
    still = layout.keyframes(layout.tracks(df.filter("x < 500")), segments, 1920, 1080).collect()
    assert [(k.segment, k.t, k.x) for k in sorted(still, key=lambda k: k.segment)] == [(0, 0.0, 0.0), (1, 6.2, 0.0)]


def test_cuts_and_shots(spark):
    pictures = [(1, k / 3, [10.0 if k < 12 else 200.0] * 3) for k in range(24)]
    frames = spark.createDataFrame(pictures, "clip long, t double, picture array<double>")
    lengths = spark.createDataFrame([(1, 8.0), (2, 3.0)], "clip long, duration_s double")
    got = [(r.clip, r.shot, round(r.start, 3), round(r.end, 3), r.samples) for r in layout.shots_of(frames, lengths).orderBy("clip", "shot").collect()]
    assert got == [(1, 0, 0.0, 3.833, 12), (1, 1, 3.833, 8.0, 12), (2, 0, 0.0, 3.0, 1)]
    fine = spark.createDataFrame([(1, k / 10, [10.0 if k < 39 else 200.0]) for k in range(30, 50)], "clip long, t double, picture array<double>")
    cuts = spark.createDataFrame([(1, 0, 3.833), (2, 0, 1.0)], "clip long, cut int, at_s double")
    assert {r.clip: round(r.at_s, 3) for r in media.refined_cuts(cuts, fine, "clip").collect()} == {1: 3.85, 2: 1.0}


def test_contracts(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "a")], "r int, candidate_id string")
    replies = spark.createDataFrame(
        [
            (1, '{"verdicts": [{"candidate_id": "a", "keep": true, "score": 80, "same_story_as": ["b", "a", "zz"], "hashtags": ["##x y", 3, "#"]}, {"candidate_id": "b", "keep": "true", "score": 9}]}'),
            (2, "nothing at all"), (3, '{"other": 1}'), (4, '{"verdicts": [{"candidate_id": "a", "keep": false, "score": "7"}'),
        ],
        "r int, text string",
    )
    rows, status = contracts.judgment(replies, asked, ["r"])
    got = {(r.r, r.candidate_id): (r.keep, r.score, r.tags, r.same_story_as) for r in rows.collect()}
    assert got == {(1, "a"): (True, 0.8, ["#xy", "#3"], ["b"]), (4, "a"): (False, 0.7, [], [])}
    assert {r.r: r.status for r in status.collect()} == {1: "incomplete", 2: "schema", 3: "schema", 4: "ok"}
    found = spark.createDataFrame(
        [
            (1, '{"content_type": "Gaming", "candidates": [{"start_word_index": 5, "end_word_index": 30, "type": "Advice"}, {"start_word_index": 300, "end_word_index": 400}, 7]}', 10, 100),
            (2, '{"candidates": [{"start_word_index": 300, "end_word_index": 400}]}', 10, 100), (3, "no", 10, 100), (4, '{"x": 1}', 10, 100), (5, '{"candidates": []}', 10, 100),
        ],
        "r int, text string, window_first int, window_last int",
    )
    kept, heads = contracts.discovery(found, None, ["r"], 3)
    assert [(r.r, r["first"], r["last"], r.kind, r.score) for r in kept.collect()] == [(1, 10, 30, "advice", 0.5)]
    assert {r.r: (r.content_type, r.found, r.invalid, r.status) for r in heads.collect()} == {
        1: ("gaming", 1, 2, "ok"), 2: ("general", 0, 1, "invalid_references"), 3: ("general", 0, 0, "malformed"), 4: ("general", 0, 0, "schema"), 5: ("general", 0, 0, "ok"),
    }


def test_words_around_silences(spark):
    none = []
    rows = [(1, ["a", "bb", "ccc", "d"], 0.0, 10.0, [(2.0, 4.0), (9.0, 12.0)]), (2, ["x"], 0.0, 5.0, none), (3, ["x", "y"], 1.0, 2.0, [(0.0, 3.0)]), (4, [], 0.0, 1.0, none), (5, ["x"], 2.0, 2.0, none)]
    df = spark.createDataFrame(rows, f"doc_id int, tokens array<string>, start_s double, end_s double, silences {speech.SPANS}")

    def by_hand(tokens, start, end, silences):
        spans, cursor = [], start
        for a, b in silences:
            if b <= start or a >= end:
                continue
            if a > cursor:
                spans.append((cursor, min(a, end)))
            cursor = max(cursor, b)
        if cursor < end:
            spans.append((cursor, end))
        if sum(b - a for a, b in spans) <= 0.05:
            spans = [(start, end)]
        total, weights, done, out = sum(b - a for a, b in spans), [len(t) + 1 for t in tokens], 0, []

        def at(offset):
            for a, b in spans:
                if offset <= b - a:
                    return a + offset
                offset -= b - a
            return spans[-1][1]

        for w in weights:
            out.append((at(done / sum(weights) * total), at((done + w) / sum(weights) * total)))
            done += w
        return out

    got = {}
    for r in speech.estimated_words(df).orderBy("idx").collect():
        got.setdefault(r.doc_id, []).append((pytest.approx(r.start_s), pytest.approx(r.end_s)))
    assert got == {k: by_hand(*rest) for k, *rest in rows if k < 4}


def test_estimated_words_shuffle_nothing_and_bear_odd_silences(spark):
    odd = [(6.0, 7.0), (1.0, 3.0), (2.0, 5.0), (6.0, 6.5)]  # unsorted, overlapping, one inside another
    rows = [(1, ["a", "b", "c", "d"], 0.0, 10.0, odd), (1, ["x", "y"], 0.0, 4.0, None), (2, None, 0.0, 1.0, []), (None, ["z"], 5.0, 6.0, [(0.0, 5.0), (6.0, 9.0)])]
    out = speech.estimated_words(spark.createDataFrame(rows, f"doc_id int, tokens array<string>, start_s double, end_s double, silences {speech.SPANS}"))
    got = sorted(((r.doc_id or 0, r.text, r.start_s, r.end_s) for r in out.collect()), key=lambda r: r[1])
    assert got == [(1, "a", 0.0, pytest.approx(5.25)), (1, "b", pytest.approx(5.25), pytest.approx(7.5)), (1, "c", pytest.approx(7.5), pytest.approx(8.75)),
                   (1, "d", pytest.approx(8.75), 10.0), (1, "x", 0.0, 2.0), (1, "y", 2.0, 4.0), (0, "z", 5.0, 6.0)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_split_ranges_cover_every_word_once(spark):
    df = spark.createDataFrame([(1, 0.0, 230.0, 4000.0), (2, 5.0, 12.0, 1e9), (3, 0.0, 100.0, 1.0)], "k int, start_s double, end_s double, bytes_per_s double")
    parts = speech.split_ranges(df, 200_000).collect()
    for k, start, end in ((1, 0.0, 230.0), (2, 5.0, 12.0), (3, 0.0, 100.0)):
        mine = [p for p in parts if p.k == k]
        assert min(p.start_s for p in mine) == start and max(p.end_s for p in mine) == end
        assert all((p.end_s - p.start_s) * p.bytes_per_s <= 200_000 or p.end_s - p.start_s <= speech.SMALLEST_S for p in mine)
        for step in range(200):
            mid = start + (end - start) * (step + 0.5) / 200
            owners = [p for p in mine if p.own_from <= mid < p.own_to]
            assert len(owners) == 1 and owners[0].start_s <= mid <= owners[0].end_s
    assert len([p for p in parts if p.k == 2]) == len([p for p in parts if p.k == 3]) == 1


def availability_by_hand(log):
    off, gone, strikes, until, out = set(), set(), {}, {}, {}
    for r in sorted(log, key=lambda r: (r[4], r[3])):
        provider, model, capability, i, at, category, retry = r
        pair = (model, capability)
        out[i] = "provider" if provider in off else "model" if model in gone else "quality" if strikes.get(pair, 0) >= 2 else "resting" if at < until.get(model, 0.0) else None
        if category is None:
            until[model] = 0.0
        elif category == "provider_auth":
            off.add(provider)
        elif category == "model_unavailable":
            gone.add(model)
        elif category == "invalid":
            strikes[pair] = strikes.get(pair, 0) + 1
        else:
            rest = {"rate_limit": 60.0, "timeout": 240.0}.get(category, 45.0)
            until[model] = at + max(1.0, rest if category == "timeout" or retry is None else retry)
    return out


def test_availability_equals_a_loop(spark):
    rng = random.Random(9)
    kinds = [None] * 6 + ["rate_limit", "timeout", "other", "invalid", "invalid", "model_unavailable"]
    log = [(m % 3, m, rng.choice(["x", "y"]), k, rng.random() * 3000, rng.choice(kinds), rng.choice([None, 0.2, 500.0])) for k in range(300) for m in [rng.randrange(9)]]
    log.append((0, 0, "x", 1000, 2000.0, "provider_auth", None))
    df = spark.createDataFrame(log, "provider int, model int, capability string, id int, at_s double, category string, retry_after double")
    assert {r.id: r.why_not for r in routing.availability(df).collect()} == availability_by_hand(log)


def test_races_routes_and_settings(spark):
    attempts = [(1, 0, "a", True, 30.0, True), (1, 1, "b", True, 5.0, True), (2, 0, "a", True, 30.0, True), (2, 1, "b", False, 5.0, True), (3, 0, "a", True, 4.0, False), (3, 1, "b", False, 5.0, True), (4, 0, "a", True, 4.0, False)]
    df = spark.createDataFrame(attempts, "k int, place int, model string, free boolean, took_s double, ok boolean")
    assert {r.k: (r.model, r.finish_s) for r in routing.raced(df, ["k"]).collect()} == {1: ("b", 25.0), 2: ("a", 30.0), 3: ("b", 9.0), 4: (None, None)}
    order = spark.createDataFrame([(k, m, p, 100.0) for k in (1, 2) for m, p in (("a", 0), ("b", 1))] + [(3, "c", 0, 100.0)], "k int, model string, place int, at_s double")
    rests = spark.createDataFrame([("a", 130.0), ("c", 900.0)], "model string, until_s double")
    assert {r.k: (r.model, r.wait_s) for r in routing.routed(order, rests, ["k"]).collect()} == {1: ("b", 0.0), 2: ("b", 0.0), 3: (None, None)}
    assert {r.k: (r.model, r.wait_s) for r in routing.routed(order.filter("model = 'a'"), rests, ["k"]).collect()} == {1: ("a", 30.0), 2: ("a", 30.0)}
    texts = spark.createDataFrame([('{"a": "2", "c": null}',), ("{bad",), (None,)], "j string")
    assert [r.m for r in texts.select(settings.with_defaults(F.col("j"), {"a": "1", "b": "x"}).alias("m")).collect()] == [{"b": "x", "a": "2"}, {"a": "1", "b": "x"}, {"a": "1", "b": "x"}]


def test_trimming_and_normalising(spark):
    starts, ends = [0.4 * k for k in range(40)], [0.4 * k + 0.35 for k in range(40)]
    sentences = [(k, k + 7) for k in range(0, 40, 8)]
    df = spark.createDataFrame([(sentences, starts, ends)], "s array<struct<first: int, last: int>>, a array<double>, b array<double>")
    none = F.expr(f"cast(array() as {speech.SPANS})")
    at = lambda f, t, x, y: df.select(boundaries.trimmed(F.col("s"), F.lit(f), F.lit(t), F.lit(x), F.lit(y), F.col("a"), F.col("b"), none).alias("r")).first().r
    assert (at(1, 2, -1, 1)["first"], at(1, 2, -1, 1)["last"]) == (0, 3)
    assert (at(1, 1, 1, 0)["first"], at(1, 1, 1, 0)["last"]) == (1, 1)  # would cross the other edge
    assert at(0, 4, -1, 1)["last"] == 4 and at(0, 0, 0, 0).end_s == pytest.approx(7 * 0.4 + 0.35 + 0.35)
    words = spark.createDataFrame([(1, k, "w." if k % 8 == 7 else "w", a, b) for k, (a, b) in enumerate(zip(starts, ends, strict=True))], "doc_id int, idx int, text string, start_s double, end_s double")
    proposals = spark.createDataFrame([(1, 1, 2, 20, 0.5), (1, 2, 30, 30, 0.5), (1, 3, 5, 6, 0.1)], "doc_id int, id int, first int, last int, prior double")
    good, report = boundaries.normalised(boundaries.transcripts(words), proposals, 4.0, 12.0)
    assert tuple(report.first()) == (1, 3, 2, 1) and [(r["first"], r["last"]) for r in good.filter("id = 1").collect()] == [(0, 23)]
    avoid = boundaries.transcripts(words).withColumn("avoid", F.expr("array(named_struct('start_s', 0.0D, 'end_s', 5.0D))"))
    assert all(r.start_s >= 5.0 for r in boundaries.filler_windows(avoid, 2.0, 6.0).collect())


def test_pool_and_picks_are_made_once(spark):
    from quillspan.plans import moments

    pool = moments._pool(spark, "/root/testdata/sf0.001")
    assert "Join" not in pool._jdf.queryExecution().optimizedPlan().toString()
    rows = pool.withColumn("user_id", F.col("user_id") % 2).filter("id % 7 = 0")
    filled = selection.exactly(rows, rows.filter("false"), ["user_id"], 3)
    # Of the first picks a table is left; only the second choice is still to be made.
    assert filled._jdf.queryExecution().optimizedPlan().toString().count("array_max") == 1
