"""N-gram Jaccard join and components against brute force, and the pipeline's stages."""

import itertools
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from quillspan.llm import similarity
from quillspan.llm.graph import components


def brute(rows):
    sets = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(names.get(find(k), i), i)
    return sorted(((i, len(sets[k]), names.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def corpus(seed, n, edits, base=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] for _ in range(base)]
    out = []
    for k in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] + passage
        out.append((k * 3 % (n * 3), " ".join(words)))
    return out


def test_against_brute_force(spark):
    for seed, edits in ((1, 2), (2, 4), (3, 7)):
        rows = corpus(seed, 160, edits)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity.linked(df).collect()), key=repr)
        assert got == brute(rows)


def test_hints_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(similarity, "REPEATS", 2)
    rows = corpus(5, 120, 3, base=2)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity.linked(df).collect()), key=repr)
    assert got == brute(rows)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity.linked(odd).collect()), key=repr)
    assert got == brute(rows)
    assert similarity.linked(empty).count() == 0 and similarity.deduplicated(empty).count() == 0
    kept = similarity.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {8, 9, 10} <= set(ids)


def test_repeated_and_null_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    rows = [
        (3, a), (5, a), (5, b), (6, c), (6, d), (7, None), (7, ""),  # id 5 copies id 3 once; id 6 has two texts
        (None, "x " + c), (None, e), (None, e), (None, None), (None, " "),
    ]
    p = " ".join(f"p{k}" for k in range(60))
    rows += [(None, p), (None, p + " q"), (None, p + " q"), (9, "z " + b + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity.linked(df.select("doc_id", "text")).collect()), key=repr)
    assert got == brute(rows)
    kept = similarity.deduplicated(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    either = [r for r in left if r[1] in (p, p + " q")]
    assert len(either) == 1  # near copies without any id are one group
    want = [(3, a), (5, b), (6, c), (6, d), (7, None), (7, ""), (None, e), (None, None), (None, " ")]
    assert sorted(set(left) - set(either), key=repr) == sorted(want, key=repr) and len(left) == len(want) + 1


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [tuple(rng.sample(range(200, 230), 2)) for _ in range(20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {k: k for e in edges for k in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in root.items() if k != v} == {k: v for k, v in got.items() if k != v}


def test_pipeline_on_the_smallest_tables(spark):
    """Every stage against its operator on what its predecessor kept."""
    from quillspan.llm import decontaminate, language_id, quality
    from quillspan.llm.common import table, written

    sf = "/root/testdata/sf0.001"
    docs, bench, labels = (table(spark, sf, x) for x in ("documents", "benchmark", "labels"))
    want = [
        lambda d: quality.scores(d, labels).filter("predicted = 1"),
        lambda d: language_id.languages(d).filter("lang_pred != 'und' and not ambiguous"),
        lambda d: spark.createDataFrame([(x,) for x in {c for _, _, c in brute([(r.doc_id, r.text) for r in d.collect()])}], "doc_id long"),
        lambda d: decontaminate.contamination(d, bench).filter("not contaminated"),
    ]
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = written(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept(docs).collect()}, name
        assert 0 < out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.run(spark, sf)
    assert last.count() == docs.count() and "n_tokens" in last.columns
    assert last.filter(F.col("n_tokens").isNull()).count() == 0


def tasks_of(spark, work):
    """Tasks of all stages that ``work`` runs, with no shuffle partition merged away."""
    name, tracker, merge = "counted-" + str(random.random()), spark.sparkContext.statusTracker(), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        spark.conf.unset(merge)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_round_of_components_shuffles_little(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)], "a long, b long").coalesce(1)
    found = {}
    shuffles = tasks_of(spark, lambda: found.update((r.node, r.root) for r in components(edges).collect())) / 4
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)}
    assert shuffles < 70  # 109.5 when each half of a round removed its repeats and read its pairs twice


def test_likely_pairs_join_nothing(spark):
    rows = [(t, f, n, p) for t in range(3) for f, n, p in ((7, 10, 0), (3, 9, 1), (5, 4, 2))]
    likely = similarity._likely(similarity._offers(spark.createDataFrame(rows, "token long, fp long, n int, pos int")))
    assert "Join" not in likely._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, likely.collect())) == [(3, 7, 9, 10)]
