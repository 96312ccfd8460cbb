"""Toxicity, language and quality: held-out accuracy, odd rows, no labels."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import language_id, quality, toxicity

WORDS = {
    "en": "the and of with from that which house water light under never people through".split(),
    "de": "der und von mit aus dass welche haus wasser licht unter niemals leute durch".split(),
    "fr": "le et de avec depuis que quelle maison eau lumière sous jamais gens travers".split(),
}
BAD = "grobble snarkfest".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(4), [], []
    for k in range(900):
        lang = ("en", "de", "fr")[k % 3]
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "s", "en", "ly"]) for _ in range(rng.randint(30, 90))]
        toxic, good = k % 5 == 0, k % 4 != 1
        if toxic:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        text = " ".join(words) if good else " ".join(w.upper() + "###" for w in words)
        docs.append((k, text, lang, "s"))
        labels.append((k, int(good), int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def held_out_accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id")
    return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_toxicity(corpus, odd, empty):
    docs, labels = corpus
    assert held_out_accuracy(toxicity.scores(docs, labels), labels, "toxic") >= 0.9
    check_scores(toxicity.scores, corpus, odd, empty)


def test_quality(corpus, odd, empty):
    docs, labels = corpus
    assert held_out_accuracy(quality.scores(docs, labels), labels, "quality") >= 0.95
    check_scores(quality.scores, corpus, odd, empty)
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.scores(docs, labels).filter("predicted = 1").count()


def check_scores(scores, corpus, odd, empty):
    docs, labels = corpus
    rows = scores(odd, labels).collect()  # no text of odd is labelled alike: still a score for each
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert scores(empty, labels).count() == 0
    none = scores(docs, labels.filter("false"))
    assert none.select("score").distinct().count() == 1
    one = [r.score for r in scores(docs.limit(3), labels.filter("toxic = 1 and quality = 1")).collect()]
    assert len(set(one)) == 1 and one[0] > 0.99


def test_language(corpus, odd, empty):
    docs, _ = corpus
    r = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99
    rows = language_id.languages(odd.drop("lang").withColumn("lang", F.lit("en"))).collect()
    assert len(rows) == odd.count() and {x.lang_pred for x in rows} == {"en", "und"}
    texts = {x.doc_id: x.text for x in odd.collect()}
    for x in rows:
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in texts[x.doc_id] or ""))
        assert 0 <= x.score <= 1
    assert language_id.languages(empty).count() == 0
    assert {x.lang_pred for x in language_id.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.kept(docs).columns == docs.columns


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = language_id.codewords(n)
        apart = min((a != b).sum() for k, a in enumerate(code) for b in code[:k])
        assert apart >= (1 if n < 3 else 2) and len(code) == n


def test_rules_compile_to_what_they_say(spark):
    model = (0.25, [(1.5, ((0, 2.0, True), (1, 5.0, False))), (-2.0, ((0, 2.0, False),))])
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 5.0), (3.0, 6.0)], "a double, b double")
    out = [r[0] for r in df.select(quality.compiled(model, [F.col("a"), F.col("b")])).collect()]
    import math

    assert out == pytest.approx([1 / (1 + math.exp(1.75)), 1 / (1 + math.exp(-1.75)), 1 / (1 + math.exp(-0.25))])
