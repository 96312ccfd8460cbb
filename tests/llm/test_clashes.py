"""Every operator and every stage with columns whose names it might use itself, and on empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillspan.llm import bpe, decontaminate, language_id, media, quality, similarity, token_counts, toxicity
from quillspan.llm.common import forget, shared_folder, written

CLASHES = (
    "label _label hits _hits _hits_0 _seen _new _r score text_ _lang _quality _fp _root _component component_id fp n token held_out "
    "predicted lang_pred n_words media pcm ids _known count"
).split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120")
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(k) if k % 2 else F.lit(f"x{k}"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit("clash")).withColumn("label", F.lit(9)).withColumn("n", F.lit(1))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("hits", F.lit(1)).withColumn("line", F.lit("x")).withColumn("n", F.lit("y"))
    return docs.cache(), labels, bench


def test_operators_with_clashing_columns(tables):
    docs, labels, bench = tables
    plain = docs.drop(*CLASHES)
    for operator in (
        lambda d: toxicity.scores(d, labels), lambda d: quality.scores(d, labels), language_id.languages, bpe.digests, media.media_features,
        token_counts.token_counts, similarity.linked, lambda d: decontaminate.contamination(d, bench),
    ):
        rows = lambda d: sorted(map(tuple, operator(d).collect()), key=repr)  # noqa: B023, E731
        assert rows(docs) == rows(plain)


def test_stages_with_clashing_columns_and_empty_tables(spark, tables, tmp_path):
    docs, labels, bench = tables
    for name, table in (("labels", labels), ("benchmark", bench)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for frame in (docs, docs.filter("false")):
        plain = frame.drop(*CLASHES)
        for name, stage in corpus_pipeline.STAGES:
            out, alike = stage(spark, frame, str(tmp_path)), stage(spark, plain, str(tmp_path))
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in alike.collect()}, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns, name
                frame, plain = written(out), written(alike)


def test_stages_keep_nulls_and_repeats_apart(spark, tmp_path):
    """A null text and a repeated row meet every stage; stages that judge texts let the empty one go, the others keep it."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "Some words of a text, and more.", "en", "s", 31), (3, "Some words of a text, and more.", "en", "s", 31), (None, "x y z", None, "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = {name: [(r.doc_id, r.text if "text" in r else None) for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in corpus_pipeline.STAGES}
    assert sorted(i for i, _ in out["n-gram Jaccard join"] if i) == [1, 2, 3] and (None, "x y z") in out["n-gram Jaccard join"]
    assert len(out["benchmark decontamination"]) == 5 and len(out["BPE encoding and decoding"]) == 5
    assert {i for i, _ in out["language ID"]} <= {3, None}


def test_written_tables_are_deleted_and_machines_folders_refused(spark):
    import os

    one = written(spark.range(3))
    path = one.written_to.removeprefix("file:")
    assert os.path.isdir(path) and one.count() == 3
    forget(one)
    assert not os.path.exists(path)

    class Elsewhere:  # a cluster's session without a shared folder
        sparkContext = type("C", (), {"master": "yarn"})
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere)
