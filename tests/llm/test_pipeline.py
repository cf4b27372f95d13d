import pathlib

import pytest

import corpus_pipeline
from pageloom.llm import decontaminate, jaccard, language, mixing, secrets

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    model = language.fit(language.sample(docs))
    ids = {r["doc_id"] for r in language.identify(docs, model).where("accepted").select("doc_id").collect()}
    kept = docs.where(docs.doc_id.isin(ids)).cache()
    ids = {r["doc_id"] for r in jaccard.join(kept).collect() if r["doc_id"] == r["class_id"]}
    ids -= {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()}
    out = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r["doc_id"] for r in out} <= ids
    masked = secrets.mask(docs.where(docs.doc_id.isin(ids)))
    want = sorted(tuple(r) for r in mixing.mix(masked).collect())
    assert sorted(tuple(r) for r in out) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "secret_masking", "source_mixing"]


def test_pipeline_over_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names; stage by stage, and as a whole."""
    clean = "the cat sat on the mat and looked at the moon while the rain fell on the old roof of the house near the river"
    long = " ".join(f"{w}{i}" for i in range(4000) for w in ("cat", "mat", "moon", "rain"))
    key = "AKIA" + "A" * 16
    rows = [(1, clean, "en", "a"), (1, clean, "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, clean + " again", "en", "b"), (5, " ".join(f"{w}%%%" for w in clean.split()), "en", "a"), (6, f"some other words with {key} inside of them", "en", None), (7, long, "en", "b"), (None, "the old roof of the moon and the rain near the house of the cat", None, "b"), (8, "before it " + " ".join(clean.split()[:15]) + " behind it come other things of its own kind that nobody wrote before", "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 9, "x", "y", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copy int, __gone string, whole string, family int, class_id int")
    bench = spark.createDataFrame([(1, " ".join(clean.split()[:14])), (2, None), (None, clean)], "item_id long, text string")
    sf = str(tmp_path)
    docs.coalesce(1).write.parquet(f"{sf}/documents.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids(stage["language_id"](spark, docs, sf)) == [1, 1, 4, 6, 7, 8, None]
    assert ids(stage["near_duplicates"](spark, docs, sf)) == [1, 1, 2, 3, 6, 7, 8, None]  # 4 and 5 hold the words of 1
    assert ids(stage["benchmark_decontamination"](spark, docs, sf)) == [2, 3, 6, 7, None]
    assert [r["text"] for r in stage["secret_masking"](spark, docs, sf).where("doc_id = 6").collect()] == ["some other words with [aws_access_key] inside of them"]
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, docs.limit(0), sf)
        assert empty.collect() == [] and set(docs.columns) <= set(empty.columns)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    assert {r["doc_id"] for r in out.collect()} <= {6, 7, None}
