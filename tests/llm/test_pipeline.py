"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
from shelfmark.llm.jaccard import jaccard_components
from shelfmark.llm.mixing import mixed_sizes
from shelfmark.llm.tables import documents, materialise
from shelfmark.llm.toxicity import CUT, score_toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = documents(spark, SF)
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(materialise(stage(spark, outs[-1], SF)))
        assert outs[-1].columns[: len(docs.columns)] == docs.columns, name
    ids = [{r["doc_id"] for r in o.select("doc_id").collect()} for o in outs]
    scored, score = score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r["doc_id"] for r in scored.where(f"{score} < {CUT}").collect()} != ids[0]
    assert ids[2] == ids[1] and outs[2].join(outs[1], ["doc_id", "text"]).count() < len(ids[1])
    groups = {}
    for r in jaccard_components(outs[2]).collect():
        groups.setdefault(("alone", r["doc_id"]) if r["component"] is None else r["component"], set()).add(r["doc_id"])
    assert ids[3] == {min(g) for g in groups.values()} and len(ids[3]) < len(ids[2])
    assert len(ids[3]) - 40 < len(ids[4]) < len(ids[3])
    want = {r["doc_id"]: r["copies"] for r in mixed_sizes(outs[4]).collect() if r["copies"]}
    assert outs[5].groupBy("doc_id").count().count() == len(want) and outs[5].count() == sum(want.values())
    assert outs[5].columns == [*docs.columns, "copy"]


def test_nulls_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2), (2, "few words", None, None, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part in (docs, docs.limit(0)):
        part.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert out.columns == [*docs.columns, "_copy"]
        assert {r["doc_id"] for r in out.collect()} <= {None, 1, 2}
