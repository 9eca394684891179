"""The pipeline's stages, each on its own input, and the whole."""

import collections

import corpus_pipeline as P
from fernweave.llm.minhash import near_duplicates
from fernweave.llm.toxicity import score_documents, train

SF = "/root/testdata/sf0.001"
NAMES = ["toxicity", "line_dedup", "minhash", "mixing", "pieces"]


def test_stages(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == NAMES and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "pieces":
            assert docs.columns == columns
        if name == "toxicity":
            scored = score_documents(before, train(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in scored if not r.predicted) and 0 < kept[name] < len(scored)
        elif name == "line_dedup":
            assert kept[name] == kept["toxicity"]
        elif name == "minhash":
            classes = {r.class_id for r in near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(classes)
    assert kept["pieces"] == kept["mixing"]
    got = P.run(spark, SF)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == collections.Counter((r.doc_id, tuple(r.ids)) for r in docs.collect())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:4]:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
