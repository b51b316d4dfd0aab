import corpus_pipeline
from cases import documents, empty
from repolytics.llm import queries  # noqa: F401
from repolytics.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_keep_the_columns(spark):
    for docs in (spark.read.parquet(f"{FOLDER}/documents.parquet"), documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns and out.count() <= docs.count()


def test_run_packs_what_the_stages_keep(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    total = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(r["length"] for r in rows) == sum(total.values())
