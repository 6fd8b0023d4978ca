"""The pipeline's stages take effect in order, keep the columns of documents and leave no decision undone."""

import __spark_entry__ as entry
import corpus_pipeline
from opslake.llm import decontaminate, jaccard_join, packing
from opslake.sources.sinks import materialize
from opslake.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    assert decontaminate.contained_items(docs, table(spark, SF, "benchmark")).count() == 0
    left = jaccard_join.jaccard_components(docs)
    assert left.where("doc_id <> component_id").count() == 0
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = {r["doc_id"]: len(packing.tokenizer(corpus_pipeline.TOKENIZER).ids(_one(r["text"]))[0]) // 4 + 1 for r in docs.collect()}
    got = {}
    for r in placed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def _one(text):
    import pyarrow as pa
    return pa.array([text], pa.string())


def test_registered():
    names = entry.queries()
    assert {"pipeline", *(f"op{i}_" for i in range(1, 14))} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in names}


def test_every_stage_bounds_its_batches(spark):
    import pyarrow as pa
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('x', 100000) AS text")

    def size(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        got = corpus_pipeline.bounded(lambda s, d, p: d.mapInArrow(size, "n long"))(spark, docs, SF)
        assert max(r["n"] for r in got.collect()) < 5_000_000
        spark.conf.set(name, "9000000")  # the session's own value is kept
        corpus_pipeline.bounded(lambda s, d, p: d)(spark, docs, SF)
        assert spark.conf.get(name) == "9000000"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
