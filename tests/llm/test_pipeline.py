"""The corpus pipeline's stages against brute force on the smallest tables."""

import corpus_pipeline
from chartwright.llm import decontaminate, queries
from tests.llm.test_operators import classes_of, plain_distance, plain_fingerprint

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name in ("toxicity", "quality", "simhash", "decontamination"):
        out = stages[name](spark, docs, DATA)
        assert out.columns == docs.columns
        left, before = {r["doc_id"] for r in out.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            known = [i for i in before if i in labels]
            assert sum((i in left) == (labels[i]["quality"] == 1) for i in known) >= 0.9 * len(known)
        if name == "simhash":
            fps = {i: plain_fingerprint(t) for i, t in before.items()}
            root = classes_of(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
            assert left == set(root.values())
        if name == "decontamination":
            items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            short = {i: decontaminate.normal(t) for i, t in before.items() if len(t or "") < 1500}
            for i, t in list(short.items())[:12]:
                assert (i not in left) == any(plain_distance(x, t) <= int(0.1 * len(x)) for x in items)
            assert not [i for i in left if any(x in decontaminate.normal(before[i]) for x in items)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id").distinct().count() == docs.count()


def test_whole_run(spark, tmp_path):
    """run() is its stages one after another, and an empty documents table gives no rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    left = {r["doc_id"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in got} == left and 0 < len(left) < len(ids)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0 if t == "documents" else 1000).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark):
    """Null ids, null, empty and long texts, repeated rows and clashing columns go through every stage."""
    good = next(r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 500").orderBy("doc_id").collect())
    rows = [(None, None), (None, good), (1, ""), (2, "word " * 60_000), (3, good), (3, good), (-4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, k long, key long, label long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() <= len(rows), name
        if name in ("toxicity", "decontamination"):
            assert out.where("text is null or text = ''").count() == 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).where("start = 0").count() == len(rows)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.QUERIES) <= set(names)
