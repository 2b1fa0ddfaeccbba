"""The stages in a row, and what each must keep."""

from __future__ import annotations

import corpus_pipeline
from boxfield.llm import decontamination


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf).cache()
        assert out.columns == docs.columns, name
        assert out.join(kept, "doc_id", "left_anti").count() == 0
        assert 0.3 * kept.count() < out.count() <= kept.count()
        kept = out
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontamination.digest(decontamination.spans(kept, bench)).where("contaminated").count() == 0
    last = corpus_pipeline.run(spark, sf)
    assert last.count() == kept.count() and last.where("not round_trip").count() == 0


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_stages_on_odd_rows_equal_brute_force(spark, sf, tmp_path):
    """Nulls, repeated rows and ids, clashing columns; what each stage keeps is held against a plain version on its own input."""
    from pyspark.sql import functions as F

    from boxfield.llm import decontamination, quality_crf, simhash, toxicity

    from test_text_operators import exact_components

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").limit(4)
    odd = [
        docs.limit(0).union(first), first.withColumn("text", F.lit("another text of the same id " * 3)), first.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")),
        first.limit(1).withColumns({"doc_id": F.lit(900_001).cast("bigint"), "text": F.lit(None).cast("string")}), first.limit(1).withColumns({"doc_id": F.lit(900_002).cast("bigint"), "text": F.lit("")}),
        first.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}),
    ]
    for o in odd:
        docs = docs.unionByName(o)
    docs = docs.withColumn("score", F.lit("mine")).withColumn("component", F.lit(7))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text", "source", "score", "component").collect()), key=str)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        after = spark.read.parquet(str(tmp_path / f"out{k}"))
        rows = now.select("doc_id", "text", "source", "score", "component").collect()
        if name == "quality_classifier":
            model = quality_crf.fitted(now, labels)
            want = [r for r in rows if model.score(model.badness((r.text or "").encode())) >= 0.5]
        elif name == "toxicity":
            grammar = toxicity.fitted(now, labels)
            want = [r for r in rows if grammar.scores([None if r.text is None else r.text.encode()])[0] < 0.5]
        elif name == "simhash_near_dedup":
            named = [r for r in rows if r.doc_id is not None]
            texts = sorted({(r.doc_id, r.text) for r in named}, key=str)
            # One row of each component of rows: number the distinct rows, so that an id does not stand for two texts.
            group = dict(exact_components([(n, t) for n, (_, t) in enumerate(texts)]))
            kept = {}
            for n, (i, t) in enumerate(texts):
                kept.setdefault(group[n], set()).add(i)
            found = [r for r in after.collect() if r.doc_id is not None]
            of = {x: group[n] for n, x in enumerate(texts)}
            assert sorted(of[r.doc_id, r.text] for r in found) == sorted(kept)  # one row of each group
            assert all(r.doc_id == min(kept[of[r.doc_id, r.text]]) for r in found)
            want = [*found, *(r for r in rows if r.doc_id is None)]
            assert after.count() == len(want)
        elif name == "benchmark_decontamination":
            hit = [x[5] for x in decontamination.brute_force([(n, r.text) for n, r in enumerate(rows)], items)]
            want = [r for r, h in zip(rows, hit) if not h]
        else:
            assert sorted(r.doc_id or -1 for r in after.collect()) == sorted(r.doc_id or -1 for r in rows)
            continue
        assert after.columns == now.columns and key(after) == sorted(((r.doc_id, r.text, r.source, r.score, r.component) for r in want), key=str), name
        now = after
