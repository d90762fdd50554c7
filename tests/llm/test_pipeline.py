"""The pipeline against its operators' results worked out on the driver."""

import corpus_pipeline
from colweave.llm import queries


def test_stages_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r["doc_id"] for r in queries.op2_quality(spark, sf_dir).collect() if r["predicted"] == 1}
    points = {r["doc_id"]: int(r["fingerprint"], 16) for r in queries.op7_simhash(spark, sf_dir).collect()}
    kept, group = set(), {}
    for i in sorted(good):  # components among the good documents alone
        near = {group[j] for j in group if (points[i] ^ points[j]).bit_count() <= 2}
        own = min(near, default=i)
        group = {j: own if g in near else g for j, g in group.items()} | {i: own}
    kept = set(group.values())
    leaks = {r["doc_id"] for r in queries.op5_decontamination(spark, sf_dir).collect()}
    tokens = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op6_token_files(spark, sf_dir).collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in rows} == {i: tokens[i] for i in kept - leaks}
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert first.columns == docs.columns


def test_tokens_follow_the_mixture(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    order = [r["doc_id"] for r in mixed.collect()]
    mixed.write.parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed"))
    rows = corpus_pipeline.tokens(spark, again, sf_dir).orderBy("start").collect()
    assert sorted(order) == sorted(r["doc_id"] for r in rows)
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in again.orderBy("_metadata.file_name", "_metadata.row_index").collect()]
