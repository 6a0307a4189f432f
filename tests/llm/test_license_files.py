"""Operator 9's result in few files, with the same rows."""

from fernweave.llm import licenses, queries


def test_few_files(spark, odd, tmp_path):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries.op9_licenses(spark, odd).write.parquet(f"{tmp_path}/out")
        docs = spark.read.parquet(f"{odd}/documents.parquet")
        expected = sorted((r.doc_id or -1, ",".join(r.licenses)) for r in licenses.scan(docs).collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id or -1, r.licenses) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == expected
    assert len(list((tmp_path / "out").glob("part-*"))) <= 12
