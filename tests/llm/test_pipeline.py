"""The pipeline over the smallest tables, stage by stage against what each stage promises."""

from pyspark.sql import functions as F

from corpus_pipeline import STAGES, run

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, function in STAGES[:4]:
        docs = function(spark, docs, SF).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2] > 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id", "left_semi").count() <= 0.1 * kept[3]
    pieces = run(spark, SF).cache()
    one = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert one.where("n > 2048 or (n & (n - 1)) != 0").count() == 0
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
