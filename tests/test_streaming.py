from pyspark.sql import functions as F

from palimpsest.operators import templates
from palimpsest.streaming import merge


def test_letters_and_new_keys(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = lambda r: spark.createDataFrame(r, "leaf string, n int").write.mode("append").json(at("in"))
    stream = lambda: spark.readStream.schema("leaf string, n int").json(at("in"))
    render = lambda df: df.select("leaf", templates.compile_template("{leaf}={n}", df.schema).alias("text"))
    have = spark.createDataFrame([("old",)], "leaf string")
    for batch in ([("a", 2), ("a", 1), ("b", 2), ("old", 9)], [("b", 3), ("c", 4), (None, 5), (None, None)], [("a", 0), (None, 1)]):
        rows(batch)
        merge.rendered(stream(), render, at("letters"), at("c1")).awaitTermination()
        merge.keep_new(stream(), at("keys"), "leaf", at("c2"), have=have).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(at("letters")).where("text not like '=%'").collect()) == ["a=0", "a=1", "a=2", "b=2", "b=3", "c=4", "old=9"]
    assert sorted((tuple(r) for r in spark.read.parquet(at("keys")).select("leaf", F.col("n")).collect()), key=str) == [("a", 1), ("b", 2), ("c", 4), (None, None)]
